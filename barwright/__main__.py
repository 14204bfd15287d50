"""``python -m barwright <job> --base <path> ...``, also the file to hand to spark-submit."""

import argparse

from pyspark.sql import SparkSession

from barwright.operators.quality import IncompleteLanding, newest_first_listing
from barwright.operators.regime import regime_distribution
from barwright.plans import Layout, adjust, check_landing, curate, daily, detect, load_contacts, stocks
from barwright.plans.jobs import events_without_bar, stock_targets


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="barwright")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *, dated: bool) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        sub.add_argument("--base", required=True, help="path the layers live below")
        if dated:
            sub.add_argument("date", help="run date, yyyy-MM-dd")
        return sub

    gate = job("check-landing", dated=True)
    gate.add_argument("--symbols", required=True, help="text file, one symbol per line")
    job("curate", dated=True).add_argument(
        "--merge", action="store_true", help="keep the bars of symbols that did not land"
    )
    job("daily", dated=True)
    job("adjust", dated=False)
    job("detect", dated=False).add_argument("--since", help="compute only this day and later ones")
    job("stocks", dated=True).add_argument(
        "--formats", nargs="+", default=["avro", "parquet"], choices=["avro", "parquet"]
    )
    contacts = jobs.add_parser("contacts")
    for name in ("csv", "url", "user", "password", "driver"):
        contacts.add_argument(f"--{name}", required=True)
    contacts.add_argument("--table", required=True)
    return parser.parse_args()


def main() -> None:
    args = _arguments()
    spark = SparkSession.builder.appName(f"barwright-{args.job}").getOrCreate()
    if args.job == "contacts":
        login = {"user": args.user, "password": args.password, "driver": args.driver}
        load_contacts(spark, args.csv, args.url, login, args.table)
        return

    layout = Layout(args.base)
    if args.job == "check-landing":
        symbols = spark.read.text(args.symbols).withColumnRenamed("value", "symbol")
        try:
            check_landing(spark, layout, symbols, args.date).show()
        except IncompleteLanding as error:
            for gap in error.gaps.toLocalIterator():
                print(*gap)
            raise
    elif args.job == "curate":
        print("rows written:", curate(spark, layout, args.date, merge=args.merge))
    elif args.job == "daily":
        print("rows written:", daily(spark, layout, args.date))
    elif args.job == "adjust":
        prices = adjust(spark, layout).drop("open", "high", "low", "volume")
        newest_first_listing(prices).show(truncate=False)
        print("events on days without a bar:", events_without_bar(spark, layout).count())
    elif args.job == "detect":
        regimes = detect(spark, layout, args.since)
        newest_first_listing(regimes).show(truncate=False)
        regime_distribution(regimes).show(truncate=False)
    elif args.job == "stocks":
        targets = stock_targets(layout, args.date)
        stocks(spark, layout, args.date, {fmt: targets[fmt] for fmt in args.formats})


if __name__ == "__main__":
    main()
