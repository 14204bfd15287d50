"""Landing envelopes.

One envelope per result row: the ``results`` array holds a single element, or none for a
symbol that was asked for and has nothing to report. A symbol with a very long history is
thereby never gathered into one document, and nothing is shuffled to build it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.dates import market_zone
from barwright.schemas import ENDPOINT_RESULTS, PROVIDER
from barwright.sources.landing import LINES, landing_path

#: Landed text repeats its field names in every document, so it is written as gzip. A compressed file is read by
#: one task: so many documents of a line each, or indented ones, which are read a file at a time, go to a file.
COMPRESSED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
FILE_LINES = 500_000
FILE_DOCUMENTS = 200

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def envelopes(
    results: DataFrame,
    endpoint: str,
    execution_date: str,
    *,
    requested: DataFrame | None = None,
    ingested_at: Column | None = None,
) -> DataFrame:
    """Wrap result rows (``symbol`` plus the endpoint's fields) in the landing envelope.

    ``requested`` lists the symbols asked for; those without a result get an empty envelope,
    which is how a completed call with nothing to report is told from a missing one. Daily
    bars have no such envelope: a day without a bar counts as a failed call.
    """
    fields = ENDPOINT_RESULTS[endpoint]
    one = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    rows = results.select("symbol", F.array(one).alias("results"))
    if requested is not None and endpoint != "daily_ohlcv":
        heard = results.select("symbol").distinct()
        silent = requested.select("symbol").distinct().join(heard, "symbol", "left_anti")
        nothing = F.array().cast(rows.schema["results"].dataType)
        rows = rows.unionByName(silent.select("symbol", nothing.alias("results")))

    stamp = F.current_timestamp() if ingested_at is None else ingested_at
    utc_stamp = F.to_utc_timestamp(stamp, F.current_timezone())
    return rows.select(
        "symbol",
        F.lit(PROVIDER).alias("source"),
        F.lit(endpoint).alias("endpoint_type"),
        F.date_format(utc_stamp, ISO_UTC).alias("ingestion_timestamp"),
        F.lit(execution_date).alias("execution_date"),
        market_zone("symbol").alias("market_timezone"),
        F.struct("results").alias("payload"),
    )


def land_envelopes(envelopes: DataFrame, base: str, endpoint: str) -> None:
    """Add envelopes of one endpoint as JSON lines below ``base/<endpoint>/ingestion_date=<date>``,
    in the folder that :func:`barwright.sources.read_landing` takes for lines.

    Nothing landed is touched; pass the envelopes through
    :func:`barwright.operators.quality.not_yet_landed` first so a second run adds nothing.
    """
    name, _, value = LINES.partition("=")
    dated = envelopes.withColumns({"ingestion_date": F.col("execution_date"), name: F.lit(value)})
    writer = dated.write.mode("append").partitionBy("ingestion_date", name)
    writer.options(**COMPRESSED).option("maxRecordsPerFile", FILE_LINES).json(f"{base}/{endpoint}")


def land_texts(documents: DataFrame, base: str, endpoint: str, execution_date: str, *, lines: bool) -> None:
    """Write the column ``value``, a document of one endpoint and run date in each row, as files that
    :func:`barwright.sources.read_landing` takes: ``lines`` if each document is a single line."""
    path = landing_path(base, endpoint, execution_date)
    writer = documents.select("value").write.options(**COMPRESSED)
    writer = writer.option("maxRecordsPerFile", FILE_LINES if lines else FILE_DOCUMENTS)
    writer.text(f"{path}/{LINES}" if lines else path)
