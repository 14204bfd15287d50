"""Runs that only touch what changed, against full runs over the same layers."""

import random
import time
from datetime import date, datetime, timedelta

import pytest
from helpers import BAR_SCHEMA, by_symbol, random_bars
from pyspark.sql import functions as F
from test_actions import frames
from test_curate import drop_document
from test_jobs import RUN, curated, land_documents, market  # noqa: F401

from barwright import plans, schemas
from barwright.operators import actions, carried, regime
from barwright.plans import Layout
from barwright.plans.jobs import append_events
from barwright.sinks import merge_partitions, overwrite_partitions, overwrite_table, partition_values
from barwright.sources import read_table

DAY = "trade_date_market"


def rows(table, *names):
    table = table.select(*names) if names else table
    return sorted(map(tuple, table.collect()), key=str)


def adjusted(spark, layout):
    return curated(spark, layout, "ohlcv_adjusted", schemas.OHLCV_ADJUSTED)


def bars_frame(spark, history):
    full = [(s, d, None, o, h, l, c, v, None, None, None, "polygon") for s, d, o, h, l, c, v in history]
    return spark.createDataFrame(full, schemas.OHLCV)


def split(symbol, name, day, ratio, run):
    return (symbol, name, day, 1.0, ratio, ratio, datetime(2024, 2, 1) + timedelta(days=run))


def dividend(symbol, name, day, cash, run):
    return (symbol, name, cash, "USD", None, day, None, None, "CD", 4, datetime(2024, 2, 1) + timedelta(days=run))


def test_five_random_batches(spark, tmp_path):
    """After each batch of new days, late bars, corrected and new events: what full runs give."""
    r = random.Random(11)
    one, full = Layout(str(tmp_path / "one")), Layout(str(tmp_path / "full"))
    history = random_bars(61, {"AAPL": 64, "0700": 40, "MSFT": 20, "ONE": 5}, gaps=(1,))
    days = sorted({row[1] for row in history})
    cuts = [0, len(days) // 3, *(len(days) // 3 + k * len(days) // 9 for k in range(1, 6)), len(days)]
    late = [row for row in history if r.random() < 0.02]
    events = [], []
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        span = set(days[a:b])
        fresh = [row for row in history if row[1] in span and row not in late]
        if batch:  # some bars come late or are corrected, and one day loses its bars
            fresh += late[batch::5]
            fixed = r.choice([row for row in history if row[1] in days[:a]])
            fresh.append((*fixed[:5], fixed[5] + 1.0, fixed[6]))
        known = [row for row in history if row[1] <= days[b - 1]]
        events[0].append([split(s, f"s{r.randint(0, 4)}", d, r.choice([2.0, 3.0, 0.5, 1.0]), batch) for s, d, *_ in r.sample(known, 3)])
        events[1].append([dividend(s, f"d{r.randint(0, 4)}", d, r.choice([0.5, 1.0, 0.0]), batch) for s, d, *_ in r.sample(known, 3)])
        landed = sorted({str(row[1]) for row in fresh})
        for layout in (one, full):
            merge_partitions(bars_frame(spark, fresh), layout.curated("ohlcv"), schemas.OHLCV, ["symbol", DAY], [DAY])
            new = spark.createDataFrame(events[0][-1], schemas.SPLITS)
            append_events(new, "split_id", layout.curated("splits"), schemas.SPLITS, "execution_date")
            new = spark.createDataFrame(events[1][-1], schemas.DIVIDENDS)
            append_events(new, "dividend_id", layout.curated("dividends"), schemas.DIVIDENDS, "ex_dividend_date")
        counts: dict = {}
        if not batch:
            plans.adjust(spark, one)
            plans.detect(spark, one)
        else:
            changes = plans.adjust_changes(spark, one, landed, counts)
            plans.detect_changes(spark, one, landed[0], changes, counts)
        plans.adjust(spark, full)
        plans.detect(spark, full)
        assert rows(adjusted(spark, one)) == rows(adjusted(spark, full))
        for table, schema in (("regime", schemas.REGIME), ("factor_steps", schemas.FACTOR_STEPS)):
            assert rows(curated(spark, one, table, schema)) == rows(curated(spark, full, table, schema))
        assert partition_values(spark, one.curated("regime"), DAY) == partition_values(spark, full.curated("regime"), DAY)


def test_nothing_changed_writes_the_new_days_only(spark, tmp_path):
    layout = Layout(str(tmp_path))
    history = random_bars(62, {"A": 120, "B": 60}, gaps=(1,))
    last = max(row[1] for row in history)
    overwrite_partitions(bars_frame(spark, [row for row in history if row[1] < last]), layout.curated("ohlcv"), [DAY])
    plans.adjust(spark, layout)
    plans.detect(spark, layout)
    new = [row for row in history if row[1] == last]
    overwrite_partitions(bars_frame(spark, new), layout.curated("ohlcv"), [DAY])
    files = {p: p.stat().st_mtime_ns for t in ("ohlcv_adjusted", "regime") for p in (tmp_path / "curated" / t).rglob("*.parquet")}
    counts: dict = {}
    changes = plans.adjust_changes(spark, layout, [str(last)], counts)
    assert changes.count() == 0
    plans.detect_changes(spark, layout, str(last), changes, counts)
    assert counts == {"ohlcv_adjusted": len(new), "regime": len(new)}
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    again: dict = {}
    plans.detect_changes(spark, layout, str(last), changes, again)  # a run may be repeated
    assert again == {"regime": len(new)}
    want = rows(curated(spark, layout, "regime", schemas.REGIME))
    assert want == rows(plans.detect(spark, layout))


def test_no_older_day_is_read_for_steady_symbols(spark, tmp_path):
    path = str(tmp_path / "adjusted")
    history = random_bars(63, {"A": 100}, gaps=(1,))
    bars = spark.createDataFrame(history, BAR_SCHEMA)
    overwrite_table(bars, path, [DAY])
    since = str(sorted(row[1] for row in history)[90])
    state = carried.last_bars(bars.filter(F.col(DAY) < since))
    state.write.parquet(str(tmp_path / "state"))
    state = spark.read.parquet(str(tmp_path / "state"))
    new = read_table(spark, path, BAR_SCHEMA)
    got = carried.regimes_from_state(state, new, since)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = [line.partition("PartitionFilters: ")[2] for line in plan.splitlines() if "FileScan" in line]
    of_bars = [line for line in scans if not line.startswith("[]")]
    assert len(of_bars) == 2 and all(f">= {since})" in line for line in of_bars)
    assert len(scans) == 4  # the others are of the state
    assert rows(got) == rows(regime.detect_regimes(bars).filter(F.col(DAY) >= since))


def test_state_is_bounded_and_says_what_it_lacks(spark):
    bars = spark.createDataFrame(random_bars(64, {"A": 200, "B": 54, "C": 3}, gaps=(1,)), BAR_SCHEMA)
    state = carried.last_bars(bars)
    assert {tuple(r) for r in state.groupBy("symbol", "has_older").count().collect()} == {("A", True, 54), ("B", False, 54), ("C", False, 3)}
    days = sorted(r[0] for r in bars.filter("symbol = 'A'").select(DAY).collect())
    assert carried.beyond_state(state, bars, str(days[-27])).collect() == []
    assert [r[0] for r in carried.beyond_state(state, bars, str(days[-28])).collect()] == ["A"]
    since = str(days[-20])
    same = carried.next_state(state, bars, since)
    assert rows(same.filter("symbol = 'A'")) == rows(state.filter("symbol = 'A'"))


def test_changed_intervals(spark):
    schema = "symbol string, day date, split double, paid double"
    day = lambda k: date(2024, 1, k)
    was = [("A", day(10), 1.0, 0.0), ("A", day(20), 0.5, 0.0), ("B", day(5), 1.0, 0.0), ("C", day(9), 1.0, 0.1)]
    now = [("A", day(10), 1.0, 0.0), ("A", day(15), 0.7, 0.0), ("A", day(20), 0.5, 0.0), ("C", day(9), 1.0, 0.1), ("D", day(3), 2.0, 0.0), ("D", day(1), 2.5, 0.0)]
    got = actions.changed_intervals(spark.createDataFrame(was, schema), spark.createDataFrame(now, schema))
    # A changes between the tenth and the fifteenth only, B loses its event, D has two neighbours
    assert rows(got) == sorted([("A", day(10), day(15)), ("B", None, day(5)), ("D", None, day(3))], key=str)
    bars = spark.createDataFrame([(s, day(k)) for s in "ABCD" for k in range(1, 29)], f"symbol string, {DAY} date")
    inside = {(r[0], r[1].day) for r in actions.bars_in(bars, got).collect()}
    assert inside == {("A", k) for k in range(11, 16)} | {("B", k) for k in range(1, 6)} | {("D", k) for k in range(1, 4)}


def test_steps_equal_running_sums_over_all_bars(spark):
    history = random_bars(65, {"HOT": 400, "MID": 60})
    r = random.Random(3)
    splits = [(s, f"s{k}", d, r.choice([2.0, 0.5, 1.0, 0.0, -1.0, 3.0])) for k, (s, d, *_) in enumerate(r.sample(history, 60))]
    paid = [(s, f"d{k}", d, r.choice([0.5, None, 0.0, 2.0])) for k, (s, d, *_) in enumerate(r.sample(history, 80))]
    bars, splits, paid = frames(spark, history, splits, paid)
    summed = actions.add_adjustment_factor(actions.join_events(bars, splits, paid))
    stepped = actions.with_factors(bars, actions.factor_steps(bars, splits, paid), numbered=True)
    names = ["symbol", DAY, "bar_no", "cumulative_split_factor", "dividend_adjustment", "adjustment_factor"]
    number = lambda x: float("nan") if x is None else x
    for a, b in zip(rows(summed, *names), rows(stepped, *names), strict=True):
        assert a[:3] == b[:3] and list(map(number, a[3:])) == pytest.approx(list(map(number, b[3:])), rel=1e-12, nan_ok=True)


def test_usual_back_adjustment(spark):
    """A split of two for one on the ninth halves the days before it; a dividend of 10 on the eleventh
    lowers them by a tenth of the close of the tenth."""
    day = lambda k: date(2024, 3, k)
    history = [("A", day(k), c, c, c, c, 1.0) for k, c in ((7, 190.0), (8, 200.0), (9, 101.0), (10, 100.0), (11, 92.0), (12, 95.0))]
    tables = frames(spark, history, [("A", "s", day(9), 2.0)], [("A", "d", day(11), 10.0), ("A", "first", day(7), 5.0), ("A", "all", day(8), 190.0)])
    got = {r[DAY].day: r.adjusted_close for r in actions.adjust_prices(*tables, convention=actions.LOWER).collect()}
    assert got == pytest.approx({7: 190 / 2 * 0.9, 8: 90.0, 9: 101 * 0.9, 10: 90.0, 11: 92.0, 12: 95.0})
    with pytest.raises(ValueError):
        actions.factor_steps(*tables, convention="other")


def test_usual_back_adjustment_over_years(spark):
    """The close before an event is the last one of an earlier year where the event's bar is a year's
    first."""
    history = random_bars(66, {"A": 120, "B": 30}, gaps=(1, 40, 200, 500))
    splits, paid, want = [], [], {}
    for symbol, own in by_symbol(history).items():
        factor = 1.0
        for k, row in reversed(list(enumerate(own))):
            want[symbol, row[1]] = factor
            if k % 3 == 0:
                splits.append((symbol, f"s{k}", row[1], 2.0 if k % 2 else 0.25))
                factor /= 2.0 if k % 2 else 0.25
            if k % 4 == 0 and k and own[k - 1][5] > 0.5:
                paid.append((symbol, f"d{k}", row[1], 0.5))
                factor *= 1 - 0.5 / own[k - 1][5]
    got = actions.adjust_prices(*frames(spark, history, splits, paid), convention=actions.LOWER)
    found = {(r.symbol, r[DAY]): r.adjustment_factor for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_merge_keeps_the_others_of_a_day(spark, tmp_path):
    path, schema = str(tmp_path / "t"), f"symbol string, close double, {DAY} date"
    day = lambda k: date(2024, 1, k)
    first = spark.createDataFrame([("A", 1.0, day(1)), ("B", 2.0, day(1)), ("A", 3.0, day(2)), (None, 9.0, day(2))], schema)
    overwrite_partitions(first, path, [DAY])
    some = spark.createDataFrame([("B", 5.0, day(1)), ("B", 5.0, day(1)), ("C", 6.0, day(3)), (None, 8.0, day(2))], schema)
    assert merge_partitions(some, path, schema, ["symbol", DAY], [DAY]) == 5
    want = [("A", 1.0, day(1)), ("A", 3.0, day(2)), ("B", 5.0, day(1)), ("C", 6.0, day(3)), (None, 8.0, day(2))]
    assert rows(read_table(spark, path, schema)) == sorted(want, key=str)
    gone = spark.createDataFrame([("A", day(1)), ("C", day(3))], f"symbol string, {DAY} date")
    assert merge_partitions(some.limit(0), path, schema, ["symbol", DAY], [DAY], gone=gone) == 1
    assert rows(read_table(spark, path, schema)) == sorted(want[1:3] + want[4:], key=str)
    assert partition_values(spark, path, DAY) == ["2024-01-01", "2024-01-02"]
    assert partition_values(spark, str(tmp_path / "none"), DAY) == []


def test_a_run_since_drops_vanished_days(spark, market):  # noqa: F811
    import shutil
    from pathlib import Path

    layout, _, histories, _ = market
    plans.curate(spark, layout, RUN)
    plans.adjust(spark, layout)
    plans.detect(spark, layout)
    lonely = {r[1] for r in histories["AAPL"]} - {r[1] for r in histories["0700"]}
    old, new = sorted(lonely)[3], sorted(lonely)[-2]
    for gone in (old, new):
        shutil.rmtree(Path(layout.curated("ohlcv_adjusted")) / f"{DAY}={gone}")
    since = rows(plans.detect(spark, layout, str(sorted(lonely)[-4])))
    assert not {r[1] for r in since} & {old, new}
    assert since == rows(plans.detect(spark, layout))


def test_a_late_run_merges_and_keeps_what_did_not_land(spark, market, tmp_path):  # noqa: F811
    layout, base, histories, _ = market
    assert plans.curate(spark, layout, RUN) == {"ohlcv": 45, "splits": 1, "dividends": 1}
    (tmp_path / "landing" / "polygon" / "daily_ohlcv" / f"ingestion_date={RUN}" / "AAPL.json").write_text("{}")
    assert plans.curate(spark, layout, RUN, merge=True)["splits"] == 0
    assert curated(spark, layout, "ohlcv", schemas.OHLCV).count() == 45
    written: dict = {}
    plans.adjust(spark, layout, written)
    plans.detect(spark, layout, rows=written)
    assert written == {"ohlcv_adjusted": 45, "regime": 45}


def test_documents_are_parsed_once(spark, market):  # noqa: F811
    """The curation reads what the gate has parsed, until something lands again."""
    layout, base, histories, _ = market
    symbols = spark.createDataFrame([("AAPL",), ("0700",)], "symbol string")
    plans.check_landing(spark, layout, symbols, RUN)
    folder = base / "daily_ohlcv" / f"ingestion_date={RUN}"
    kept = (folder / "0700.json").read_text()
    stamp = (folder / "0700.json").stat()
    (folder / "0700.json").write_text("{")  # would stop the run if it were parsed
    import os

    os.utime(folder / "0700.json", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    assert plans.curate(spark, layout, RUN)["ohlcv"] == 45
    time.sleep(0.01)
    (folder / "0700.json").write_text("{")
    with pytest.raises(Exception, match="not a landing document"):
        plans.curate(spark, layout, RUN)
    (folder / "0700.json").write_text(kept)
    assert plans.curate(spark, layout, RUN)["ohlcv"] == 45


def test_daily_job(spark, market):  # noqa: F811
    """Three runs, each with another day and the last with a new split, equal full runs."""
    layout, base, histories, _ = market
    own = histories["AAPL"]
    folder = base / "daily_ohlcv" / f"ingestion_date={RUN}"
    for upto, split_day in ((25, None), (38, None), (40, own[30][1])):
        land_documents(base, {"AAPL": own[:upto] if upto == 25 else own[upto - 3 : upto]})
        if split_day:
            drop_document(base, "splits", "AAPL", {"results": [{"id": "new", "execution_date": str(split_day), "split_from": 1, "split_to": 4}]})
        assert folder.exists()
        counts = plans.daily(spark, layout, RUN)
        assert counts["ohlcv"] and counts["ohlcv_adjusted"]
        got = rows(adjusted(spark, layout)), rows(curated(spark, layout, "regime", schemas.REGIME))
        assert got == (rows(plans.adjust(spark, layout)), rows(plans.detect(spark, layout)))
