"""Several providers of one bar, and days that a symbol lacks."""

import random
from datetime import date, timedelta

from helpers import BAR_SCHEMA, bar

from barwright.operators import quality

DAY = "trade_date_market"
START = date(2024, 1, 1)


def day(k):
    return START + timedelta(k)


def test_the_first_provider_that_has_a_bar_wins(spark):
    first = [bar("A", day(0), 1.0), bar(None, day(0), 4.0)]
    second = [bar("A", day(0), 2.0), bar("A", day(1), 3.0), bar("A", day(1), 2.5), bar(None, day(0), 4.0)]
    frames = {n: spark.createDataFrame(rows, BAR_SCHEMA) for n, rows in (("x", first), ("y", second), ("z", []))}
    ranked = quality.by_precedence(frames)
    got = {(r.symbol, r[DAY]): (r.close, r.provider) for r in quality.merge_providers(ranked).collect()}
    assert got == {("A", day(0)): (1.0, "x"), ("A", day(1)): (2.5, "y"), (None, day(0)): (4.0, "x")}
    conflicts = quality.provider_conflicts(ranked).collect()
    assert [tuple(r) for r in conflicts] == [("A", day(0), 2, "x", 1.0, 2.0)]


def test_providers_may_lack_columns(spark):
    full = spark.createDataFrame([bar("A", day(0), 1.0)], BAR_SCHEMA)
    less = spark.createDataFrame([("A", day(0), 2.0), ("B", day(0), 3.0)], f"symbol string, {DAY} date, close double")
    ranked = quality.by_precedence({"less": less, "full": full})
    got = {r.symbol: (r.close, r.high, r.provider) for r in quality.merge_providers(ranked).collect()}
    assert got == {"A": (2.0, None, "less"), "B": (3.0, None, "less")}


def test_missing_days_equal_a_walk_over_the_calendar(spark):
    r = random.Random(7)
    have = {s: sorted(k for k in range(120) if k % 7 < 5 and r.random() < share) for s, share in (("A", 0.9), ("B", 0.4), ("C", 1.0), ("D", 0.05))}
    rows = [bar(s, day(k), 1.0) for s, ks in have.items() for k in ks]
    rows += [bar("A", day(have["A"][0]), 2.0), bar(None, day(have["C"][3]), 1.0), bar("A", None, 1.0)]
    have[None] = [have["C"][3]]
    calendar = sorted({k for ks in have.values() for k in ks})
    want = set()
    for symbol, own in have.items():
        run = []
        for k in [*[c for c in calendar if c > own[0]], None]:
            if k is not None and k not in own:
                run.append(k)
            elif run:
                want.add((symbol, day(run[0]), day(run[-1]), len(run)))
                run = []
    got = quality.missing_days(spark.createDataFrame(rows, BAR_SCHEMA)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert quality.missing_days(spark.createDataFrame([], BAR_SCHEMA)).collect() == []
