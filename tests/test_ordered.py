"""Long series take another way through the data and must give the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from repolytics.operators import joins, ordering, sequence
from repolytics.operators.ordered import OrderedSeries, Running, number_rows


@pytest.fixture(scope="module")
def samples(spark):
    """One series with a third of all rows, one without key, many short ones."""
    rnd = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows, count = [], {}
    for i in range(3000):
        key = 1 if i % 3 == 0 else (None if i % 7 == 0 else rnd.randrange(2, 60))
        count[key] = max(0, count.get(key, 5) + rnd.choice([0, 0, 0, 1, 1, -1]))
        rows.append((key, start + dt.timedelta(seconds=37 * i), count[key] if rnd.random() > 0.05 else None))
    return spark.createDataFrame(rows, "series int, ts timestamp_ntz, n bigint").repartition(8).cache()


def as_set(df):
    return sorted((str(r.asDict(recursive=True)) for r in df.collect()))


@pytest.mark.parametrize("limit", [100, 900])
def test_running_values(samples, limit):
    values = {
        "position": Running("sum", F.lit(1)),
        "total": Running("sum", F.col("n")),
        "high": Running("max", F.col("n")),
        "low": Running("min", F.col("n")),
        "seen": Running("last", F.col("n")),
        "before": Running("last", F.col("n"), before=True),
    }
    split = OrderedSeries.of(samples, ["series"], ["ts"], limit)
    assert split.long is not None
    assert split.long.select("__chunk").distinct().count() > 1
    plain = OrderedSeries.of(samples, ["series"], ["ts"])
    assert plain.long is None
    assert as_set(split.add(values).result()) == as_set(plain.add(values).result())


@pytest.mark.parametrize("reset", ["change", "increase"])
@pytest.mark.parametrize("n", [1, 3, 6])
def test_stable_points(samples, reset, n):
    def found(limit):
        return as_set(sequence.stable_at(samples, ["series"], "ts", "n", n, reset=reset, long_series=limit))

    assert found(100) == found(10**9) == sorted(str(r) for r in brute_stable(samples, n, reset))


def brute_stable(samples, n, reset):
    groups = {}
    for r in sorted(samples.collect(), key=lambda r: r["ts"]):
        groups.setdefault(r["series"], []).append(r)
    out = []
    for key, rows in groups.items():
        last, run = None, 0
        for r in rows:
            if not r["n"]:
                continue
            if last is not None and r["n"] == last:
                run += 1
            elif reset == "change" or last is None or r["n"] > last:
                run = 0
            last = r["n"]
            if run >= n:
                out.append({"series": key, "stable_ts": r["ts"], "stable_value": last})
                break
    return out


def test_stalls(samples):
    whole = samples.where("n is not null")
    found = [as_set(sequence.stalls(whole, ["series"], "ts", "n", 600, long_series=k)) for k in (100, 10**9)]
    assert found[0] == found[1] and found[0]


def test_as_of_join(samples):
    left = samples.where(F.second("ts") % 2 == 0).select("series", "ts")
    right = samples.where(F.second("ts") % 2 == 1).select("series", F.col("ts").alias("rts"), F.col("n").alias("rn"))
    for strict in (False, True):
        a, b = (
            as_set(joins.as_of_join(left, right, "series", "ts", "rts", ["rn"], strict, long_series=k)) for k in (100, 10**9)
        )
        assert a == b and len(a) == left.count()


def test_as_of_join_at_equal_times(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 10, "b"), (1, 10, "c")], "k int, rt int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in joins.as_of_join(left, right, "k", "t", "rt", ["v"]).collect()}
    assert got == {(1, 10): "c", (1, 5): "a", (2, 1): None}
    got = {(r["k"], r["t"]): r["v"] for r in joins.as_of_join(left, right, "k", "t", "rt", ["v"], strict=True).collect()}
    assert got == {(1, 10): "a", (1, 5): None, (2, 1): None}


def test_copies_are_numbered_once_each(spark):
    rows = spark.createDataFrame([(1, "same")] * 500 + [(2, "x")] * 3, "k int, v string").repartition(8)
    got = number_rows(rows, ["k"], ["v"], long_series=100).collect()
    assert sorted(r["position"] for r in got if r["k"] == 1) == list(range(1, 501))
    assert sorted(r["position"] for r in got if r["k"] == 2) == [1, 2, 3]


def test_positions(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("same"))
    got = ordering.with_position(rows.repartition(8), F.col("same"), F.col("v")).collect()
    assert all(r["position"] == r["v"] + 1 for r in got) and len(got) == 1000
