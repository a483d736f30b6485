"""Percentiles by counted sub-ranges: bounded last cells, ties, NULL keys, NaN."""

import math

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import percentiles as pc

PROBS = {"p1": 0.01, "p50": 0.5, "p84": 0.84, "p100": 1.0}


def sorted_percentile(xs, p):
    xs = sorted(xs)
    pos = p * (len(xs) - 1)
    lo, hi = xs[math.floor(pos)], xs[math.ceil(pos)]
    return lo + (hi - lo) * (pos - math.floor(pos))


def test_last_cells_of_one_large_group_are_bounded(spark, monkeypatch):
    n = 5_000_000
    shuffled = F.pmod(F.col("id") * 2_654_435_761, F.lit(n))  # every number below n once
    df = spark.range(n).select(F.lit("g").alias("g"), shuffled.cast("double").alias("v"))
    seen = {}
    narrowed = pc._narrowed

    def watched(*args):
        parts, rows, targets = narrowed(*args)
        cells = rows.groupBy("g", "_cell").count()
        seen["rounds"], seen["largest"] = len(parts), cells.agg(F.max("count")).first()[0]
        return parts, rows, targets

    monkeypatch.setattr(pc, "_narrowed", watched)
    got = pc.exact_percentiles(df, ["g"], "v", PROBS, accuracy=50, most=3000).first()
    assert seen["rounds"] > 1 and 0 < seen["largest"] <= 3000
    assert [got[k] for k in PROBS] == pytest.approx([p * (n - 1) for p in PROBS.values()])


@pytest.mark.parametrize("most", [1, 40])
def test_ties_do_not_hold_the_search_up(spark, most):
    values = [7.0] * 3000 + [7.5] * 2000 + [i / 10 for i in range(300)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    got = pc.exact_percentiles(df, ["g"], "v", PROBS, accuracy=10, most=most).first()
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(sorted_percentile(values, p))


def test_null_keys_null_values_nan_and_empty_tables(spark):
    nan = float("nan")
    rows = [(None, 1, 1.0), (None, 1, 3.0), ("a", None, 5.0), ("a", None, None), ("b", 2, nan), ("b", 2, 1.0), ("c", 3, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    got = {(r["g"], r["h"]): r["m"] for r in pc.exact_percentiles(df, ["g", "h"], "v", {"m": 0.5}).collect()}
    assert got.keys() == {(None, 1), ("a", None), ("b", 2)}
    assert got[None, 1] == 2.0 and got["a", None] == 5.0 and math.isnan(got["b", 2])
    assert pc.exact_percentiles(df.limit(0), ["g", "h"], "v", {"m": 0.5}).collect() == []
