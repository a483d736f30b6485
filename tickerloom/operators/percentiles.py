"""Exact percentiles of groups of any size, by counted sub-ranges.

Spark's exact ``percentile`` keeps a group's distinct values in one task. Here a group is a
cell of values that is cut again and again. A sketch (bounded memory, merged map-side) names
pivots of the cell; one counting pass says how many values lie between neighbouring pivots and
on each of them, which tells where every wanted rank lies. A rank on a pivot is answered. The
others go on inside their sub-range, which becomes the next cell, until a cell has at most
``most`` values; only those are sorted. A pivot's copies never go on, so ties cannot hold the
search up, and pivots that miss a rank only make its next cell larger: the result is exact
whatever the sketch says.

The input is derived once and stored; passes after the first read the cells alone. Pivots and
counts (some numbers per cell) meet the rows in equi-joins, which Spark broadcasts while they
are small and splits where a key is hot.
The result is the linearly interpolated percentile, as NumPy and SQL ``quantile_cont``
define it. NULL values are ignored, NaN is the largest value, NULL keys form a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.session import materialised

ACCURACY = 10_000
#: Values of a cell that one task may sort.
MOST = 100_000
#: Pivots of a cell after the first round.
PIVOTS = 63


def _meet(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner",
          also: Column | None = None) -> DataFrame:
    """Join on ``names``, where NULL keys meet each other."""
    right = right.withColumnsRenamed({n: f"_of_{n}" for n in names})
    on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names])
    return left.join(right, on if also is None else on & also, how).drop(*[f"_of_{n}" for n in names])


def _pivots(rows: DataFrame, cell: list[str], shares: list[float], accuracy: int) -> DataFrame:
    wanted = F.array(*[F.lit(q) for q in shares])
    sketch = F.percentile_approx("_v", wanted, F.lit(accuracy))
    return materialised(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), sketch.alias("_x")), "pivots")


def _cut(rows: DataFrame, pivots: DataFrame, cell: list[str], width: int) -> DataFrame:
    """Each value with its sub-range ``_seg``: even ones lie between pivots, odd ones on a pivot."""
    x = [F.get("_x", F.lit(j)) for j in range(width)]
    below = reduce(lambda a, b: a + b, [(p < F.col("_v")).cast("int") for p in x])
    on = reduce(lambda a, b: a | b, [p == F.col("_v") for p in x]).cast("int")
    return _meet(rows, pivots.drop("_n"), cell).withColumn("_seg", 2 * below + on).drop("_x")


def _placed(targets: DataFrame, counts: DataFrame, cell: list[str], order: str) -> DataFrame:
    """Each target with the counted range that holds its rank; the rank is now one within it."""
    w = Window.partitionBy(*cell).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ranges = counts.withColumn("_end", F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))
    holds = (F.col("_start") <= F.col("_k")) & (F.col("_k") < F.col("_end"))
    return _meet(targets, ranges, cell, also=holds).withColumn("_k", F.col("_k") - F.col("_start"))


def _narrowed(rows: DataFrame, pivots: DataFrame, targets: DataFrame, cell: list[str], shares: list[float],
              accuracy: int, most: int) -> tuple[list[DataFrame], DataFrame | None, DataFrame]:
    """Answered targets of each round, the rows of the last cells (None: no target is open), open targets."""
    answered = []
    while True:
        cut = _cut(rows, pivots, cell, len(shares))
        counts = cut.groupBy(*cell, "_seg").agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        inner = F.concat_ws(".", "_cell", F.col("_seg").cast("string"))
        placed = _placed(targets, counts, cell, "_seg").withColumn("_cell", inner)
        value = F.when(F.col("_least") == F.col("_most"), F.col("_least"))
        placed = materialised(placed.withColumn("_value", value).drop("_seg", "_end", "_start", "_least", "_most"), "ranks")
        answered.append(placed.where("_value IS NOT NULL").drop("_c"))
        targets = placed.where("_value IS NULL").drop("_value")
        left = targets.agg(F.max("_c")).first()[0]  # one number: the largest cell
        targets = targets.drop("_c")
        if left is None:
            return answered, None, targets
        rows = _meet(cut.withColumn("_cell", inner).drop("_seg"), targets.select(*cell).distinct(), cell, "left_semi")
        if left <= most:
            return answered, rows, targets
        rows = materialised(rows, "cells")
        shares = [j / (PIVOTS + 1) for j in range(1, PIVOTS + 1)]
        pivots = _pivots(rows, cell, shares, accuracy)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                      accuracy: int = ACCURACY, most: int = MOST) -> DataFrame:
    """One row per key with a column per entry of ``probs``."""
    cell = [*keys, "_cell"]
    rows = df.select(*keys, F.lit("").alias("_cell"), F.col(value).cast("double").alias("_v"))
    rows = materialised(rows.where(F.col("_v").isNotNull()), "values")
    slack = 2.0 / accuracy
    shares = sorted({min(1.0, max(0.0, q)) for p in probs.values() for q in (p - slack, p + slack)})
    pivots = _pivots(rows, cell, shares, accuracy)
    pos = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs.values()]
    ends = [
        F.struct(F.lit(i).alias("_i"), F.lit(e).alias("_e"), k.cast("bigint").alias("_k"),
                 (p - F.floor(p)).alias("_frac"))
        for i, p in enumerate(pos) for e, k in enumerate((F.floor(p), F.ceil(p)))
    ]
    targets = pivots.select(*cell, F.inline(F.array(*ends)))
    parts, rows, targets = _narrowed(rows, pivots, targets, cell, shares, accuracy, most)
    if rows is not None:
        counts = rows.groupBy(*cell, "_v").agg(F.count(F.lit(1)).alias("_c"))
        last = _placed(targets, counts, cell, "_v")
        parts.append(last.withColumn("_value", F.col("_v")).drop("_v", "_c", "_end", "_start"))
    found = reduce(DataFrame.unionByName, parts)
    at = lambda i, e: F.max(F.when((F.col("_i") == i) & (F.col("_e") == e), F.col("_value")))
    frac = lambda i: F.max(F.when(F.col("_i") == i, F.col("_frac")))
    return found.groupBy(*keys).agg(*[
        (at(i, 0) + (at(i, 1) - at(i, 0)) * frac(i)).alias(name) for i, name in enumerate(probs)
    ])
