"""As-of joins, newest-row selection and key-set joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.session import dealt, materialised


def keep_latest(df: DataFrame, keys, precedence) -> DataFrame:
    """One row per key: the one greatest in ``precedence``.

    The ``row_number() = 1`` filter lets Spark drop all but one row per key and task
    before the shuffle, so a key with very many copies stays cheap.
    """
    order = [c.desc_nulls_last() for c in precedence]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def keep_first(df: DataFrame, keys, precedence) -> DataFrame:
    """One row per key: the one smallest in ``precedence``."""
    order = [c.asc_nulls_last() for c in precedence]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def last_rows(df: DataFrame, n: int, keys=("ticker",), order="date") -> DataFrame:
    """The newest ``n`` rows of every key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def as_of(
    left: DataFrame,
    right: DataFrame,
    on: str = "date",
    right_on: str = "date",
    key: str = "ticker",
    values: list[str] | None = None,
    matched: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Attach to each left row the newest right row with ``right_on <= on``.

    Both sides are stacked and a running ``last`` carries the right row as one struct, so
    NULL fields of the newest report are kept instead of older values showing through.
    One shuffle by key, no range join. ``matched`` names a column for the matched date.
    ``rows``, where known, is the number of rows of both sides and bounds the tasks' memory.
    """
    return as_of_each(left, [(right, right_on, values, matched)], on, key, rows)


def as_of_each(left: DataFrame, rights, on: str = "date", key: str = "ticker", rows: int | None = None) -> DataFrame:
    """``as_of`` for several right tables ``(right, right_on, values, matched)`` in one shuffle by key and one sort.

    ``values`` and ``matched`` may be None, as in ``as_of``. The values' names must differ.
    """
    stacked = left.select(
        F.col(key),
        F.col(on).alias("_t"),
        F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
    )
    taken = []
    for i, (right, right_on, values, matched) in enumerate(rights):
        values = [c for c in right.columns if c not in (key, right_on)] if values is None else values
        payload = F.struct(F.col(right_on).alias("_at"), *[F.col(c) for c in values])
        marks = right.select(
            F.col(key), F.col(right_on).alias("_t"), F.lit(0).alias("_side"), payload.alias(f"_right{i}")
        )
        stacked = stacked.unionByName(marks, allowMissingColumns=True)
        taken += [F.col(f"_hit{i}.`{c}`").alias(c) for c in values]
        if matched:
            taken.append(F.col(f"_hit{i}._at").alias(matched))
    stacked = stacked if rows is None else dealt(stacked, key, rows=rows)
    w = (
        Window.partitionBy(key)
        .orderBy("_t", "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    hits = {f"_hit{i}": F.last(f"_right{i}", ignorenulls=True).over(w) for i in range(len(rights))}
    filled = stacked.withColumns(hits).where(F.col("_side") == 1)
    # the key itself, so that what follows by key needs no other shuffle
    cols = [F.col(c) if c == key else F.col(f"_left.`{c}`").alias(c) for c in left.columns]
    return filled.select(*cols, *taken)


def patch_empty_columns(base: DataFrame, patch: DataFrame, keys, columns, group="ticker") -> DataFrame:
    """Fill a column from ``patch`` only for groups in which it is entirely NULL."""
    present = base.groupBy(group).agg(*[F.count(c).alias(f"_n_{c}") for c in columns])
    other = patch.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = base.join(present, group).join(other, list(keys), "left")
    out = [
        F.when(F.col(f"_n_{c}") == 0, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c)
        if c in columns
        else F.col(c)
        for c in base.columns
    ]
    return joined.select(*out)


def complete_dates(prices: DataFrame, selected: DataFrame, min_rows: int) -> DataFrame:
    """Long price matrix over the dates on which every kept ticker has a close.

    Tickers of ``selected`` with fewer than ``min_rows`` closes are dropped first. Counts
    are aggregated per date and joined back, so no date is gathered in one task. The rows
    of the selection are written once, as three passes follow.
    """
    usable = materialised(
        prices.where(F.col("close_Price").isNotNull()).join(selected, "ticker", "left_semi"), "selection"
    )
    kept = usable.groupBy("ticker").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows)
    chosen = usable.join(kept.select("ticker"), "ticker", "left_semi")
    full_days = (
        chosen.groupBy("date")
        .agg(F.count("*").alias("_k"))
        .where(F.col("_k") == kept.agg(F.count("*").alias("n")).scalar())
    )
    return chosen.join(full_days.select("date"), "date", "left_semi")


def coverage(universe: DataFrame, tables: dict[str, DataFrame], key="ticker") -> DataFrame:
    """Which of the required tables lack a ticker, as a sorted array per ticker."""
    required = F.array(*[F.lit(t) for t in tables])
    seen = None
    for name, table in tables.items():
        part = table.select(key).distinct().withColumn("_t", F.lit(name))
        seen = part if seen is None else seen.unionByName(part)
    found = seen.groupBy(key).agg(F.collect_set("_t").alias("_found"))
    none = F.array().cast("array<string>")
    return universe.select(key).join(found, key, "left").select(
        key,
        F.array_sort(F.array_except(required, F.coalesce("_found", none))).alias("missing"),
    )
