"""Filters, projections and schema adapters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def where_all(df: DataFrame, **criteria) -> DataFrame:
    """Keep rows matching every supplied criterion; ``None`` means "no restriction".

    A list or tuple means membership, a ``(low, high)`` under a ``between__`` name a range.
    """
    for name, value in criteria.items():
        if value is None:
            continue
        if name.startswith("between__"):
            df = df.where(F.col(name[len("between__"):]).between(*value))
        elif isinstance(value, (list, tuple)):
            df = df.where(F.col(name).isin(*value))
        else:
            df = df.where(F.col(name) == value)
    return df


def newest_rows(df: DataFrame, n: int, order: str = "date", tie: str = "ticker") -> DataFrame:
    """The newest ``n`` rows of the whole table, returned in ascending order."""
    return df.orderBy(F.col(order).desc(), tie).limit(n).orderBy(order, tie)


def complete_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order; missing ones are NULL, others are dropped."""
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def allowed_columns(df: DataFrame, allowed) -> DataFrame:
    wanted = set(allowed)
    return df.select(*[c for c in df.columns if c in wanted])


def rename_first_wins(df: DataFrame, sources: dict[str, list[str]], keep=()) -> DataFrame:
    """Target columns from the first present source, later sources filling its NULLs."""
    out = [F.col(c) for c in keep]
    for target, names in sources.items():
        found = [F.col(f"`{n}`") for n in names if n in df.columns]
        value = F.coalesce(*found) if found else F.lit(None).cast("double")
        out.append(value.alias(target))
    return df.select(*out)


def drop_null_columns(df: DataFrame, how: str = "all", keep=()) -> DataFrame:
    """Drop columns that are NULL in all (or any) rows.

    The set of surviving columns is part of the schema, so one aggregate row of counts is
    fetched: one value per column, whatever the table size.
    """
    candidates = [c for c in df.columns if c not in keep]
    row = df.agg(
        F.count(F.lit(1)).alias("_all"), *[F.count(f"`{c}`").alias(c) for c in candidates]
    ).first()
    dead = {c for c in candidates if (row[c] == 0 if how == "all" else row[c] < row["_all"])}
    return df.select(*[c for c in df.columns if c not in dead])


def coverage_of_columns(df: DataFrame, columns) -> DataFrame:
    """One row per column: rows, non-null rows, percentage; a single pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f"`{c}`").alias(c) for c in columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("non_null")) for c in columns]
    )
    return counts.select(F.col("_rows").alias("rows"), F.inline(pairs)).withColumn(
        "pct", F.try_divide(F.col("non_null") * F.lit(100.0), F.col("rows"))
    )


def year_to_date(df: DataFrame, as_of: Column, date: str = "date") -> DataFrame:
    return df.where((F.col(date) >= F.trunc(as_of, "year")) & (F.col(date) <= as_of))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def table_counts(tables: dict[str, DataFrame], key: str = "ticker") -> DataFrame:
    """Rows and distinct keys of several tables."""
    parts = [
        t.agg(
            F.lit(name).alias("table"),
            F.count(F.lit(1)).alias("rows"),
            F.countDistinct(key).alias("tickers"),
        )
        for name, t in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def split_by_membership(df: DataFrame, marked: DataFrame, key: str, flag: str) -> DataFrame:
    """All rows with a boolean telling whether their key is in ``marked``."""
    hits = marked.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(hits, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def first_owner(listing: DataFrame, symbol: str, owner: str, position: str) -> DataFrame:
    """A symbol listed by several owners belongs to the one with the lowest position."""
    w = Window.partitionBy(symbol).orderBy(position, owner)
    return (
        listing.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
    )


def rank_rows(df: DataFrame, by: str, keys=(), tie: str = "ticker", name: str = "rank") -> DataFrame:
    """1-based rank by a descending value inside each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), F.col(tie))
    return df.withColumn(name, F.row_number().over(w))


def top_k(df: DataFrame, by: Column, k: int, tie: str = "ticker") -> DataFrame:
    return df.orderBy(by.desc_nulls_last(), tie).limit(k)


def chronological_parts(df: DataFrame, key: str = "ticker", order: str = "date",
                        val: float = 0.2, test: float = 0.1, hold: float = 0.05) -> DataFrame:
    """Label rows per key as train / val / test, the newest ones as predict."""
    w = Window.partitionBy(key)
    rn = F.row_number().over(w.orderBy(order))
    n = F.count(F.lit(1)).over(w)
    body = F.col("_n") - F.ceil(F.lit(hold) * F.col("_n"))
    part = (
        F.when(F.col("_rn") > body, "predict")
        .when(F.col("_rn") <= F.floor(body * F.lit(1.0 - test - val)), "train")
        .when(F.col("_rn") <= F.floor(body * F.lit(1.0 - test)), "val")
        .otherwise("test")
    )
    return (
        df.withColumns({"_rn": rn, "_n": n}).withColumn("split", part).drop("_rn", "_n")
    )
