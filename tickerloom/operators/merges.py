"""Table maintenance as pure merges: old table + change -> new table.

``sources.writers`` makes the result durable. All merges are idempotent: applying the
same change twice gives the same table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.joins import keep_latest


def replace_range(base: DataFrame, new: DataFrame, keys=("ticker",), order: str = "date") -> DataFrame:
    """Drop each key's rows inside the new rows' [min, max] range, then add the new rows."""
    keys = list(keys)
    spans = new.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    kept = (
        base.join(spans, keys, "left")
        .where(F.col("_lo").isNull() | ~F.col(order).between(F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )
    return kept.unionByName(new, allowMissingColumns=True)


def replace_by_key(base: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Drop every row of the keys present in ``new``, then add the new rows."""
    keys = list(keys)
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(
        new, allowMissingColumns=True
    )


def upsert(base: DataFrame, new: DataFrame, keys, precedence=()) -> DataFrame:
    """Insert or replace single rows by key; in-batch duplicates resolve by precedence."""
    unique = keep_latest(new, list(keys), precedence) if precedence else new
    return replace_by_key(base, unique, keys)


def insert_only_new(base: DataFrame, new: DataFrame, keys, precedence) -> DataFrame:
    """Rows of ``new`` (last copy per key) whose key is not stored yet, appended."""
    keys = list(keys)
    unique = keep_latest(new, keys, precedence)
    fresh = unique.join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def append(base: DataFrame, new: DataFrame) -> DataFrame:
    return base.unionByName(new, allowMissingColumns=True)


def delete_from(base: DataFrame, starts: DataFrame, start: str = "from_date",
                key: str = "ticker", order: str = "date") -> tuple[DataFrame, DataFrame]:
    """Drop rows at or after each key's start date; also the number dropped per key."""
    marked = base.join(starts.select(key, start), key, "left")
    gone = F.coalesce(F.col(order) >= F.col(start), F.lit(False))
    kept = marked.where(~gone).drop(start)
    counts = marked.where(gone).groupBy(key).agg(F.count(F.lit(1)).alias("deleted"))
    return kept, counts


def cascade_delete(tables: dict[str, DataFrame], keys: DataFrame, key: str = "ticker"):
    """Every table without the rows of ``keys``, and how many rows each one lost."""
    doomed = keys.select(key).distinct()
    kept = {name: t.join(doomed, key, "left_anti") for name, t in tables.items()}
    counts = reduce(
        DataFrame.unionByName,
        [
            t.join(doomed, key, "left_semi").agg(
                F.lit(name).alias("table"), F.count(F.lit(1)).alias("deleted")
            )
            for name, t in tables.items()
        ],
    )
    return kept, counts


def set_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    """Overwrite columns on matching rows only."""
    return df.withColumns(
        {
            name: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(name))
            for name, v in values.items()
        }
    )


def patch_non_null(base: DataFrame, patch: DataFrame, keys) -> DataFrame:
    """Overwrite columns by the patch's non-null values; other rows and columns stay."""
    keys = list(keys)
    cols = [c for c in patch.columns if c not in keys]
    side = patch.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in cols])
    joined = base.join(side, keys, "left")
    return joined.select(
        *[F.coalesce(f"_p_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns]
    )
