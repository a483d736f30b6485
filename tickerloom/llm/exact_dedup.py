"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Each level looks only at the groups that the level before left with more than one row, so
the full text is hashed only where length and beginning agree. Everything is DataFrame code.

Skew: a level's group table comes from map-side counts, and rows meet it in an equi-join on
the level's key, which AQE splits when one key holds most rows; no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.frames import fold, ids_and_texts, materialised

PREFIX = 256
#: Group keys (16 bytes each) up to which the second scan gets them by broadcast.
BROADCAST_KEYS = 500_000
CHEAP = ["n_bytes", "head"]


def _crowded(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")


def _levelled(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    named = ids_and_texts(docs, id_col, text_col).select("doc_id", fold(F.col("text")).alias("_t"))
    return named.select(
        "doc_id",
        F.octet_length("_t").alias("n_bytes"),
        F.xxhash64(F.substring("_t", 1, prefix)).alias("head"),
        "_t",
    )


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX,
    digest: bool = False, broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept; with ``digest`` also text_sha256.

    Texts are equal when they agree after lower-casing A-Z; null is the empty text. The row
    with the largest doc_id of a group stays. Rows that repeat that doc_id and text are all
    marked kept (``exact_dedup`` lets one of them through); a null doc_id is smaller than any
    other, and a group of nulls only keeps null. An empty table gives an empty result. Other
    columns of ``docs`` are not read, so their names cannot clash.
    """
    scan = _levelled(docs, id_col, text_col, prefix)
    cheap = materialised(scan.select("doc_id", *CHEAP), "dedup-heads")
    crowded = _crowded(cheap.join(_crowded(cheap, ["n_bytes"]), "n_bytes", "left_semi"), CHEAP)
    crowded = materialised(crowded.withColumn("_hit", F.lit(True)), "dedup-levels")
    sha = F.sha2("_t", 256)
    if crowded.count() <= broadcast_keys:
        # the text is hashed in full only where length and beginning met a twin
        rows = scan.join(F.broadcast(crowded), CHEAP, "left").select(
            "doc_id", *CHEAP, "_hit", F.when(F.col("_hit"), sha).alias("_full"),
            *([sha.alias("text_sha256")] if digest else []),
        )
    else:
        # too many keys to broadcast: hash in the scan rather than shuffle texts to the keys
        rows = scan.select("doc_id", *CHEAP, sha.alias("_full"))
        if digest:
            rows = rows.withColumn("text_sha256", F.col("_full"))
        rows = rows.join(crowded, CHEAP, "left")
    rows = materialised(rows, "dedup-rows")
    keys = [*CHEAP, "_full"]
    groups = rows.where("_hit").groupBy(*keys).agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    more = ["text_sha256"] if digest else []
    together = rows.where("_hit").join(groups, keys).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), *more,
    )
    alone = rows.where("_hit IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), *more,
    )
    return together.unionByName(alone)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row keeps; all columns stay.

    Of rows that repeat one doc_id with one text, a single row stays; of rows that share a
    doc_id but not the text, each stays or goes with its own group. Null doc_ids are compared
    null-safely. Columns may have any names.
    """
    names = docs.columns
    groups = materialised(duplicate_groups(docs, id_col, text_col), "dedup-groups")
    docs = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    id_col, text_col = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    same = F.col(id_col).eqNullSafe
    # written, so that their own size decides the join: few keys do not shuffle the texts
    dropped = groups.where("NOT kept").select(F.col("doc_id").alias("_drop")).distinct()
    dropped = materialised(dropped, "dedup-dropped")
    twice = groups.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1")
    twice = materialised(twice.select(F.col("doc_id").alias("_twice")), "dedup-twice")
    unique = docs.join(dropped, same(F.col("_drop")), "left_anti")
    if twice.isEmpty():
        return unique.toDF(*names)
    # rows that repeat a doc_id are settled by their texts
    unique = unique.join(twice, same(F.col("_twice")), "left_anti")
    again = docs.join(twice, same(F.col("_twice")), "left_semi").withColumn(
        "_sha", F.sha2(fold(F.coalesce(F.col(text_col), F.lit(""))), 256)
    )
    texts = again.select("_sha").distinct()
    keep = (
        ids_and_texts(docs, id_col, text_col)
        .select("doc_id", F.sha2(fold(F.col("text")), 256).alias("_sha"))
        .join(texts, "_sha", "left_semi")
        .groupBy("_sha").agg(F.max("doc_id").alias("_keep"))
    )
    again = again.join(keep, "_sha").where(same(F.col("_keep"))).dropDuplicates(["_sha"])
    return unique.unionByName(again.select(*docs.columns)).toDF(*names)
