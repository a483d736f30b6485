"""Bounded, repeatable training samples and the fold rule of the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the key as text modulo ``folds``; a null key counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % folds).cast("int")


#: Characters of one label that a sample brings to the driver, beyond its first text.
CHARACTERS = 20_000_000


def ranked_sample(hashes: DataFrame, label: str, most: Column, longest: int, characters: int = CHARACTERS) -> DataFrame:
    """Of rows (label, _h, _n characters) the first ``most`` of each label, whatever their length.

    Texts of up to ``longest`` characters come first, in the order of their hash, then the
    longer ones, the shortest first, while all together have at most ``characters``; the first
    text of a label is always taken, so that no label is left without one.
    """
    order = Window.partitionBy(label).orderBy(F.greatest("_n", F.lit(longest)), "_h")
    chosen = hashes.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    so_far = F.sum(F.col("_n").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return chosen.withColumn("_sum", so_far).where((F.col("_sum") <= characters) | (F.col("_r") == 1)).drop("_r", "_sum", "_n")


def sample_per_label(rows: DataFrame, label: str, most: int, longest: int, characters: int = CHARACTERS) -> DataFrame:
    """At most ``most`` distinct texts of each label, chosen by :func:`ranked_sample`.

    The sample fits the driver: labels x ``characters``, or one text of a label.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    rows = rows.select(label, "text", F.xxhash64("text").alias("_h"), F.char_length("text").alias("_n"))
    hashes = rows.groupBy(label, "_h").agg(F.max("_n").alias("_n"))
    # labels x most hashes, so a broadcast of bounded size; copies fall together in each task
    chosen = ranked_sample(hashes, label, F.lit(most), longest, characters)
    found = rows.join(F.broadcast(chosen), [label, "_h"], "left_semi")
    return found.groupBy(label, "_h").agg(F.first("text").alias("text")).select(label, "text")
