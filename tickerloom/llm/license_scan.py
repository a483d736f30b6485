"""License scans: ordered signature rules behind a keyword prefilter.

The rules (:mod:`license_rules`) are a small table. Each has a keyword that any match holds; a
row meets only the rules whose keywords its text holds, and rows that hold none are done after
one pass. Matches become detections with their places. A detection goes if it lies inside one
of a better priority, or inside an earlier or longer one of its own priority: the rule of
"gpl" says nothing where "gnu general public license, version 3" has matched around it.

Only DataFrame functions. Texts are not shuffled: a stored table holds each row's counts, and
the text where a keyword stands in it; rules come by broadcast (a few hundred rows), and only
detections are sorted, by row and start. Containment is a running maximum of ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.frames import fold, ids_and_texts, materialised
from tickerloom.llm.license_rules import KINDS, Rule, rules

#: Phrases that are counted by themselves, with their labels.
PHRASES = {
    "cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved",
}
PHRASE_WEIGHT = 0.7
#: A word is what stands between characters of this class (A-Z are lower-cased before).
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _phrases(phrases) -> str:
    """Any of the phrases as whole words, whatever stands between them."""
    within = "[^" + APART[1:]
    any_of = "|".join(p.replace(" ", APART + "+") for p in phrases)
    return f"(?<!{within})(?:{any_of})(?!{within})"


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _any(text: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def counted(
    docs: DataFrame, table: list[Rule], phrases: dict[str, str] = PHRASES, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: _row, doc_id, counts and places of the phrases, text if a keyword holds.

    The phrases must not overlap one another. Positions are numbers of words, from 0.
    """
    rows = ids_and_texts(docs, id_col, text_col).select("doc_id", fold(F.col("text")).alias("_t"))
    # ids of this job's rows; the table is stored before they are used
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    text, pattern = F.col("_t"), _phrases(phrases)
    hint = _any(text, sorted({max(p.split(), key=len) for p in phrases}))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "n_words": _words(text),
        "_hits": F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
    })
    rows = rows.withColumn("_around", F.when(F.size("_hits") > 0, F.split(text, pattern, -1)).otherwise(none))
    last = F.element_at("_hits", -1)
    hit = F.size("_hits") > 0
    # a phrase's hits are known by their first word
    labels = F.array_sort(F.array_distinct(F.transform("_hits", lambda h: _label(h, phrases))))
    return rows.select(
        "_row", "doc_id", "n_words", F.size("_hits").cast("long").alias("n_base"),
        F.when(hit, _words(F.get("_around", F.lit(0)))).alias("first_word"),
        F.when(hit, F.col("n_words") - _words(F.element_at("_around", -1)) - _words(last)).alias("last_word"),
        labels.alias("base"), F.when(_any(text, sorted({r.keyword for r in table})), text).alias("_t"),
    )


def _label(hit: Column, phrases: dict[str, str]) -> Column:
    first = F.regexp_extract(hit, WORD, 0)
    out = F.lit(None).cast("string")
    for phrase, label in phrases.items():
        out = F.when(first == phrase.split()[0], F.lit(label)).otherwise(out)
    return out


def detections(rows: DataFrame, table: list[Rule]) -> DataFrame:
    """``_row, order, priority, label, weight, start, end``: every match of every rule in ``_row, _t``."""
    spark = rows.sparkSession
    rule_rows = spark.createDataFrame(
        [(r.order, r.priority, r.label, r.keyword, r.pattern, r.weight) for r in table],
        "`order` int, priority int, label string, keyword string, pattern string, weight double",
    )
    keywords = sorted({r.keyword for r in table})
    held = F.array_compact(F.array(*[F.when(F.contains("_t", F.lit(k)), F.lit(k)) for k in keywords]))
    gated = rows.where("_t IS NOT NULL").select("_row", "_t", F.explode(held).alias("keyword"))
    # the rules are a fixed list in the code, so their broadcast does not grow
    gated = gated.join(F.broadcast(rule_rows), "keyword").where("_t RLIKE pattern")
    lengths = lambda texts: F.transform(texts, F.char_length)
    found = gated.select(
        "_row", "order", "priority", "label", "weight",
        F.posexplode(F.arrays_zip(
            lengths(F.expr("split(_t, pattern, -1)")).alias("ahead"),
            lengths(F.expr("regexp_extract_all(_t, pattern, 0)")).alias("own"),
        )).alias("_i", "x"),
    ).where("x.own IS NOT NULL")  # the piece after the last match has none
    upto = Window.partitionBy("_row", "order").orderBy("_i")
    end = F.sum(F.col("x.ahead") + F.col("x.own")).over(upto)
    return found.select(
        "_row", "order", "priority", "label", "weight", (end - F.col("x.own")).alias("start"), end.alias("end")
    )


def unsuppressed(found: DataFrame) -> DataFrame:
    """The detections that no better one contains.

    Better is a smaller priority; at the same priority what contains another prevails, of equal
    spans the rule that comes first.
    """
    upto = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = {
        f"_reach{k}": F.max(F.when(F.col("priority") < k, F.col("end"))).over(upto) for k in range(1, len(KINDS))
    }
    same = (
        Window.partitionBy("_row", "priority").orderBy("start", F.desc("end"), "order")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    marked = found.withColumns(reach).withColumn("_same", F.max("end").over(same))
    better = F.lit(None).cast("long")
    for k in range(1, len(KINDS)):
        better = F.when(F.col("priority") == k, F.col(f"_reach{k}")).otherwise(better)
    inside = F.greatest(better, F.col("_same")) >= F.col("end")
    return marked.where(~F.coalesce(inside, F.lit(False))).select(*found.columns)


def license_scan(
    docs: DataFrame, table: list[Rule] | None = None, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    ``n_base`` counts the places of ``phrases``, ``first_word`` and ``last_word`` are the smallest and
    largest number of a word they begin at (null without any), ``base_labels`` their labels;
    ``labels`` also has those of the detections left after suppression, both distinct, sorted
    and comma-joined. ``score`` is the noisy-or of the best weight of each label, to six places.

    Null and empty texts have no words, no labels and a score of 0. Rows that repeat a key, and
    null keys, are rows of their own; other columns are not read; an empty table gives no rows.
    """
    table = rules() if table is None else table
    rows = materialised(counted(docs, table, phrases, id_col, text_col), "license-rows")
    found = unsuppressed(detections(rows, table)).select("_row", "label", "weight")
    base = rows.where("n_base > 0").select(
        "_row", F.explode("base").alias("label"), F.lit(PHRASE_WEIGHT).alias("weight")
    )
    best = found.unionByName(base).groupBy("_row", "label").agg(F.max("weight").alias("weight"))
    # one element a label, so at most as many as there are rules
    labels = best.groupBy("_row").agg(
        F.sort_array(F.collect_set("label")).alias("_labels"),
        F.round(1 - F.exp(F.sum(F.log(1 - F.col("weight")))), 6).alias("score"),
    )
    joined = rows.drop("_t").join(labels, "_row", "left")
    text = lambda c: F.array_join(c, ",")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", text("base").alias("base_labels"),
        F.coalesce(text("_labels"), F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
