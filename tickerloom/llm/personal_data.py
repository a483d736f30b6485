"""Personal data: validated patterns as seeds, and bootstrapped contextual extraction.

Four base kinds are found by regular expressions and checked (octets, Luhn, digit counts).
They seed a bootstrap: the words before each entity are lexical patterns; patterns and the
values seen after them form a bipartite graph, and scores flow over it a few times: a pattern
is as good as the mean score of its values, a value as its patterns together. Patterns that
end above a high confidence, with enough different seeds, mark look-alike values (shapes of
the same kind that fail the check or are written otherwise) as further identifiers.

Only DataFrame functions. Texts are read once and never shuffled: a stored table holds the
spans and contexts of each row; the graph is built from map-side counts, so a context or a
value that a third of all rows share costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.frames import materialised

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. A match begins where a run begins or where the match before ended, which
#: is where the leftmost match begins; possessive repeats match the same without backtracking.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Look-alikes of each kind, candidates for the bootstrap (cards: the base matches that fail).
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[.-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z.-])",
}
#: What a text must hold before the pattern is tried at all.
HINT = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.instr(t, "+") > 0,
}
LOOSE_HINT = {
    "email": lambda t: t.rlike(r"[(\[{]at[)\]}]"),
    "ip": lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    "phone": lambda t: t.rlike(r"[0-9)][ .-]?[0-9]{3,4}[ .-][0-9]{3}"),
}
CONTEXT = 48
RUN = 256
CONFIDENCE = 0.9
SUPPORT = 5
ROUNDS = 3


def _parts(text: Column, kind: str, patterns: dict, hints: dict) -> tuple[Column, Column]:
    """All matches of the kind, and the texts around them (one more)."""
    none = F.array().cast("array<string>")
    hint = hints[kind](text)
    found = F.when(hint, F.expr("regexp_extract_all(_t, r'{}', 0)".format(patterns[kind]))).otherwise(none)
    around = F.when(hint, F.split(text, patterns[kind], -1)).otherwise(none)
    return found, around


def _located(found: str, around: str) -> Column:
    """structs (at, to, value, left) of the matches; positions in code points, end exclusive."""
    kind = "array<struct<at:int,to:int,value:string,left:string>>"
    # a list is appended to within runs of RUN matches only, and the runs are joined at the end
    run = f"""aggregate(
        sequence(r * {RUN}, least(size({found}), (r + 1) * {RUN}) - 1),
        named_struct('at', acc.at, 'out', CAST(array() AS {kind})),
        (s, i) -> named_struct(
          'at', s.at + char_length({around}[i]) + char_length({found}[i]),
          'out', concat(s.out, array(named_struct(
            'at', s.at + char_length({around}[i]),
            'to', s.at + char_length({around}[i]) + char_length({found}[i]),
            'value', {found}[i], 'left', right({around}[i], {CONTEXT}))))))"""
    return F.expr(f"""
      CASE WHEN size({found}) = 0 THEN array() ELSE aggregate(
        sequence(0, CAST((size({found}) - 1) / {RUN} AS INT)),
        named_struct('at', 0, 'out', CAST(array() AS array<{kind}>)),
        (acc, r) -> transform(array({run}),
          x -> named_struct('at', x.at, 'out', concat(acc.out, array(x.out))))[0],
        acc -> flatten(acc.out)) END""").cast(kind)


_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL: the digits pass the Luhn check."""
    digit = f"CAST(substring({digits}, char_length({digits}) - i, 1) AS INT)"
    return f"""aggregate(sequence(0, char_length({digits}) - 1), 0, (s, i) -> s + CASE
        WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END) % 10 = 0"""


VALID = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), p -> char_length(ltrim('0', p)) <= 3 AND CAST(right(p, 3) AS INT) <= 255)",
    "card": f"char_length({_DIGITS}) BETWEEN 13 AND 19 AND {_luhn(_DIGITS)}",
    "phone": f"char_length({_DIGITS}) BETWEEN 9 AND 15",
}


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _row, doc_id, base spans of each kind, and look-alikes.

    Base matches are leftmost and do not overlap within a kind; failing ones are dropped and
    not tried again. Look-alikes that touch a base span of any kind are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    # ids of this job's rows; the table is stored before they are used
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    text = F.col("_t")
    columns: dict[str, Column] = {}
    for kind in KINDS:
        columns[f"{kind}_f"], columns[f"{kind}_a"] = _parts(text, kind, BASE, HINT)
    for kind in LOOSE:
        columns[f"{kind}_lf"], columns[f"{kind}_la"] = _parts(text, kind, LOOSE, LOOSE_HINT)
    rows = rows.withColumns(columns)
    rows = rows.select(
        "_row", "doc_id",
        *[_located(f"{k}_f", f"{k}_a").alias(f"{k}_all") for k in KINDS],
        *[_located(f"{k}_lf", f"{k}_la").alias(f"{k}_loose") for k in LOOSE],
    )
    rows = rows.select(
        "*", *[F.expr(f"filter({k}_all, x -> {VALID[k]})").alias(k) for k in KINDS],
        F.expr(f"filter(card_all, x -> char_length({_DIGITS}) BETWEEN 13 AND 19 AND NOT ({_luhn(_DIGITS)}))")
        .alias("card_loose"),
    )
    base = F.concat(*[F.col(k) for k in KINDS])
    rows = rows.withColumn("_base", base)
    free = "filter({}_loose, x -> NOT exists(_base, b -> b.at < x.to AND x.at < b.to))"
    return rows.select("_row", "doc_id", *KINDS, *[F.expr(free.format(k)).alias(f"{k}_loose") for k in KINDS])


def occurrences(spans: DataFrame) -> DataFrame:
    """_row, kind, at, to, value, seed, pattern: every entity and look-alike with its contexts.

    A context is the last word before the value, and the last two; without one there is no
    pattern. Words are lower-cased.
    """
    both = F.concat(*[
        F.expr(f"transform({column}, x -> named_struct('kind', '{k}', 'seed', {seed}, 'at', x.at, 'to', x.to, "
               "'value', lower(x.value), 'left', lower(x.left)))")
        for k in KINDS for column, seed in ((k, "true"), (f"{k}_loose", "false"))
    ])
    rows = spans.select("_row", F.explode(both).alias("x")).select("_row", "x.*")
    # values end where their left text ends; a word glued to the value is no context
    two = F.regexp_extract("left", r"(\S+\s+\S+)\s+$", 1)
    one = F.regexp_extract("left", r"(\S+)\s+$", 1)
    rows = rows.withColumn("pattern", F.explode(F.array_distinct(F.array(one, two))))
    return rows.where("pattern != ''").drop("left")


def scored_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, pattern, confidence, seeds (distinct seed values) over the pattern-value graph."""
    edges = materialised(
        found.groupBy("kind", "pattern", "value").agg(F.max(F.col("seed").cast("double")).alias("seed")), "pii-edges"
    )
    values = edges.select("kind", "value", F.col("seed").alias("score"), "seed").distinct()
    for k in range(rounds):
        on = edges.drop("seed").join(values.select("kind", "value", "score", "seed"), ["kind", "value"])
        patterns = on.groupBy("kind", "pattern").agg(
            F.avg("score").alias("confidence"), F.sum("seed").alias("seeds")
        )
        if k == rounds - 1:
            return patterns
        # a pattern's word counts for a value only so far as several seeds stand behind it
        weight = F.col("confidence") * (1 - F.pow(F.lit(0.5), F.col("seeds")))
        back = edges.join(patterns.select("kind", "pattern", weight.alias("weight")), ["kind", "pattern"])
        values = back.groupBy("kind", "value").agg(
            F.max("seed").alias("seed"),
            (1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("weight")))))).alias("flow"),
        )
        values = values.select(
            "kind", "value", F.when(F.col("seed") > 0, F.lit(1.0)).otherwise(F.col("flow")).alias("score"), "seed"
        )
        values = materialised(values, "pii-values")
    return patterns


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["at"], x["to"]))


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: float = CONFIDENCE,
    support: int = SUPPORT, rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row.

    Counts and digest are of the base spans; ``spans`` also lists what trusted patterns found,
    by kind, then start. Null and empty texts have no spans. Null keys and repeated rows are
    rows of their own; other columns are not read. A pattern is trusted at ``confidence`` with
    ``support`` different seed values.
    """
    spans = materialised(found_spans(docs, id_col, text_col), "pii-spans")
    found = occurrences(spans)
    patterns = scored_patterns(found, rounds).where(
        (F.col("confidence") >= confidence) & (F.col("seeds") >= support)
    )
    new = found.where("NOT seed").join(patterns.select("kind", "pattern"), ["kind", "pattern"], "left_semi")
    # spans of one text only, so the list is bounded by the text
    new = new.select("_row", "kind", "at", "to").distinct().groupBy("_row").agg(
        F.collect_list(F.struct("kind", "at", "to")).alias("_new")
    )
    rows = spans.drop(*[f"{k}_loose" for k in KINDS]).join(new, "_row", "left")
    base = F.concat(*[_named(F.col(k), k) for k in KINDS])
    pairs = "transform({}, x -> named_struct('at', x.at, 'to', x.to))"
    every = F.concat(*[
        _named(
            F.array_sort(F.concat(
                F.expr(pairs.format(k)),
                F.coalesce(F.expr(f"transform(filter(_new, x -> x.kind = '{k}'), x -> named_struct('at', x.at, 'to', x.to))"),
                           F.array().cast("array<struct<at:int,to:int>>")),
            )), k)
        for k in KINDS
    ])
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"),
    )
