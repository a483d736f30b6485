"""Quality rules as declarations, compiled to one pass over each source.

A source names its rows, the columns to look back at, per-ticker measures and the rules over
rows and measures. Compiled, a source is one scan and one exchange by ticker: the look-back
window and the aggregate share that exchange, and the findings of rows travel as an array
beside the measures. Rules across sources read the measures of all of them, which meet in one
more aggregate of a row per (ticker, source). All findings leave by a single ``inline``.

A ticker's row findings are gathered in one array: no more than its rows, which the look-back
window holds in one task anyway (the calendar bounds them once bars are one a day).
NULL tickers form a group like any other. A rule whose condition is NULL does not hit, and a value
is computed only where its rule hits (a quotient may have no divisor elsewhere).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``value`` is reported where ``hit`` holds; ``table`` is the source's unless given."""

    issue: str
    severity: str
    value: Column
    hit: Column
    table: str | None = None


@dataclass(frozen=True)
class Source:
    """Rows with a ``ticker`` and what is asked of them.

    ``before`` names columns that take a value of the ticker's preceding row by ``order``.
    ``measures`` are aggregates per ticker; rules across sources read them as
    ``measure(source, name)``.
    """

    name: str
    table: str
    rows: DataFrame
    measures: dict[str, Column]
    rules: Sequence[Rule] = ()
    row_rules: Sequence[Rule] = ()
    before: dict[str, str] = field(default_factory=dict)
    order: str | None = None


def measure(source: str, name: str) -> Column:
    """A source's measure in a rule across sources; NULL where it has no row of the ticker."""
    return F.col(f"_{source}_{name}")


def _hits(rules: Sequence[Rule], table: str | None) -> Column:
    """Array of the findings of those rules that hit."""
    cells = [
        F.struct(
            F.lit(r.table or table).alias("table"), F.lit(r.issue).alias("issue"), F.lit(r.severity).alias("severity"),
            F.when(r.hit, r.value.cast("double")).alias("value"), F.coalesce(r.hit, F.lit(False)).alias("hit"),
        )
        for r in rules
    ]
    found = F.filter(F.array(*cells), lambda c: c["hit"])
    return F.transform(found, lambda c: F.struct(
        c["table"].alias("table"), c["issue"].alias("issue"), c["severity"].alias("severity"), c["value"].alias("value")))


def _joined(arrays: list[Column]) -> Column:
    return arrays[0] if len(arrays) == 1 else F.concat(*arrays)


def compiled(source: Source) -> DataFrame:
    """One row per ticker: its findings in this source as ``_found`` and the measures."""
    rows = source.rows
    if source.before:
        w = Window.partitionBy("ticker").orderBy(source.order)
        rows = rows.withColumns({n: F.lag(c).over(w) for n, c in source.before.items()})
    parts, gathered = [], []
    if source.row_rules:
        rows = rows.withColumn("_hits", _hits(source.row_rules, source.table))
        hit = F.when(F.size("_hits") > 0, F.col("_hits"))
        gathered = [F.flatten(F.collect_list(hit)).alias("_of_rows")]
        parts.append(F.col("_of_rows"))
    each = rows.groupBy("ticker").agg(*[m.alias(n) for n, m in source.measures.items()], *gathered)
    if source.rules:
        parts.append(_hits(source.rules, source.table))
    return each.select(
        "ticker", *([_joined(parts).alias("_found")] if parts else []),
        *[F.col(n).alias(f"_{source.name}_{n}") for n in source.measures],
    )


def findings(sources: Sequence[Source], across: Sequence[Rule] = ()) -> DataFrame:
    """All issues ``(ticker, table, issue, severity, value)`` of the sources and across them."""
    rows = [compiled(s) for s in sources]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    names = [c for c in every.columns if c not in ("ticker", "_found")]
    gathered = F.flatten(F.collect_list("_found"))  # one array a source
    one = every.groupBy("ticker").agg(gathered.alias("_found"), *[F.max(n).alias(n) for n in names])
    parts = [F.col("_found"), *([_hits(across, None)] if across else [])]
    return one.select("ticker", F.inline(_joined(parts)))
