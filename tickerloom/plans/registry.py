"""Registry of named queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.plans.domain import Domain
from tickerloom.plans.domain_sql import finished


@dataclass(frozen=True)
class Case:
    build: Callable[[Domain], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]


CASES: dict[str, Case] = {}


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register ``fn(domain) -> DataFrame``; ``doubles`` names its double columns."""

    def wrap(fn: Callable[[Domain], DataFrame]):
        if name in CASES:
            raise KeyError(f"query registered twice: {name}")
        CASES[name] = Case(fn, sql, tuple(doubles.split()))
        return fn

    return wrap


def present(df: DataFrame) -> DataFrame:
    """Round doubles to 6 decimals, remove negative zero, widen ints.

    The nudge keeps exact half cases from depending on an engine's rounding mode.
    """
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind == "double":
            c = (F.rint(c * F.lit(1e6) + F.lit(1e-3)) / F.lit(1e6) + F.lit(0.0)).alias(field.name)
        elif kind == "integer":
            c = c.cast("bigint").alias(field.name)
        cols.append(c)
    return df.select(*cols)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(CASES[name].build(Domain(spark, sf_dir)))


def oracle(name: str) -> str | None:
    case = CASES[name]
    return None if case.sql is None else finished(case.sql, case.doubles)
