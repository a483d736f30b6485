"""First-order linear recurrences (exponential means) as window expressions.

``e_t = a * e_(t-1) + (1 - a) * x_t`` with ``e_1 = x_1`` is not a Spark aggregate. Rows
are cut into blocks of consecutive rows of a ticker. Inside a block
``local = a^q * sum(b_j * a^-q_j)`` is a plain running sum; the state carried in from the
block before is ``a^(q+1) * L`` with ``L`` the local value at its last row (and, for very
slow decays, ``a^B`` times the one before that, and so on until double precision cannot
notice). Terms of one sign are only added, so the result agrees with the direct recursion
to a few ulps.

Fast decays would overflow ``a^-q`` in a large block, so two nested block sizes are used.
One sort by (ticker, block, sub-block, date) serves every window here; no join, no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickerloom.functions.windows import as_col

BLOCK = 4096
SUB_BLOCK = 1024
_LOG_RANGE = 575.0  # a^-B stays below 1e250
_LOG_PRECISION = 36.8  # a^m below 2^-53


@dataclass(frozen=True)
class Decay:
    """One recurrence: source column, smoothing factor, rows before it is shown."""

    source: str | Column
    alpha: float
    warmup: int = 1

    def __post_init__(self):
        if not 0.0 < self.alpha < 1.0:
            raise ValueError(f"smoothing factor must lie in (0, 1): {self.alpha}")

    @classmethod
    def span(cls, source, n: int, warmup: int | None = None) -> "Decay":
        return cls(source, 2.0 / (n + 1.0), n if warmup is None else warmup)

    @classmethod
    def wilder(cls, source, n: int, warmup: int | None = None) -> "Decay":
        return cls(source, 1.0 / n, n if warmup is None else warmup)

    @property
    def retention(self) -> float:
        return 1.0 - self.alpha

    @property
    def rate(self) -> float:
        return -math.log(self.retention)

    @property
    def fast(self) -> bool:
        return self.rate * BLOCK > _LOG_RANGE


def sub_block(decays) -> int:
    """Largest power of two up to ``SUB_BLOCK`` in which no decay overflows."""
    size = SUB_BLOCK
    while size > 1 and any(d.rate * size > _LOG_RANGE for d in decays):
        size //= 2
    return size


class Series:
    """A frame whose rows are numbered and blocked per key, ready for recurrences."""

    def __init__(self, df: DataFrame, decays=(), key: str = "ticker", order: str = "date"):
        self.key, self.order = key, order
        self.sub = sub_block(list(decays))
        rn = F.row_number().over(Window.partitionBy(key).orderBy(order))
        pos = F.col("_rn") - 1
        self.df = (
            df.withColumn("_rn", rn)
            .withColumn("_blk", F.floor(pos / F.lit(BLOCK)).cast("int"))
            .withColumn("_sub", F.floor((pos % F.lit(BLOCK)) / F.lit(self.sub)).cast("int"))
            .withColumn("_q", (pos % F.lit(BLOCK)).cast("double"))
            .withColumn("_p", (pos % F.lit(self.sub)).cast("double"))
        )

    @property
    def window(self) -> WindowSpec:
        """Date order, written so that it shares the blocked sort."""
        return Window.partitionBy(self.key).orderBy("_blk", "_sub", self.order)

    def _level(self, d: Decay):
        if d.fast:
            w = Window.partitionBy(self.key, "_blk", "_sub").orderBy(self.order)
            return w, F.col("_p"), self.sub
        w = Window.partitionBy(self.key, "_blk").orderBy("_sub", self.order)
        return w, F.col("_q"), BLOCK

    def local_sums(self, decays: dict[str, Decay]) -> dict[str, Column]:
        """First step: the block-local parts, as window columns to add."""
        out = {}
        for name, d in decays.items():
            w, q, _ = self._level(d)
            a = F.lit(d.retention)
            x = as_col(d.source)
            inflow = F.when(F.col("_rn") == 1, x).otherwise(F.lit(1.0 - d.retention) * x)
            total = F.sum(inflow * F.pow(a, -q)).over(w.rowsBetween(Window.unboundedPreceding, 0))
            out[f"_l_{name}"] = F.pow(a, q) * total
        return out

    def carries(self, decays: dict[str, Decay], step: int = 1) -> dict[str, Column]:
        """Second step: the state at the end of the ``step``-th block back."""
        before = self.window.rowsBetween(Window.unboundedPreceding, -1)
        out = {}
        for name, d in decays.items():
            if step > self.depth(d):
                continue
            _, q, size = self._level(d)
            source = F.col(f"_l_{name}" if step == 1 else f"_c{step - 1}_{name}")
            out[f"_c{step}_{name}"] = F.last(F.when(q == size - 1, source), True).over(before)
        return out

    def depth(self, d: Decay) -> int:
        size = self.sub if d.fast else BLOCK
        return max(1, math.ceil(_LOG_PRECISION / (size * d.rate)))

    def max_depth(self, decays: dict[str, Decay]) -> int:
        return max((self.depth(d) for d in decays.values()), default=0)

    def values(self, decays: dict[str, Decay], masked: bool = True) -> dict[str, Column]:
        """Last step: local part plus decayed carry, NULL before the warm-up."""
        out = {}
        for name, d in decays.items():
            _, q, size = self._level(d)
            a = d.retention
            state = F.coalesce(F.col(f"_c1_{name}"), F.lit(0.0))
            for step in range(2, self.depth(d) + 1):
                weight = F.lit(a ** (size * (step - 1)))
                state = state + weight * F.coalesce(F.col(f"_c{step}_{name}"), F.lit(0.0))
            value = F.col(f"_l_{name}") + F.pow(F.lit(a), q + F.lit(1.0)) * state
            out[name] = F.when(F.col("_rn") >= d.warmup, value) if masked and d.warmup > 1 else value
        return out

    def smooth(self, df: DataFrame, decays: dict[str, Decay], masked: bool = True) -> DataFrame:
        """All three steps on ``df`` (a frame derived from ``self.df``)."""
        keep = [c for c in df.columns if c not in decays]
        df = df.withColumns(self.local_sums(decays))
        for step in range(1, self.max_depth(decays) + 1):
            df = df.withColumns(self.carries(decays, step))
        return df.withColumns(self.values(decays, masked)).select(*keep, *decays)


def exponential_means(df: DataFrame, decays: dict[str, Decay], key="ticker", order="date"):
    """Append one exponential mean per entry of ``decays``."""
    series = Series(df, decays.values(), key, order)
    return series.smooth(series.df, decays).select(*df.columns, *decays)
