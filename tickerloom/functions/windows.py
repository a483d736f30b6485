"""Window building blocks shared by every time-series operator.

A bar table has one row per (ticker, date); that key contract (checked by
``quality.duplicate_rows`` and enforced by ``joins.keep_latest``) bounds a ticker's
window partition by the number of calendar days, however skewed the raw input is.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(keys=("ticker",), order=("date",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def trailing(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or series()).rowsBetween(-(n - 1), 0)


def running(w: WindowSpec | None = None) -> WindowSpec:
    return (w or series()).rowsBetween(Window.unboundedPreceding, 0)


def as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def previous(x, n: int = 1, w: WindowSpec | None = None) -> Column:
    return as_col(x) if n == 0 else F.lag(as_col(x), n).over(w or series())


def pct_change(x, n: int = 1, w: WindowSpec | None = None) -> Column:
    x = as_col(x)
    return F.try_divide(x, F.lag(x, n).over(w or series())) - F.lit(1.0)


def forward_fill(x, w: WindowSpec | None = None) -> Column:
    return F.last(as_col(x), ignorenulls=True).over(running(w))


def backward_fill(x, keys=("ticker",), order=("date",)) -> Column:
    """Next known value. Runs over the reversed order: a frame reaching to the end of the
    partition would rescan the rest of it for every row."""
    reversed_order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return F.last(as_col(x), ignorenulls=True).over(running(reversed_order))
