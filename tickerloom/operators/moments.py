"""Rolling sums, deviations and co-moments by merging the windows of earlier rows.

The window of ``n`` rows that ends at a row is a few shorter windows side by side, each of
which ends at this row or at one some rows back. Windows of one row are doubled up to the shortest
one wanted, and longer ones are put together from those that exist: 200 rows are 120 and twice
40. Every row then costs a fixed small number of merges, however long the windows are,
where a sliding frame reads all ``n`` rows again.

A window's state is its sum, or (mean, squares), or for two series (means, squares, products);
states are merged pairwise by the parallel formulas. Nothing is ever subtracted from a running
total, so what has left a window leaves no rounding error behind. Missing rows and NULLs make
the state NULL, which spreads to every window that holds them.

All steps use the window given, so they share its shuffle and sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickerloom.functions.windows import as_col, series

#: Figures kept for a window, by kind.
STATES = {"sum": ("sum",), "spread": ("mean", "squares"), "pair": ("mean_x", "mean_y", "xx", "yy", "xy")}
#: Figures that are zero for a single row.
_DEVIATIONS = ("squares", "xx", "yy", "xy")
MOST_PARTS = 3

#: size of a window and how many rows back it ends
Part = tuple[int, int]


@dataclass(frozen=True)
class Rolling:
    """Windows over ``x`` (and ``y`` for pairs); columns are called ``name_figure_n``."""

    name: str
    x: str | Column
    windows: tuple[int, ...]
    kind: str = "sum"
    y: str | Column | None = None

    def figure(self, figure: str, n: int) -> Column:
        return F.col(f"{self.name}_{figure}_{n}")

    def mean(self, n: int) -> Column:
        if self.kind == "sum":
            return self.figure("sum", n) / F.lit(float(n))
        return self.figure("mean", n)

    def std(self, n: int) -> Column:
        return F.sqrt(self.figure("squares", n) / F.lit(float(n - 1)))


def _parts(n: int, sizes: list[int]) -> list[Part]:
    out, back = [], 0
    for size in sorted(sizes, reverse=True):
        while n - back >= size:
            out.append((size, back))
            back += size
    return out


def merge_plan(windows) -> list[tuple[int, list[Part]]]:
    """Sizes in the order in which they can be built, each with the windows it consists of."""
    sizes, steps = [1], []
    for n in sorted(set(windows) - {1}):
        while len(_parts(n, sizes)) > MOST_PARTS and 2 * sizes[-1] <= n:
            top = sizes[-1]
            steps.append((2 * top, [(top, 0), (top, top)]))
            sizes.append(2 * top)
        steps.append((n, _parts(n, sizes)))
        sizes.append(n)
    return steps


def _merged(a: dict[str, Column], p: int, b: dict[str, Column], q: int) -> dict[str, Column]:
    """State of the ``p`` and ``q`` rows of two windows together."""
    if "sum" in a:
        return {"sum": a["sum"] + b["sum"]}
    share, weight = F.lit(q / (p + q)), F.lit(p * q / (p + q))
    if "mean" in a:
        apart = b["mean"] - a["mean"]
        return {"mean": a["mean"] + apart * share, "squares": a["squares"] + b["squares"] + apart * apart * weight}
    dx, dy = b["mean_x"] - a["mean_x"], b["mean_y"] - a["mean_y"]
    return {
        "mean_x": a["mean_x"] + dx * share,
        "mean_y": a["mean_y"] + dy * share,
        "xx": a["xx"] + b["xx"] + dx * dx * weight,
        "yy": a["yy"] + b["yy"] + dy * dy * weight,
        "xy": a["xy"] + b["xy"] + dx * dy * weight,
    }


def with_moments(df: DataFrame, w: WindowSpec, rolling: list[Rolling]) -> DataFrame:
    """Appends the figures of every window of ``rolling``; the steps of all of them run side by side."""
    if not rolling:
        return df
    keep = list(df.columns)
    single = {"sum": "x", "mean": "x", "mean_x": "x", "mean_y": "y"}
    df = df.withColumns({
        f"{r.name}_{figure}_1": as_col(getattr(r, single[figure])).cast("double")
        for r in rolling for figure in STATES[r.kind] if figure in single
    })
    plans = [(r, merge_plan(r.windows)) for r in rolling]
    for step in range(max(len(plan) for _, plan in plans)):
        earlier: dict[str, Column] = {}
        built: dict[str, Column] = {}
        for r, plan in plans:
            if step >= len(plan):
                continue
            size, parts = plan[step]
            state, held = None, 0
            for rows, back in parts:
                other = {}
                for figure in STATES[r.kind]:
                    source = f"{r.name}_{figure}_{rows}"
                    if rows == 1 and figure in _DEVIATIONS:
                        other[figure] = F.lit(0.0)
                    elif back:
                        earlier[f"{source}_{back}"] = F.lag(source, back).over(w)
                        other[figure] = F.col(f"{source}_{back}")
                    else:
                        other[figure] = F.col(source)
                state = _merged(state, held, other, rows) if state else other
                held += rows
            built |= {f"{r.name}_{figure}_{size}": c for figure, c in state.items()}
        df = df.withColumns(earlier).withColumns(built)
    wanted = [
        f"{r.name}_{figure}_{n}" for r in rolling for n in r.windows for figure in STATES[r.kind]
        if n > 1 or figure not in _DEVIATIONS
    ]
    return df.select(*keep, *dict.fromkeys(wanted))


def rolling_means(df: DataFrame, x, windows: dict[str, int], w: WindowSpec | None = None) -> DataFrame:
    """Appends the mean of the trailing rows under each name; NULL unless all of them hold a value."""
    r = Rolling("_x", x, tuple(windows.values()))
    out = with_moments(df, w or series(), [r])
    return out.select(*df.columns, *[r.mean(n).alias(c) for c, n in windows.items()])


def rolling_stds(df: DataFrame, x, windows: dict[str, int], w: WindowSpec | None = None) -> DataFrame:
    """Appends the sample deviation of the trailing rows under each name."""
    r = Rolling("_x", x, tuple(windows.values()), "spread")
    out = with_moments(df, w or series(), [r])
    return out.select(*df.columns, *[r.std(n).alias(c) for c, n in windows.items()])


def rolling_pairs(df: DataFrame, x, y, n: int, w: WindowSpec | None = None) -> DataFrame:
    """Appends ``cov``, ``corr`` and ``var`` (of x) of the trailing rows; no corr for constant series."""
    r = Rolling("_p", x, (n,), "pair", y)
    out = with_moments(df, w or series(), [r])
    xx, yy, xy = (r.figure(f, n) for f in ("xx", "yy", "xy"))
    rest = F.lit(float(n - 1))
    return out.select(
        *df.columns, (xy / rest).alias("cov"),
        F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy)).alias("corr"), (xx / rest).alias("var"),
    )
