"""One ridge model per ticker, from grouped normal equations.

A ticker's rows enter only through their (co)moments: one aggregation with map-side
combination gathers those of its training and of its validation rows, so a ticker with many
rows costs each task one row of the shuffle. What then meets in a task is one row of moments
per ticker; whole batches of them are solved at once by Cholesky factors. The strength of a
ticker is the one with the least validation error, which the moments give as well, so the rows
are read once whatever the number of strengths.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRENGTHS = (0.01, 0.1)
PARTS = ("train", "val")


def moments(rows: DataFrame, features: Sequence[str], target: str = "y") -> DataFrame:
    """ticker and, for each of PARTS, count, means and population (co)variances.

    ``*_xx`` holds the upper triangle row by row. Rows with a null feature or target are left out.
    """
    k = len(features)
    rows = rows.na.drop(subset=[*features, target])
    aggs: list[Column] = []
    for part in PARTS:
        x = [F.when(F.col("split") == part, F.col(c)) for c in (*features, target)]
        xx = [F.covar_pop(x[i], x[j]) for i in range(k) for j in range(i, k)]
        aggs += [
            F.count(x[k]).alias(f"{part}_n"), F.array(*[F.avg(c) for c in x]).alias(f"{part}_mean"),
            F.array(*xx).alias(f"{part}_xx"), F.array(*[F.covar_pop(c, x[k]) for c in x]).alias(f"{part}_xy"),
        ]
    return rows.groupBy("ticker").agg(*aggs)


def _filled(values: pd.Series, k: int) -> np.ndarray:
    """Rows of arrays as a matrix; moments of no rows are NaN."""
    return np.array([[np.nan if v is None else v for v in row] for row in values], float).reshape(-1, k)


def _square(values: pd.Series, k: int) -> np.ndarray:
    upper = np.triu_indices(k)
    flat = _filled(values, len(upper[0]))
    out = np.zeros((len(flat), k, k))
    out[:, upper[0], upper[1]] = flat
    out[:, upper[1], upper[0]] = flat
    return out


def solve(group: pd.DataFrame, k: int, strengths: Sequence[float]) -> pd.DataFrame:
    """The models of a batch of tickers, all factored together."""
    cov, mean, xy = (_square(group["train_xx"], k), _filled(group["train_mean"], k + 1), _filled(group["train_xy"], k + 1))
    sd = np.sqrt(np.einsum("bii->bi", cov))
    sd[sd == 0] = 1.0
    corr = cov / (sd[:, :, None] * sd[:, None, :])
    corr[:, range(k), range(k)] = 1.0
    v_cov, v_mean, v_xy = (_square(group["val_xx"], k), _filled(group["val_mean"], k + 1), _filled(group["val_xy"], k + 1))
    best = np.full(len(group), np.inf)
    strength = np.full(len(group), strengths[0], float)
    weights, intercept = np.zeros((len(group), k)), np.zeros(len(group))
    for number, s in enumerate(strengths):
        low = np.linalg.cholesky(corr + s * np.eye(k))
        half = np.linalg.solve(low, (xy[:, :k] / sd)[:, :, None])
        w = np.linalg.solve(low.transpose(0, 2, 1), half)[:, :, 0] / sd
        b = mean[:, k] - (w * mean[:, :k]).sum(axis=1)
        bias = v_mean[:, k] - b - (w * v_mean[:, :k]).sum(axis=1)
        error = v_xy[:, k] - 2 * (w * v_xy[:, :k]).sum(axis=1) + np.einsum("bi,bij,bj->b", w, v_cov, w) + bias**2
        error = np.where(np.isnan(error), np.inf, error)
        better = (error < best) | (number == 0)
        best = np.where(better, error, best)
        strength[better], weights[better], intercept[better] = s, w[better], b[better]
    return pd.DataFrame({
        "ticker": group["ticker"], "n": group["train_n"], "strength": strength, "intercept": intercept,
        "coefficients": list(weights),
    })


def ticker_ridge(
    rows: DataFrame, features: Sequence[str], strengths: Sequence[float] = STRENGTHS, target: str = "y"
) -> DataFrame:
    """ticker, n (training rows), strength, intercept, coefficients of every ticker's own model.

    Minimised is the mean squared error of the training rows plus ``strength`` times the squared
    coefficients of the features at unit variance. Of equal validation errors the first strength
    wins, also where a ticker has no validation row. A constant feature gets the coefficient 0;
    a ticker without a complete training row has no model; strengths are above 0.
    """
    if min(strengths) <= 0:
        raise ValueError("strengths must be above 0")
    k = len(features)
    gathered = moments(rows, features, target).where("train_n > 0")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in batches:
            if len(group):
                yield solve(group, k, strengths)

    kind = rows.schema["ticker"].dataType.simpleString()
    return gathered.mapInPandas(
        fit, f"ticker {kind}, n long, strength double, intercept double, coefficients array<double>"
    )


def ticker_predictions(models: DataFrame, rows: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """date, ticker, split, model, y, p; rows of tickers without a model are left out."""
    value = F.col("intercept")
    for i, c in enumerate(features):
        value = value + F.col("coefficients")[i] * F.col(c)
    found = rows.join(models.select("ticker", "intercept", "coefficients"), "ticker")
    return found.select("date", "ticker", "split", F.lit(name).alias("model"), "y", value.alias("p"))
