import datetime as dt

import numpy as np
import pytest

from tickerloom.operators.ticker_models import ticker_predictions, ticker_ridge

FEATURES = ["a", "b", "c", "d"]
SCHEMA = "ticker string, date date, split string, a double, b double, c double, d double, y double"


def series(seed, n, scale):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, scale, 1e-3, 0] + [5, 1e4, 0, 7]
    x[:, 1] += scale * x[:, 0]
    return x, x @ [0.5, -0.01 / scale, 30, 1] + rng.normal(size=n)


def table():
    out = []
    for t, (n, cut) in {"A": (300, 200), "B": (40, 20), "C": (25, 25), "D": (1, 1)}.items():
        x, y = series(ord(t), n, 50.0)
        for i in range(n):
            out.append((t, dt.date(2020, 1, 1) + dt.timedelta(i), "train" if i < cut else "val", *map(float, x[i]), float(y[i])))
    out += [("A", dt.date(2024, 1, 1), "train", None, 1.0, 1.0, 1.0, 1e9), ("E", dt.date(2024, 1, 1), "val", 1.0, 1.0, 1.0, 1.0, 1.0)]
    return out


def direct(rows, strength):
    x = np.array([r[3:7] for r in rows])
    y = np.array([r[7] for r in rows])
    sd = x.std(axis=0)
    sd[sd < 1e-12] = 1
    z = (x - x.mean(axis=0)) / sd
    w = np.linalg.solve(z.T @ z / len(y) + strength * np.eye(4), z.T @ (y - y.mean()) / len(y)) / sd
    return w, y.mean() - w @ x.mean(axis=0)


def test_models_equal_direct_ridge_of_each_ticker(spark):
    rows = table()
    got = {r.ticker: r for r in ticker_ridge(spark.createDataFrame(rows, SCHEMA).repartition(5), FEATURES, (0.5, 0.01, 0.1)).collect()}
    assert set(got) == {"A", "B", "C", "D"}
    for t, r in got.items():
        own = [x for x in rows if x[0] == t and None not in x]
        train, val = ([x for x in own if x[2] == s] for s in ("train", "val"))
        assert r.n == len(train)
        fits = {s: direct(train, s) for s in (0.5, 0.01, 0.1)}
        error = {s: np.mean([(x[7] - b - w @ np.array(x[3:7])) ** 2 for x in val]) if val else 0 for s, (w, b) in fits.items()}
        assert r.strength == min(error, key=error.get)
        w, b = fits[r.strength]
        assert np.allclose(r.coefficients, w, rtol=1e-6, atol=1e-9) and np.isclose(r.intercept, b, rtol=1e-6)
        assert r.coefficients[3] == 0


def test_predictions_nulls_and_empty(spark):
    rows = spark.createDataFrame(table(), SCHEMA)
    models = ticker_ridge(rows, FEATURES)
    p = ticker_predictions(models, rows, FEATURES, "ridge").collect()
    assert {r.ticker for r in p} == {"A", "B", "C", "D"} and len(p) == 300 + 1 + 40 + 25 + 1
    assert [r.p is None for r in p if r.y == 1e9] == [True]
    assert ticker_ridge(rows.limit(0), FEATURES).count() == 0
    with pytest.raises(ValueError):
        ticker_ridge(rows, FEATURES, (0.0,))
