"""M: datasets, scaling, selection, models, metrics, ensembles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tickerloom.functions.windows import pct_change
from tickerloom.operators import indicators as ind
from tickerloom.operators import joins, ml, tables
from tickerloom.operators import ticker_models as tm
from tickerloom.plans.domain_sql import CTES, register
from tickerloom.plans.q_quality import split_returns
from tickerloom.plans.registry import CASES, query
from tickerloom.session import dealt, kept, materialised

FEATURES = ["sma_5", "sma_20", "volatility_5d", "volatility_20d", "momentum", "volume_ratio"]
_F = ", ".join(FEATURES)
_FS = " ".join(FEATURES)
_L = lambda c: f"lag({c}) OVER (PARTITION BY ticker ORDER BY date) AS {c}"
_NAME = {"sma_5": "raw_sma", "sma_20": "raw_sma", "volatility_5d": "raw_volatility", "volatility_20d": "raw_volatility",
         "momentum": "raw_momentum", "volume_ratio": "raw_volume"}
register("features", f"""
SELECT date, ticker, ret AS y, {', '.join(_L(c) for c in FEATURES)}
FROM numbered JOIN raw_sma USING (date, ticker) JOIN raw_volatility USING (date, ticker)
JOIN raw_momentum USING (date, ticker) JOIN raw_volume USING (date, ticker)""")
_BODY = """
SELECT *, CASE WHEN rn > body THEN 'predict' WHEN rn <= floor(body * (1e0 - 0.1e0 - 0.2e0)) THEN 'train'
       WHEN rn <= floor(body * (1e0 - 0.1e0)) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn, n - ceil(0.05e0 * n) AS body
      FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM {source}))"""
register("dataset", f"""
SELECT date, ticker, y, {_F}, split FROM ({_BODY.format(source='(SELECT * FROM features WHERE y IS NOT NULL AND '
                                                        + ' AND '.join(f'{c} IS NOT NULL' for c in FEATURES) + ')')})""")


def features(d):
    base = dealt(d.bars, "ticker").withColumn("y", pct_change("close_Price"))
    return ind.indicators(base, ["sma", "volatility", "momentum", "volume"]).select("date", "ticker", "y", *FEATURES)


def dataset(d):
    return tables.chronological_parts(features(d).na.drop())


_TRAIN = lambda: F.col("split") == "train"


@query("M01_clean_dataset", f"""
WITH x AS (SELECT date, ticker, {', '.join(f'last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS {c}' for c in FEATURES)}
           FROM features WHERE y IS NOT NULL),
z AS (SELECT date, ticker, {', '.join(f'first_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}' for c in FEATURES)} FROM x)
SELECT * FROM z WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)} QUALIFY count(*) OVER (PARTITION BY ticker) >= 252""", _FS)
def _(d):
    wide = features(d).withColumn("empty", F.lit(None).cast("double"))
    wide = tables.drop_null_columns(wide, "all", keep=("date", "ticker"))
    return ml.clean_dataset(wide, ["date", "ticker", "y"], FEATURES).select("date", "ticker", *FEATURES)


query("M02_chronological_split", "SELECT date, ticker, split, y FROM dataset", "y")(
    lambda d: dataset(d).select("date", "ticker", "split", "y"))
register("minmax", "SELECT ticker, " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in FEATURES) + " FROM dataset WHERE split = 'train' GROUP BY 1")
_SC = lambda c: f"({c} - lo_{c}) / CASE WHEN hi_{c} = lo_{c} THEN 1e0 ELSE hi_{c} - lo_{c} END"


@query("M03_minmax_scaled", f"SELECT date, ticker, split, {', '.join(f'{_SC(c)} AS {c}' for c in FEATURES)} FROM dataset JOIN minmax USING (ticker)", _FS)
def _(d):
    rows = dataset(d)
    return ml.minmax_apply(rows, ml.minmax_fit(rows, FEATURES, _TRAIN()), FEATURES).select("date", "ticker", "split", *FEATURES)


@query("M03_minmax_inverse", "SELECT date, ticker, sma_20 FROM dataset JOIN minmax USING (ticker)", "sma_20")
def _(d):
    rows = dataset(d)
    scaler = ml.minmax_fit(rows, FEATURES, _TRAIN())
    return ml.minmax_inverse(ml.minmax_apply(rows, scaler, ["sma_20"]), scaler, "sma_20", "sma_20").select("date", "ticker", "sma_20")


@query("M04_standard_scaled", f"""
SELECT date, d.ticker, split, {', '.join(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1e0 ELSE s_{c} END AS {c}' for c in FEATURES)}
FROM dataset d JOIN (SELECT ticker, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)} FROM dataset WHERE split = 'train' GROUP BY 1) s ON d.ticker = s.ticker""", _FS)
def _(d):
    return ml.standardise(dataset(d), FEATURES, _TRAIN()).select("date", "ticker", "split", *FEATURES)


def _corrs() -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, y) AS corr FROM dataset" for c in FEATURES)


query("M05_k_best_signed", f"SELECT * FROM ({_corrs()}) ORDER BY corr DESC LIMIT 3", "corr")(lambda d: ml.k_best(dataset(d), FEATURES, 3))
query("M05_k_best_abs", f"SELECT * FROM ({_corrs()}) ORDER BY abs(corr) DESC LIMIT 3", "corr")(lambda d: ml.k_best(dataset(d), FEATURES, 3, mode="abs"))
query("M06_forest_importance")(lambda d: ml.forest_importance(_scaled(d).where(_TRAIN()), FEATURES, 4, trees=10, depth=4))
query("M07_principal_components")(
    lambda d: ml.principal_components(_scaled(d), FEATURES, 3, _TRAIN())[0].drop("split"))


@query("M07_component_variance", f"""
WITH s AS (SELECT {', '.join(f'{_SC(c)} AS {c}' for c in FEATURES)} FROM dataset JOIN minmax USING (ticker) WHERE split = 'train')
SELECT count(*) AS n, {' + '.join(f'var_samp({c})' for c in FEATURES)} AS total_variance, 0e0 AS correlation FROM s""", "total_variance correlation")
def _(d):
    """All components of the training rows: they keep the total variance and are uncorrelated."""
    k = len(FEATURES)
    pcs = ml.principal_components(_scaled(d), FEATURES, k, _TRAIN())[0].where(_TRAIN())
    names = [f"pc{i + 1}" for i in range(k)]
    total = sum((F.var_samp(c) for c in names), F.lit(0.0))
    pairs = [F.abs(F.covar_samp(a, b)) for i, a in enumerate(names) for b in names[:i]]
    return pcs.agg(F.count("*").alias("n"), total.alias("total_variance"), F.greatest(*pairs).alias("correlation"))


def _scaled(d):
    rows = dataset(d)
    return ml.minmax_apply(rows, ml.minmax_fit(rows, FEATURES, _TRAIN()), FEATURES)


@query("M08_sequences", """
SELECT ticker, split, date, y, array_to_string(list_transform(list(momentum) OVER w, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS seq
FROM dataset WINDOW w AS (PARTITION BY ticker, split ORDER BY date ROWS 9 PRECEDING)
QUALIFY row_number() OVER (PARTITION BY ticker, split ORDER BY date) >= 10""", "y")
def _(d):
    s = ml.sequences(dataset(d), ["momentum"], 10)
    return s.select("ticker", "split", "date", "y", F.array_join(F.transform("x", lambda r: r[0].cast("bigint").cast("string")), ",").alias("seq"))


@query("M09_forest")
def _(d):
    rows = _scaled(d)
    model = ml.tuned([ml.forest(10, depth) for depth in (3, 5)], rows, FEATURES)
    return ml.split_metrics(ml.predict(model, rows, FEATURES, "rf"), ["model", "split"])


@query("M10_boosted_trees")
def _(d):
    rows = _scaled(d)
    model = ml.tuned([ml.boosted(5, depth) for depth in (2, 3)], rows, FEATURES)
    return ml.split_metrics(ml.predict(model, rows, FEATURES, "xgb"), ["model", "split"])


@query("M11_ridge")
def _(d):
    rows = _scaled(d)
    model = ml.tuned([ml.ridge(s) for s in (0.01, 0.1)], rows, FEATURES)
    return ml.split_metrics(ml.predict(model, rows, FEATURES, "ridge"), ["model", "split"])


# predictions of three fixed rules stand for stored model outputs
_RULES = {"rf": 0.0, "xgb": 0.1, "tcn": -0.1}
register("outputs", "SELECT * FROM (SELECT date, ticker, split, y, model, f * lag(y) OVER (PARTITION BY ticker, model ORDER BY date) AS p FROM split_returns, (VALUES "
         + ", ".join(f"('{m}', {f}e0)" for m, f in _RULES.items()) + ") AS r(model, f)) WHERE p IS NOT NULL AND split <> 'predict'")
register("metrics", """
SELECT ticker, model, split, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, 1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0) AS r2
FROM outputs GROUP BY 1, 2, 3""")


def outputs(d):
    from pyspark.sql import Window

    prev = F.lag("y").over(Window.partitionBy("ticker").orderBy("date"))
    rows = split_returns(d).withColumn("_l", prev).where("_l IS NOT NULL AND split <> 'predict'")
    rules = F.array(*[F.struct(F.lit(m).alias("model"), (F.lit(f) * F.col("_l")).alias("p")) for m, f in _RULES.items()])
    return rows.select("date", "ticker", "split", "y", F.inline(rules))


query("M12_split_metrics", "SELECT * FROM metrics", "mse mae r2")(lambda d: ml.split_metrics(outputs(d)))
query("A13_regression_metrics", "SELECT model, split, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, 1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0) AS r2 FROM outputs GROUP BY 1, 2", "mse mae r2")(
    lambda d: ml.split_metrics(outputs(d), ["model", "split"]))
query("A14_run_summary", """
SELECT ticker, model, count(*) AS n, arg_min(p, date) AS first, arg_max(p, date) AS last, min(p) AS low, max(p) AS high FROM outputs GROUP BY 1, 2""", "first last low high")(
    lambda d: outputs(d).groupBy("ticker", "model").agg(
        F.count("*").alias("n"), F.min_by("p", "date").alias("first"), F.max_by("p", "date").alias("last"),
        F.min("p").alias("low"), F.max("p").alias("high")))


def _over(m):
    return f"greatest(({m}_v - {m}_t) / nullif({m}_t, 0), ({m}_s - {m}_v) / nullif({m}_v, 0))"


_WIDE = ", ".join(f"max({m}) FILTER (split = '{n}') AS {m}_{p}" for m in ("mse", "mae", "r2") for p, n in (("t", "train"), ("v", "val"), ("s", "test")))
query("M13_overfitting", f"""
WITH w AS (SELECT ticker, model, {_WIDE} FROM metrics GROUP BY 1, 2),
s AS (SELECT ticker, model, {_over('mse')} AS mse_score,
             greatest((r2_t - r2_v) / greatest(abs(r2_t), 0.01e0), (r2_v - r2_s) / greatest(abs(r2_v), 0.01e0)) AS r2_score, {_over('mae')} AS mae_score FROM w),
c AS (SELECT *, list_stddev_pop([mse_score, r2_score, mae_score]) / ((abs(mse_score) + abs(r2_score) + abs(mae_score)) / 3 + 0.01e0) AS consistency FROM s),
f AS (SELECT *, 0.35e0 * mse_score + 0.25e0 * r2_score + 0.3e0 * mae_score + 0.1e0 * consistency AS score FROM c)
SELECT *, score > 0.15e0 AS is_overfitted FROM f""", "mse_score r2_score mae_score consistency score")(lambda d: ml.overfitting(ml.split_metrics(outputs(d))))
register("model_weights", """
SELECT ticker, model, w / nullif(sum(w) OVER (PARTITION BY ticker), 0) AS weight
FROM (SELECT *, CASE WHEN i / sum(i) OVER (PARTITION BY ticker) >= 0.005e0 THEN i / sum(i) OVER (PARTITION BY ticker) ELSE 0e0 END AS w
      FROM (SELECT ticker, model, 1 / nullif(mse, 0) AS i FROM metrics WHERE split = 'val'))""")
query("M14_ensemble_weights", "SELECT * FROM model_weights", "weight")(lambda d: ml.ensemble_weights(ml.split_metrics(outputs(d))))
register("members", "SELECT ticker, model, avg(p) AS mean, stddev_pop(y - p) AS std FROM outputs WHERE split = 'test' GROUP BY 1, 2")


def members(d):
    return outputs(d).where("split = 'test'").groupBy("ticker", "model").agg(
        F.avg("p").alias("mean"), F.stddev_pop(F.col("y") - F.col("p")).alias("std"))


for _how, _u in (("equal", "1e0"), ("uncertainty", "1 / (std * std + 1e-8)"), ("custom", "coalesce(weight, 1e0)")):
    query(f"M15_combine_{_how}", f"""
SELECT ticker, sum(u * mean) / sum(u) AS ensemble_mean, sqrt(sum(u * u * std * std)) / sum(u) AS ensemble_std
FROM (SELECT m.*, {_u} AS u FROM members m LEFT JOIN model_weights w ON m.ticker = w.ticker AND m.model = w.model) GROUP BY 1""", "ensemble_mean ensemble_std")(
        lambda d, how=_how: ml.combine(members(d), how, ml.ensemble_weights(ml.split_metrics(outputs(d))) if how == "custom" else None))

# ---- one model per ticker; stored predictions as inputs of M12-M15 ---------------------------
RIDGES = {"trend": ("sma_5", "sma_20"), "risk": ("volatility_5d", "volatility_20d"), "flow": ("momentum", "volume_ratio")}


def _ridge_sql(model: str, a: str, b: str) -> str:
    """Closed form for two features: of both strengths the one with the least validation error."""
    fitted = f"""
SELECT ticker, n, strength, my - wa * ma - wb * mb AS intercept, wa, wb FROM (
  SELECT *, ((1 + strength) * ra - r * rb) / ((1 + strength) * (1 + strength) - r * r) / sa AS wa,
            ((1 + strength) * rb - r * ra) / ((1 + strength) * (1 + strength) - r * r) / sb AS wb
  FROM (SELECT *, cab / (sa * sb) AS r, cay / sa AS ra, cby / sb AS rb
        FROM (SELECT ticker, count(*) AS n, avg(y) AS my, avg({a}) AS ma, avg({b}) AS mb,
                     CASE WHEN stddev_pop({a}) = 0 THEN 1e0 ELSE stddev_pop({a}) END AS sa,
                     CASE WHEN stddev_pop({b}) = 0 THEN 1e0 ELSE stddev_pop({b}) END AS sb,
                     covar_pop({a}, {b}) AS cab, covar_pop({a}, y) AS cay, covar_pop({b}, y) AS cby
              FROM dataset WHERE split = 'train' GROUP BY 1)), (VALUES (0.01e0), (0.1e0)) AS v(strength))"""
    return f"""
SELECT '{model}' AS model, f.ticker, any_value(n) AS n, strength, any_value(intercept) AS intercept, any_value(wa) AS wa, any_value(wb) AS wb
FROM ({fitted}) f LEFT JOIN (SELECT * FROM dataset WHERE split = 'val') v ON f.ticker = v.ticker
GROUP BY f.ticker, strength
QUALIFY row_number() OVER (PARTITION BY f.ticker ORDER BY avg((y - intercept - wa * {a} - wb * {b}) * (y - intercept - wa * {a} - wb * {b})) NULLS LAST, strength) = 1"""


register("ridge_models", " UNION ALL ".join(f"SELECT * FROM ({_ridge_sql(m, a, b)})" for m, (a, b) in RIDGES.items()))
register("ridge_outputs", " UNION ALL ".join(f"""
SELECT d.date, d.ticker, d.split, d.y, m.model, intercept + wa * {a} + wb * {b} AS p
FROM dataset d JOIN ridge_models m ON d.ticker = m.ticker AND m.model = '{m}' WHERE d.split <> 'predict'""" for m, (a, b) in RIDGES.items()))


def ridge_outputs(d):
    rows = materialised(dataset(d), "model-dataset")
    parts = [tm.ticker_predictions(tm.ticker_ridge(rows, f), rows.where("split <> 'predict'"), f, m) for m, f in RIDGES.items()]
    return materialised(parts[0].unionByName(parts[1]).unionByName(parts[2]), "model-outputs")


@query("M11_ticker_ridge_models", "SELECT * FROM ridge_models", "strength intercept wa wb")
def _(d):
    rows = materialised(dataset(d), "model-dataset")
    found = [tm.ticker_ridge(rows, f).select(F.lit(m).alias("model"), "*") for m, f in RIDGES.items()]
    found = found[0].unionByName(found[1]).unionByName(found[2])
    return found.select("model", "ticker", "n", "strength", "intercept",
                        F.col("coefficients")[0].alias("wa"), F.col("coefficients")[1].alias("wb"))


@query("M11_ticker_ridge_optimal", "SELECT ticker, count(*) AS n, 0e0 AS gap FROM dataset WHERE split = 'train' GROUP BY 1", "gap")
def _(d):
    """The model of all features is optimal: the gradient of its loss is 0 for every feature."""
    rows = materialised(dataset(d), "model-dataset")
    models = tm.ticker_ridge(rows, FEATURES)
    train = rows.where(_TRAIN())
    fitted = tm.ticker_predictions(models, train, FEATURES, "ridge").select("date", "ticker", "p")
    strong = models.select("ticker", "strength", "coefficients")
    left = F.col("y") - F.col("p")
    slopes = [
        (F.covar_pop(c, left) / F.when(F.stddev_pop(c) == 0, F.lit(1.0)).otherwise(F.stddev_pop(c))
         - F.first("strength") * F.first("coefficients")[i] * F.stddev_pop(c)) for i, c in enumerate(FEATURES)
    ]
    together = train.join(fitted, ["date", "ticker"]).join(strong, "ticker")
    return together.groupBy("ticker").agg(F.count("*").alias("n"), F.greatest(*[F.abs(x) for x in slopes]).alias("gap"))


def _on_ridges(name: str) -> str:
    """The twin of a query of the fixed rules, over the predictions of the models."""
    sql = CASES[name].sql
    for table in ("outputs", "metrics", "model_weights", "members"):
        sql = re.sub(rf"\b{table}\b", f"ridge_{table}", sql)
    return sql


for _table in ("metrics", "model_weights", "members"):
    register(f"ridge_{_table}", re.sub(r"\b(outputs|metrics)\b", r"ridge_\1", CTES[_table]))


def _ridge_members(p):
    return p.where("split = 'test'").groupBy("ticker", "model").agg(
        F.avg("p").alias("mean"), F.stddev_pop(F.col("y") - F.col("p")).alias("std"))


_RIDGE_QUERIES = {
    "M12_split_metrics": lambda p: ml.split_metrics(p),
    "A13_regression_metrics": lambda p: ml.split_metrics(p, ["model", "split"]),
    "M13_overfitting": lambda p: ml.overfitting(ml.split_metrics(p)),
    "M14_ensemble_weights": lambda p: ml.ensemble_weights(ml.split_metrics(p)),
    "M15_combine_equal": lambda p: ml.combine(_ridge_members(p), "equal"),
    "M15_combine_uncertainty": lambda p: ml.combine(_ridge_members(p), "uncertainty"),
    "M15_combine_custom": lambda p: ml.combine(_ridge_members(p), "custom", ml.ensemble_weights(ml.split_metrics(p))),
}
for _name, _fn in _RIDGE_QUERIES.items():
    query(f"{_name}_of_models", _on_ridges(_name), " ".join(CASES[_name].doubles))(lambda d, fn=_fn: fn(ridge_outputs(d)))


_DRAWS = "mean std min max percentile_5 percentile_25 median percentile_75 percentile_95"


@query("M16_draw_summary", """
SELECT *, CASE WHEN std / (abs(mean) + 1e-8) < 0.5e0 THEN 'High' WHEN std / (abs(mean) + 1e-8) < 1 THEN 'Medium' ELSE 'Low' END AS confidence
FROM (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, avg(close_Price) AS mean, stddev_pop(close_Price) AS std, min(close_Price) AS min, max(close_Price) AS max,
             quantile_cont(close_Price, 0.05e0) AS percentile_5, quantile_cont(close_Price, 0.25e0) AS percentile_25, median(close_Price) AS median,
             quantile_cont(close_Price, 0.75e0) AS percentile_75, quantile_cont(close_Price, 0.95e0) AS percentile_95, count(*) AS n_runs FROM bars GROUP BY 1, 2)""", _DRAWS)
def _(d):
    draws = d.bars.select("ticker", F.trunc("date", "month").alias("month"), F.col("close_Price").alias("p"))
    return ml.draw_summary(draws, ["ticker", "month"])


query("M17_post_process", """
SELECT date, ticker, greatest(m - 4 * s, least(m + 4 * s, CASE WHEN z > 2.5e0 THEN m + (p - m) * greatest(0.4e0, 1 - 0.1e0 * (z - 2.5e0)) ELSE p END)) AS p
FROM (SELECT *, CASE WHEN s > 0 THEN abs(p - m) / s ELSE 0 END AS z
      FROM (SELECT date, n.ticker, greatest(-0.2e0, least(0.2e0, ret * 10)) AS p, m, s FROM numbered n
            JOIN (SELECT ticker, avg(ret) AS m, stddev_samp(ret) AS s FROM numbered GROUP BY 1) x ON n.ticker = x.ticker WHERE ret IS NOT NULL))""", "p")(
    lambda d: _post(d))


def _post(d):
    r = d.bars.select("date", "ticker", pct_change("close_Price").alias("r")).where("r IS NOT NULL")
    stats = r.groupBy("ticker").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    return r.join(stats, "ticker").select("date", "ticker", ml.post_process(F.col("r") * 10, F.col("m"), F.col("s")).alias("p"))


_LABELS = [f"label_{h}" for h in (30, 60, 90, 252)]
query("M18_horizon_labels", "SELECT date, ticker, " + ", ".join(
    f"lead(close_Price, {h}) OVER (PARTITION BY ticker ORDER BY date) / nullif(close_Price, 0) - 1 AS label_{h}" for h in (30, 60, 90, 252)) + " FROM bars", " ".join(_LABELS))(
    lambda d: ml.horizon_labels(d.bars))


HORIZONS = (30, 60, 90, 252)


@query("M18_direct_forecast")
def _(d):
    """One model per horizon, each tuned on the rows whose label is known and split by time;
    the newest row of every ticker is forecast, without a value where no label is known.

    The labelled rows are written once, where one task does not hold them, and each horizon reads
    them. The newest rows and the scalers are written once, so that the result's plan holds models
    and small tables: with the whole derivation for every horizon it would fill the driver."""
    n = d.bars.count()  # from the footers of the stored table
    rows = dataset(d).drop("y", "split").join(ml.horizon_labels(d.bars, HORIZONS), ["date", "ticker"])
    rows = kept(rows, "labelled", n)
    latest = materialised(joins.keep_latest(rows, ["ticker"], [F.col("date")]), "newest")
    out = latest.select("ticker", "date")
    for h in HORIZONS:
        known = dealt(rows.withColumn("y", F.col(f"label_{h}")).where("y IS NOT NULL"), "ticker", rows=n)
        known = tables.chronological_parts(known)
        scaler = ml.minmax_fit(known, FEATURES, _TRAIN())
        training = ml.minmax_scaled(known, FEATURES, _TRAIN())
        model = ml.tuned([ml.forest(10, depth) for depth in (3, 4)], training, FEATURES)
        newest = ml.minmax_apply(latest, materialised(scaler, "scaler"), FEATURES)
        newest = newest.withColumns({"y": F.lit(0.0), "split": F.lit("predict")})
        one = ml.predict(model, newest, FEATURES, "rf").select("ticker", "date", F.col("p").alias(f"predicted_return_{h}"))
        out = out.join(one, ["ticker", "date"], "left")
    return out


_CELLS = " UNION ALL ".join(f"SELECT ticker, '{c}' AS feature, {c} AS raw, {_SC(c)} AS scaled FROM latest JOIN minmax USING (ticker)" for c in FEATURES)
_OUT = f"""
WITH latest AS (SELECT * FROM dataset QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
c AS ({_CELLS}) SELECT * FROM c WHERE scaled < -0.1e0 OR scaled > 1.1e0
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY abs(scaled) DESC, feature) <= """


def _ranges(d, k):
    rows = dataset(d)
    latest = joins.keep_latest(rows, ["ticker"], [F.col("date")])
    return ml.out_of_range(latest, ml.minmax_fit(rows, FEATURES, _TRAIN()), FEATURES, k)


query("M19_out_of_range", _OUT + "15", "raw scaled")(lambda d: _ranges(d, 15))
query("L05_top_k_absolute", _OUT + "1", "raw scaled")(lambda d: _ranges(d, 1))
