"""Datasets, feature selection, models and ensembles.

One pooled model is trained over all tickers with ticker-normalised features; a model per
ticker would be a driver loop, not a Spark job.
"""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.scalar import clip
from tickerloom.functions.windows import backward_fill, forward_fill
from tickerloom.session import dealt, materialised

# Fixed values
MIN_ROWS = 252
OVERFIT_WEIGHTS = (0.35, 0.25, 0.30, 0.10)
OVERFIT_LIMIT = 0.15
MIN_ENSEMBLE_WEIGHT = 0.005
MEMBER_CLIP, REVERSION_START, REVERSION_STRENGTH, REVERSION_FLOOR, HARD_CAP = 0.20, 2.5, 0.10, 0.4, 4.0
RANGE_LOW, RANGE_HIGH = -0.1, 1.1


# ---- datasets --------------------------------------------------------------------------
def clean_dataset(df: DataFrame, critical, features, min_rows: int = MIN_ROWS) -> DataFrame:
    """Drop rows lacking critical values, fill features both ways within a ticker, drop
    rows still incomplete and tickers with too few rows."""
    df = df.na.drop(subset=list(critical))
    df = df.withColumns({c: forward_fill(c) for c in features})
    df = df.withColumns({c: backward_fill(c) for c in features}).na.drop(subset=list(features))
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    return df.withColumn("_n", n).where(F.col("_n") >= min_rows).drop("_n")


def minmax_fit(rows: DataFrame, features, train: Column) -> DataFrame:
    """Per-ticker minimum and maximum of each feature over the training rows."""
    aggs = [a for c in features for a in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    return rows.where(train).groupBy("ticker").agg(*aggs)


def _scaled(c: str) -> Column:
    span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
    return (F.col(c) - F.col(f"lo_{c}")) / F.when(span == 0, F.lit(1.0)).otherwise(span)


def minmax_apply(rows: DataFrame, scaler: DataFrame, features) -> DataFrame:
    j = rows.join(scaler, "ticker")
    return j.select(*[_scaled(c).alias(c) if c in features else F.col(c) for c in rows.columns])


def minmax_scaled(rows: DataFrame, features, train: Column) -> DataFrame:
    """``minmax_apply`` of the rows' own ``minmax_fit``: the range is found beside them, so nothing is
    derived twice or joined. Rows of a ticker without training rows go, as the join would have it."""
    w = Window.partitionBy("ticker")
    ends = {f"{e}_{c}": f(F.when(train, F.col(c))).over(w) for c in features for e, f in (("lo", F.min), ("hi", F.max))}
    j = rows.withColumns(ends | {"_fit": F.count_if(train).over(w)}).where((F.col("_fit") > 0) & F.col("ticker").isNotNull())
    return j.select(*[_scaled(c).alias(c) if c in features else F.col(c) for c in rows.columns])


def minmax_inverse(rows: DataFrame, scaler: DataFrame, feature: str, value: str) -> DataFrame:
    """Back to original units for a column ``value`` scaled like ``feature``."""
    j = rows.join(scaler.select("ticker", f"lo_{feature}", f"hi_{feature}"), "ticker")
    span = F.col(f"hi_{feature}") - F.col(f"lo_{feature}")
    back = F.col(value) * F.when(span == 0, F.lit(1.0)).otherwise(span) + F.col(f"lo_{feature}")
    return j.select(*[back.alias(value) if c == value else F.col(c) for c in rows.columns])


def standardise(rows: DataFrame, features, train: Column) -> DataFrame:
    """Zero mean, unit (population) deviation per ticker, fitted on the training rows."""
    aggs = [a for c in features for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    j = rows.join(rows.where(train).groupBy("ticker").agg(*aggs), "ticker")
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"s_{c}"))
    return j.select(*[z(c).alias(c) if c in features else F.col(c) for c in rows.columns])


def sequences(rows: DataFrame, features, steps: int, target: str = "y", keys=("ticker", "split")) -> DataFrame:
    """Every run of ``steps`` consecutive rows of a split, with the last row's target."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(steps - 1), 0)
    seq = F.collect_list(F.array(*[F.col(c) for c in features])).over(w)
    return rows.select(*keys, "date", target, seq.alias("x")).where(F.size("x") == steps)


def horizon_labels(bars: DataFrame, horizons=(30, 60, 90, 252)) -> DataFrame:
    """Return over the next ``h`` rows per bar: labels for direct multi-horizon models."""
    w = Window.partitionBy("ticker").orderBy("date")
    c = F.col("close_Price")
    labels = [(F.try_divide(F.lead(c, h).over(w), c) - F.lit(1.0)).alias(f"label_{h}") for h in horizons]
    return bars.select("date", "ticker", *labels)


# ---- feature selection -----------------------------------------------------------------
def k_best(rows: DataFrame, features, k: int, target: str = "y", mode: str = "signed") -> DataFrame:
    """The ``k`` features most correlated with the target, in one pass over the rows.

    ``signed`` ranks by the correlation itself, ``abs`` by its magnitude.
    """
    def corr(c: str) -> Column:
        return F.try_divide(F.covar_samp(c, target), F.stddev_samp(c) * F.stddev_samp(target))

    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`c_{c}`").alias("corr")) for c in features])
    found = rows.agg(*[corr(c).alias(f"c_{c}") for c in features]).select(F.inline(cells))
    score = F.abs("corr") if mode == "abs" else F.col("corr")
    return found.orderBy(score.desc_nulls_last(), "feature").limit(k)


def assemble(rows: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(rows)


def forest_importance(rows: DataFrame, features, k: int, target: str = "y", trees: int = 20, depth: int = 5,
                      seed: int = 42) -> DataFrame:
    """Top-``k`` features by importance in a random forest (one number per feature)."""
    model = RandomForestRegressor(
        featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed
    ).fit(assemble(rows, features))
    pairs = [(c, float(v)) for c, v in zip(features, model.featureImportances.toArray())]
    table = rows.sparkSession.createDataFrame(pairs, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(k)


def principal_components(rows: DataFrame, features, n: int, fit: Column | None = None) -> tuple[DataFrame, list[float]]:
    """Rows with ``n`` component columns, and the explained variance shares.

    The components are fitted on the rows where ``fit`` holds (the training rows; all rows
    without it) and applied to every row.
    """
    keep = [c for c in ("date", "ticker", "split") if c in rows.columns]
    data = materialised(assemble(rows, features).select(*keep, "features"), "components")
    model = PCA(k=n, inputCol="features", outputCol="pc").fit(data if fit is None else data.where(fit))
    out = model.transform(data).withColumn("pc", vector_to_array("pc"))
    cols = [F.col("pc")[i].alias(f"pc{i + 1}") for i in range(n)]
    return out.select(*keep, *cols), [float(v) for v in model.explainedVariance.toArray()]


# ---- models ----------------------------------------------------------------------------
def forest(trees: int = 20, depth: int = 5, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)


def boosted(iterations: int = 20, depth: int = 3, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol="y", maxIter=iterations, maxDepth=depth, seed=seed)


def ridge(strength: float = 0.1) -> LinearRegression:
    return LinearRegression(featuresCol="features", labelCol="y", regParam=strength, elasticNetParam=0.0)


def tuned(candidates, rows: DataFrame, features):
    """The candidate estimator with the lowest validation RMSE, fitted on the train rows.

    The hold-out is chronological (``split`` column), never random.
    """
    data = dealt(materialised(assemble(rows, features).select("split", "y", "features"), "training"))
    train, val = data.where("split = 'train'"), data.where("split = 'val'")
    judge = RegressionEvaluator(labelCol="y", predictionCol="prediction", metricName="rmse")
    fitted = [c.fit(train) for c in candidates]
    scores = [judge.evaluate(m.transform(val)) for m in fitted]
    return fitted[scores.index(min(scores))]


def predict(model, rows: DataFrame, features, name: str) -> DataFrame:
    out = model.transform(assemble(rows, features))
    return out.select("date", "ticker", "split", F.lit(name).alias("model"), "y", F.col("prediction").alias("p"))


# ---- metrics and ensembles -------------------------------------------------------------
def split_metrics(predicted: DataFrame, keys=("ticker", "model", "split")) -> DataFrame:
    """MSE, MAE and R2 in one aggregation."""
    e, y = F.col("y") - F.col("p"), F.col("y")
    n = F.count(F.lit(1))
    sse = F.sum(e * e)
    sst = F.var_pop(y) * n
    return predicted.groupBy(*keys).agg(
        (sse / n).alias("mse"), F.avg(F.abs(e)).alias("mae"), (F.lit(1.0) - F.try_divide(sse, sst)).alias("r2")
    )


def overfitting(metrics: DataFrame, keys=("ticker", "model"), limit: float = OVERFIT_LIMIT) -> DataFrame:
    """Degradation score from train to validation to test, and the verdict."""
    pick = lambda m, s: F.max(F.when(F.col("split") == s, F.col(m)))
    parts = {"t": "train", "v": "val", "s": "test"}
    wide = metrics.groupBy(*keys).agg(
        *[pick(m, name).alias(f"{m}_{p}") for m in ("mse", "mae", "r2") for p, name in parts.items()]
    )
    f = F.col

    def loss(m: str) -> Column:
        return F.greatest(
            F.try_divide(f(f"{m}_v") - f(f"{m}_t"), f(f"{m}_t")), F.try_divide(f(f"{m}_s") - f(f"{m}_v"), f(f"{m}_v"))
        )

    floor = lambda c: F.greatest(F.abs(c), F.lit(0.01))
    r2 = F.greatest((f("r2_t") - f("r2_v")) / floor(f("r2_t")), (f("r2_v") - f("r2_s")) / floor(f("r2_v")))
    wide = wide.withColumns({"mse_score": loss("mse"), "r2_score": r2, "mae_score": loss("mae")})
    a, b, c = f("mse_score"), f("r2_score"), f("mae_score")
    mean = (a + b + c) / F.lit(3.0)
    spread = F.sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean)) / F.lit(3.0))
    size = (F.abs(a) + F.abs(b) + F.abs(c)) / F.lit(3.0)
    w = OVERFIT_WEIGHTS
    out = wide.withColumn("consistency", spread / (size + F.lit(0.01)))
    score = F.lit(w[0]) * a + F.lit(w[1]) * b + F.lit(w[2]) * c + F.lit(w[3]) * f("consistency")
    return out.withColumn("score", score).select(
        *keys, "mse_score", "r2_score", "mae_score", "consistency", "score", (f("score") > limit).alias("is_overfitted")
    )


def ensemble_weights(metrics: DataFrame) -> DataFrame:
    """Inverse validation MSE per ticker; negligible weights are zeroed, the rest rescaled."""
    w = Window.partitionBy("ticker")
    inverse = F.try_divide(F.lit(1.0), F.col("mse"))
    v = metrics.where("split = 'val'").select("ticker", "model", inverse.alias("_i"))
    v = v.withColumn("_w", F.col("_i") / F.sum("_i").over(w))
    v = v.withColumn("_w", F.when(F.col("_w") >= MIN_ENSEMBLE_WEIGHT, F.col("_w")).otherwise(F.lit(0.0)))
    return v.select("ticker", "model", F.try_divide(F.col("_w"), F.sum("_w").over(w)).alias("weight"))


def combine(predictions: DataFrame, how: str = "equal", weights: DataFrame | None = None) -> DataFrame:
    """Ensemble mean and deviation per ticker from (ticker, model, mean, std).

    ``equal``, ``uncertainty`` (inverse variance) or ``custom`` with a weight table.
    """
    if how == "custom":
        rows = predictions.join(weights.select("ticker", "model", F.col("weight").alias("_u")), ["ticker", "model"], "left")
        rows = rows.withColumn("_u", F.coalesce("_u", F.lit(1.0)))
    elif how == "uncertainty":
        rows = predictions.withColumn("_u", F.lit(1.0) / (F.col("std") * F.col("std") + F.lit(1e-8)))
    elif how == "equal":
        rows = predictions.withColumn("_u", F.lit(1.0))
    else:
        raise ValueError(f"unknown weighting {how!r}")
    total = F.sum("_u")
    return rows.groupBy("ticker").agg(
        F.try_divide(F.sum(F.col("_u") * F.col("mean")), total).alias("ensemble_mean"),
        F.try_divide(F.sqrt(F.sum(F.col("_u") * F.col("_u") * F.col("std") * F.col("std"))), total).alias("ensemble_std"),
    )


def draw_summary(draws: DataFrame, keys=("ticker",), value: str = "p") -> DataFrame:
    """Statistics of repeated predictions (a bounded number of draws per key)."""
    v = F.col(value)
    out = draws.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(v, F.array(*[F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("_q"),
        F.count(v).alias("n_runs"),
    )
    cv = F.col("std") / (F.abs("mean") + F.lit(1e-8))
    label = F.when(cv < 0.5, "High").when(cv < 1.0, "Medium").otherwise("Low")
    names = ("percentile_5", "percentile_25", "median", "percentile_75", "percentile_95")
    return out.select(
        *keys, "mean", "std", "min", "max", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)],
        "n_runs", label.alias("confidence"),
    )


def post_process(p: Column, mean: Column, std: Column) -> Column:
    """Clip a member's prediction, pull extremes towards the mean, cap at four deviations."""
    p = clip(p, -MEMBER_CLIP, MEMBER_CLIP)
    z = F.when(std > 0, F.abs(p - mean) / std).otherwise(F.lit(0.0))
    factor = F.greatest(F.lit(REVERSION_FLOOR), F.lit(1.0) - F.lit(REVERSION_STRENGTH) * (z - F.lit(REVERSION_START)))
    pulled = F.when(z > REVERSION_START, mean + (p - mean) * factor).otherwise(p)
    cap = F.lit(HARD_CAP) * std
    return F.greatest(mean - cap, F.least(mean + cap, pulled))


def out_of_range(latest: DataFrame, scaler: DataFrame, features, k: int = 15) -> DataFrame:
    """Per ticker, up to ``k`` features of the newest row outside the training range."""
    j = latest.join(scaler, "ticker")
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("raw"), _scaled(c).alias("scaled")) for c in features]
    )
    rows = j.select("ticker", F.inline(cells)).where(
        (F.col("scaled") < RANGE_LOW) | (F.col("scaled") > RANGE_HIGH)
    )
    w = Window.partitionBy("ticker").orderBy(F.abs("scaled").desc(), "feature")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
