"""Prediction records, accuracy and model bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.scalar import target_date
from tickerloom.operators.joins import last_rows
from tickerloom.operators.percentiles import exact_percentiles

# Fixed values
HORIZONS = (30, 60, 90, 252)
BIAS_PCT, COVERAGE_LOW, COVERAGE_HIGH, RETURN_GAP = 2.0, 0.80, 0.98, 0.05
REQUIRED_MODELS = ("rf", "xgb", "tcn")
MODEL_AGE_DAYS = 30


def horizon_records(current: DataFrame, forecast: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Forecast rows -> one record per horizon.

    ``current``: ticker, prediction_date, current_price. ``forecast``: ticker, date,
    close_Price and optional bounds; steps are counted after the prediction date.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    ahead = forecast.join(current, "ticker").where(F.col("date") > F.col("prediction_date"))
    steps = ahead.withColumn("prediction_horizon_days", F.row_number().over(w)).where(
        F.col("prediction_horizon_days").isin(*horizons) & F.col("close_Price").isNotNull()
    )
    p, now = F.col("close_Price"), F.col("current_price")
    return steps.select(
        "prediction_date",
        "ticker",
        "prediction_horizon_days",
        target_date("prediction_date", "prediction_horizon_days").alias("target_date"),
        p.alias("predicted_price"),
        "current_price",
        F.when(now > 0, (p - now) / now).alias("predicted_return"),
    )


def accuracy(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Predictions whose target date has a bar, with error and hit columns."""
    actual = bars.where(F.col("close_Price").isNotNull()).select(
        "ticker", F.col("date").alias("target_date"), F.col("close_Price").alias("actual_price")
    )
    a, cur = F.col("actual_price"), F.col("current_price")
    j = predictions.join(actual, ["ticker", "target_date"]).withColumns(
        {
            "price_error_pct": F.try_divide((F.col("predicted_price") - a) * F.lit(100.0), a),
            "actual_return": F.try_divide(a - cur, cur),
        }
    )
    return j.withColumns(
        {
            "abs_error_pct": F.abs("price_error_pct"),
            "return_error": F.col("predicted_return") - F.col("actual_return"),
            "direction_correct": ((F.col("predicted_return") > 0) == (F.col("actual_return") > 0)).cast("int"),
            "in_confidence": a.between(F.col("confidence_lower_5"), F.col("confidence_upper_95")).cast("int"),
        }
    )


def horizon_metrics(scored: DataFrame) -> DataFrame:
    """Metrics per horizon; the median is exact and never gathers a horizon in one task."""
    key = "prediction_horizon_days"
    stats = scored.groupBy(key).agg(
        F.count("ticker").alias("n_predictions"),
        F.countDistinct("ticker").alias("n_tickers"),
        F.avg("price_error_pct").alias("mean_error_pct"),
        F.avg("abs_error_pct").alias("mae_pct"),
        F.sqrt(F.avg(F.col("abs_error_pct") * F.col("abs_error_pct"))).alias("rmse_pct"),
        F.avg("direction_correct").alias("direction_accuracy"),
        F.avg("in_confidence").alias("confidence_coverage"),
        F.avg("predicted_return").alias("mean_predicted_return"),
        F.avg("actual_return").alias("mean_actual_return"),
        F.stddev_samp("actual_return").alias("std_actual_return"),
    )
    median = exact_percentiles(scored, [key], "price_error_pct", {"median_error_pct": 0.5})
    return stats.join(median, key)


def ticker_metrics(scored: DataFrame) -> DataFrame:
    return scored.groupBy("ticker", "prediction_horizon_days").agg(
        F.count("prediction_date").alias("n_predictions"),
        F.avg("price_error_pct").alias("mean_error_pct"),
        F.avg("abs_error_pct").alias("mae_pct"),
        F.avg("direction_correct").alias("direction_accuracy"),
        F.avg("in_confidence").alias("confidence_coverage"),
        F.avg("predicted_return").alias("mean_predicted_return"),
        F.avg("actual_return").alias("mean_actual_return"),
    )


def best_and_worst(metrics: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` lowest and highest mean absolute errors and best directions."""
    order = [F.col("ticker"), F.col("prediction_horizon_days")]
    lists = {
        "lowest_error": F.col("mae_pct").asc(),
        "highest_error": F.col("mae_pct").desc(),
        "best_direction": F.col("direction_accuracy").desc(),
    }
    out = None
    for name, by in lists.items():
        part = metrics.orderBy(by, *order).limit(k).select(
            F.lit(name).alias("list"), "ticker", "prediction_horizon_days", "mae_pct", "direction_accuracy"
        )
        out = part if out is None else out.unionByName(part)
    return out


def bias_findings(scored: DataFrame) -> DataFrame:
    """Systematic deviations as rows (finding, value)."""
    a = scored.agg(
        F.avg("price_error_pct").alias("err"),
        F.avg("in_confidence").alias("cov"),
        (F.avg("predicted_return") - F.avg("actual_return")).alias("gap"),
    )
    rules = [
        ("upward_bias", "err", F.col("err") > BIAS_PCT),
        ("downward_bias", "err", F.col("err") < -BIAS_PCT),
        ("intervals_too_narrow", "cov", F.col("cov") < COVERAGE_LOW),
        ("intervals_too_wide", "cov", F.col("cov") > COVERAGE_HIGH),
        ("return_level_mismatch", "gap", F.abs("gap") > RETURN_GAP),
    ]
    found = F.array(
        *[F.struct(F.lit(n).alias("finding"), F.col(c).alias("value"), hit.alias("hit")) for n, c, hit in rules]
    )
    return a.select(F.inline(found)).where("hit").drop("hit")


def prediction_summary(predictions: DataFrame, as_of: Column, max_age: int) -> DataFrame:
    """Per ticker: fresh predictions' date and price, return range, longest horizon."""
    fresh = predictions.where(F.datediff(as_of, F.col("prediction_date")) <= max_age)
    h = F.col("prediction_horizon_days")
    return fresh.groupBy("ticker").agg(
        F.max("prediction_date").alias("prediction_date"),
        F.max_by("current_price", "prediction_date").alias("current_price"),
        F.count(F.lit(1)).alias("n_horizons"),
        F.min("predicted_return").alias("min_return"),
        F.max("predicted_return").alias("max_return"),
        F.max(h).alias("longest_horizon"),
        F.max_by("predicted_return", F.struct(h, F.col("prediction_date"))).alias("longest_return"),
    )


def predicted_profit(forecast: DataFrame, days: int) -> DataFrame:
    """First-to-last return in percent over the trailing ``days`` rows."""
    tail = last_rows(forecast.select("ticker", "date", "close_Price"), days)
    first, last = F.min_by("close_Price", "date"), F.max_by("close_Price", "date")
    return tail.groupBy("ticker").agg(
        ((F.try_divide(last, first) - F.lit(1.0)) * F.lit(100.0)).alias("profit_pct")
    )


def historical_comparison(forecast: DataFrame, bars: DataFrame) -> DataFrame:
    """Forecast against actual per ticker: change errors, direction, price errors."""
    w = Window.partitionBy("ticker").orderBy("date")
    c = F.col("close_Price")
    change = lambda x: F.try_divide(x, F.lag(x).over(w)) - F.lit(1.0)
    f = forecast.select("ticker", "date", c.alias("p"), change(c).alias("pc"))
    b = bars.select("ticker", "date", c.alias("a"), change(c).alias("ac"))
    e = F.col("pc") - F.col("ac")
    same = (F.signum("pc") == F.signum("ac")).cast("int")
    return f.join(b, ["ticker", "date"]).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.stddev_pop(e).alias("std_error"),
        F.max(F.abs(e)).alias("max_error"),
        (F.avg(same) * F.lit(100.0)).alias("direction_pct"),
        F.avg(F.abs(F.col("p") - F.col("a"))).alias("mean_price_error"),
        (F.avg(F.abs(F.try_divide(F.col("p") - F.col("a"), F.col("a")))) * F.lit(100.0)).alias("price_error_pct"),
    )


def model_status(registry: DataFrame, as_of: Column, max_age: int = MODEL_AGE_DAYS) -> DataFrame:
    """Valid models with their age and freshness."""
    age = F.datediff(as_of, F.col("tuning_date"))
    return registry.where("is_valid").select(
        "ticker", "model_type", "tuning_date", age.alias("age_days"), (age <= max_age).alias("is_fresh")
    )


def training_needs(stocks: DataFrame, status: DataFrame, required=REQUIRED_MODELS) -> DataFrame:
    """``untrained``, ``stale`` or ``fresh`` per ticker."""
    need = F.array(*[F.lit(m) for m in required])
    per = status.groupBy("ticker").agg(
        (
            (F.size(F.array_except(need, F.collect_set("model_type"))) == 0) & F.bool_and("is_fresh")
        ).alias("_ok")
    )
    state = F.when(F.col("_ok").isNull(), "untrained").when(F.col("_ok"), "fresh").otherwise("stale")
    return stocks.select("ticker").join(per, "ticker", "left").select("ticker", state.alias("status"))


def prediction_needs(stocks: DataFrame, predictions: DataFrame, as_of: Column, max_age: int) -> DataFrame:
    """Whether a ticker has been predicted within ``max_age`` days."""
    fresh = (
        predictions.where(F.datediff(as_of, F.col("prediction_date")) <= max_age)
        .select("ticker").distinct().withColumn("_f", F.lit(True))
    )
    return stocks.select("ticker").join(fresh, "ticker", "left").select(
        "ticker", F.when(F.col("_f"), "recent").otherwise("needs_prediction").alias("status")
    )


def usable_parameters(registry: DataFrame, features: Column, as_of: Column,
                      max_age: int = MODEL_AGE_DAYS) -> DataFrame:
    """Stored parameters that are valid, fresh and made for the same feature list."""
    from tickerloom.functions.scalar import feature_hash

    ok = (
        F.col("is_valid")
        & (F.datediff(as_of, F.col("tuning_date")) <= max_age)
        & (F.col("feature_hash") == feature_hash(features))
    )
    return registry.where(ok).select(
        "ticker", "model_type",
        F.from_json("hyperparameters", "max_depth int, n_estimators int").alias("p"),
    ).select("ticker", "model_type", "p.max_depth", "p.n_estimators")
