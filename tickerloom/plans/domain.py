"""Domain tables (bars, statements, predictions, ...) derived from the base tables.

Prices are integer-valued doubles and money goes through exact decimals, so the tables
are the same bit for bit in any engine. ``domain_sql`` holds the SQL twins.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.session import shared_folder

HORIZONS = (30, 60, 90, 252)
BLACKLIST_REASONS = ("delisted", "invalid", "no_data", "manual", "error", "suspended")
ERROR_MESSAGES = (
    "No data found for symbol",
    "Symbol may be delisted",
    "HTTP 404 for url",
    "Connection timed out",
    "Ticker invalid or not found",
)


def ticker_of(key: Column, prefix: str = "S", width: int = 5) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), width, "0"))


_STORED: dict[tuple[str, str, str], str] = {}


class Domain:
    """Domain tables over one folder of base parquet files.

    Bars and statement sums stand for stored tables: the first use in an application
    aggregates the base table once and writes the (far smaller) result to the shared
    folder; every later use scans that. Everything else is a lazy view on them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def stored(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            path = shared_folder(self.spark, name)
            build().write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- price bars -------------------------------------------------------------
    @staticmethod
    def _walk(daily: DataFrame) -> DataFrame:
        w = Window.partitionBy("ticker").orderBy("date")
        step = F.pmod(F.col("q") + F.col("k"), F.lit(7)) - 3
        close = (F.lit(500) + F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        bars = daily.withColumn("close_Price", close.cast("double"))
        bars = bars.withColumn(
            "open_Price", F.coalesce(F.lag("close_Price").over(w), F.lit(500).cast("double"))
        )
        return bars.select(
            "date",
            "ticker",
            "k",
            "open_Price",
            (F.greatest("open_Price", "close_Price") + F.pmod("q", F.lit(5))).alias("high_Price"),
            (F.least("open_Price", "close_Price") - F.pmod("q", F.lit(3))).alias("low_Price"),
            "close_Price",
            (F.col("q") * 100).alias("trade_Volume"),
        )

    @cached_property
    def bars_keyed(self) -> DataFrame:
        return self.stored("bars", self._build_bars)

    def _build_bars(self) -> DataFrame:
        daily = (
            self.raw("lineitem")
            .select(
                ticker_of(F.col("l_suppkey")).alias("ticker"),
                F.col("l_suppkey").alias("k"),
                F.col("l_shipdate").cast("date").alias("date"),
                "l_quantity",
            )
            .groupBy("ticker", "k", "date")
            .agg(F.sum("l_quantity").cast("bigint").alias("q"))
        )
        return self._walk(daily)

    @cached_property
    def bars(self) -> DataFrame:
        return self.bars_keyed.drop("k")

    @cached_property
    def bars_nation(self) -> DataFrame:
        return self.stored("bars_nation", self._build_bars_nation)

    def _build_bars_nation(self) -> DataFrame:
        supplier = self.raw("supplier").select("s_suppkey", "s_nationkey")
        daily = (
            self.raw("lineitem")
            .select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
            .groupBy("l_suppkey", "date")
            .agg(F.sum("l_quantity").alias("q"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(
                F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("ticker"),
                F.col("s_nationkey").cast("bigint").alias("k"),
                "date",
            )
            .agg(F.sum("q").cast("bigint").alias("q"))
        )
        return self._walk(daily).drop("k")

    @cached_property
    def bars_dirty(self) -> DataFrame:
        k, doy, day = F.col("k"), F.dayofyear("date"), F.dayofmonth("date")
        spike = (31 * k + doy) % 211 == 0
        close = (
            F.when((7 * k + doy) % 199 == 0, F.lit(None).cast("double"))
            .when(spike & (k % 9 == 4), F.col("close_Price") * 5)
            .when(spike, F.col("close_Price") * F.lit(1.5))
            .otherwise(F.col("close_Price"))
        )
        return self.bars_keyed.select(
            "date",
            "ticker",
            "open_Price",
            F.when((k + day) % 97 == 0, F.col("low_Price") - 1)
            .otherwise(F.col("high_Price"))
            .alias("high_Price"),
            "low_Price",
            close.alias("close_Price"),
            F.when((k % 8 == 2) & (day % 4 == 0), F.lit(0).cast("bigint"))
            .otherwise(F.col("trade_Volume"))
            .alias("trade_Volume"),
        )

    # ---- reference data ---------------------------------------------------------
    @cached_property
    def suppliers(self) -> DataFrame:
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                ticker_of(F.col("s_suppkey")).alias("ticker"),
                F.col("s_suppkey").alias("k"),
                "s_name",
                "n_name",
                "r_name",
                "r_regionkey",
            )
        )

    @cached_property
    def stock_info(self) -> DataFrame:
        stocks = self.suppliers.select(
            "ticker",
            F.when(F.col("k") % 13 != 0, F.col("s_name")).alias("company_Name"),
            F.col("n_name").alias("industry"),
            F.col("r_name").alias("country"),
        )
        indices = self.raw("region").select(
            F.concat(F.lit("^R"), F.col("r_regionkey").cast("string")).alias("ticker"),
            F.col("r_name").alias("company_Name"),
            F.lit("Index").alias("industry"),
            F.col("r_name").alias("country"),
        )
        return stocks.unionByName(indices)

    @cached_property
    def index_membership(self) -> DataFrame:
        return self.suppliers.select(
            "ticker",
            F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("index_code"),
            F.col("r_name").alias("index_name"),
            F.col("n_name").alias("exchange"),
            (F.col("k") % 6 != 0).alias("is_current"),
        )

    @cached_property
    def benchmarks(self) -> DataFrame:
        return (
            self.bars.select("date", "ticker", "close_Price")
            .join(self.index_membership.select("ticker", "index_code"), "ticker")
            .groupBy("index_code", "date")
            .agg(F.avg("close_Price").alias("close_Price"))
        )

    # ---- statements -------------------------------------------------------------
    def _sums(self, period: Column, alias: str) -> DataFrame:
        price, disc = F.col("l_extendedprice"), F.col("l_discount")
        returned = F.when(F.col("l_returnflag") == "R", price).otherwise(F.lit(0.0))
        return (
            self.raw("lineitem")
            .groupBy(
                ticker_of(F.col("l_suppkey")).alias("ticker"),
                F.col("l_suppkey").alias("k"),
                period.alias(alias),
            )
            .agg(
                F.sum((price * (1 - disc)).cast("decimal(18,4)")).cast("double").alias("rev"),
                F.sum(price.cast("decimal(18,4)")).cast("double").alias("ext"),
                F.sum(returned.cast("decimal(18,4)")).cast("double").alias("ret"),
            )
        )

    @cached_property
    def quarter_sums(self) -> DataFrame:
        end = F.last_day(F.add_months(F.trunc(F.col("l_shipdate").cast("date"), "quarter"), 2))
        return self.stored("quarter_sums", lambda: self._sums(end, "fiscal_quarter_end"))

    @cached_property
    def year_sums(self) -> DataFrame:
        end = F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(31))
        return self.stored("year_sums", lambda: self._sums(end, "financial_Statement_Date"))

    @staticmethod
    def _income(rev, ext, ret):
        return {
            "gross_profit": rev - F.lit(0.6) * ext,
            "operating_income": rev - F.lit(0.7) * ext,
            "net_income": rev - F.lit(0.75) * ext - F.lit(0.5) * ret,
        }

    @staticmethod
    def _balance(rev):
        assets = F.lit(3.0) * rev + F.lit(50000.0)
        liabilities = F.lit(1.5) * rev + F.lit(20000.0)
        return {
            "total_assets": assets,
            "total_liabilities": liabilities,
            "total_equity": assets - liabilities,
            "current_assets": F.lit(0.6) * assets,
            "current_liabilities": F.lit(0.4) * liabilities,
            "inventory": F.lit(0.2) * assets,
            "cash_and_equivalents": F.lit(0.1) * assets,
            "total_debt": F.lit(0.5) * liabilities,
        }

    @cached_property
    def income_quarterly(self) -> DataFrame:
        rev, ext, ret, k = (F.col(c) for c in ("rev", "ext", "ret", "k"))
        q_end = F.col("fiscal_quarter_end")
        parts = self._income(rev, ext, ret)
        hidden = (k + 4 * F.year(q_end) + F.quarter(q_end)) % 11 == 0
        return self.quarter_sums.where(k % 10 != 0).select(
            "ticker",
            "fiscal_quarter_end",
            F.when(~hidden, rev).alias("revenue_q"),
            parts["gross_profit"].alias("gross_profit_q"),
            parts["operating_income"].alias("operating_income_q"),
            parts["net_income"].alias("net_income_q"),
            (F.lit(1000) + 10 * k).cast("double").alias("shares_diluted"),
        )

    @cached_property
    def balance_quarterly(self) -> DataFrame:
        cols = [v.alias(n) for n, v in self._balance(F.col("rev")).items()]
        return self.quarter_sums.select("ticker", "fiscal_quarter_end", *cols)

    @cached_property
    def cashflow_quarterly(self) -> DataFrame:
        rev = F.col("rev")
        net = self._income(rev, F.col("ext"), F.col("ret"))["net_income"]
        return (
            self.quarter_sums.where(F.col("k") % 5 != 0)
            .select(
                "ticker",
                "fiscal_quarter_end",
                (net + F.lit(0.05) * rev).alias("operating_cash_flow_q"),
                (F.lit(0.04) * rev).alias("capex_q"),
                (F.lit(-0.3) * F.greatest(net, F.lit(0.0))).alias("dividends_paid_q"),
            )
            .withColumn("free_cash_flow_q", F.col("operating_cash_flow_q") - F.col("capex_q"))
        )

    @cached_property
    def income_annual(self) -> DataFrame:
        rev, ext, ret, k = (F.col(c) for c in ("rev", "ext", "ret", "k"))
        parts = self._income(rev, ext, ret)
        year = F.year("financial_Statement_Date")
        return self.year_sums.select(
            "ticker",
            "financial_Statement_Date",
            F.when((k + year) % 11 != 0, rev).alias("revenue"),
            parts["gross_profit"].alias("gross_Profit"),
            parts["operating_income"].alias("operating_Earning"),
            parts["net_income"].alias("net_Income"),
            F.when((k + year) % 13 != 0, (F.lit(1000) + 10 * k).cast("double")).alias(
                "average_shares"
            ),
        )

    @cached_property
    def balance_annual(self) -> DataFrame:
        b = self._balance(F.col("rev"))
        return self.year_sums.select(
            "ticker",
            "financial_Statement_Date",
            b["total_assets"].alias("total_Assets"),
            b["current_assets"].alias("current_Assets"),
            b["cash_and_equivalents"].alias("cash_And_Cash_Equivalents"),
            b["total_equity"].alias("equity"),
            b["total_liabilities"].alias("liabilities"),
            b["current_liabilities"].alias("current_liabilities"),
            b["inventory"].alias("inventory"),
        )

    @cached_property
    def cash_flow_annual(self) -> DataFrame:
        rev = F.col("rev")
        net = self._income(rev, F.col("ext"), F.col("ret"))["net_income"]
        fcf = net + F.lit(0.05) * rev - F.lit(0.04) * rev
        return self.year_sums.select(
            "ticker", "financial_Statement_Date", fcf.alias("free_Cash_Flow")
        )

    # ---- predictions and models -------------------------------------------------
    @cached_property
    def month_ends(self) -> DataFrame:
        w = Window.partitionBy("ticker", F.trunc("date", "month")).orderBy(F.col("date").desc())
        return (
            self.bars_keyed.select("ticker", "k", "date", "close_Price")
            .withColumn("_r", F.row_number().over(w))
            .where("_r = 1")
            .drop("_r")
        )

    @cached_property
    def predictions(self) -> DataFrame:
        h = F.col("prediction_horizon_days")
        ret = ((31 * F.col("k") + 17 * F.month("date") + h) % 41 - 20) / F.lit(1e2)
        price = F.col("predicted_price")
        return (
            self.month_ends.withColumn(
                "prediction_horizon_days", F.explode(F.array(*[F.lit(x) for x in HORIZONS]))
            )
            .withColumn("predicted_return", ret)
            .withColumn("predicted_price", F.col("close_Price") * (1 + F.col("predicted_return")))
            .select(
                F.col("date").alias("prediction_date"),
                "ticker",
                "prediction_horizon_days",
                F.date_add("date", F.floor(h * 365 / 252).cast("int")).alias("target_date"),
                "predicted_price",
                F.col("close_Price").alias("current_price"),
                "predicted_return",
                (price * F.lit(0.8)).alias("confidence_lower_5"),
                (price * F.lit(0.9)).alias("confidence_lower_16"),
                (price * F.lit(1.1)).alias("confidence_upper_84"),
                (price * F.lit(1.2)).alias("confidence_upper_95"),
            )
        )

    @cached_property
    def last_bar_date(self) -> Column:
        """The newest bar date, as a scalar subquery."""
        return self.bars_keyed.agg(F.max("date").alias("as_of")).scalar()

    @cached_property
    def model_registry(self) -> DataFrame:
        k = F.col("k")
        types = F.when(k % 3 != 0, F.array(F.lit("rf"), F.lit("xgb"), F.lit("tcn"))).otherwise(
            F.array(F.lit("rf"), F.lit("xgb"))
        )
        features = F.array(F.lit("sma_20"), F.lit("rsi_14"), F.lit("p_e"), F.lit("volatility_20d"))
        return self.suppliers.select("ticker", "k", F.explode(types).alias("model_type")).select(
            "ticker",
            "model_type",
            F.date_sub(self.last_bar_date, (7 * k % 60).cast("int")).alias("tuning_date"),
            (k % 11 != 0).alias("is_valid"),
            F.concat(
                F.lit('{"max_depth": '),
                (k % 7 + 3).cast("string"),
                F.lit(', "n_estimators": '),
                (k % 5 * 50 + 50).cast("string"),
                F.lit("}"),
            ).alias("hyperparameters"),
            F.when(k % 4 == 0, F.lit("stale"))
            .otherwise(F.sha2(F.array_join(F.array_sort(features), ","), 256))
            .alias("feature_hash"),
            ((k % 17 + F.length("model_type")) / F.lit(1e4) + F.lit(1e-4)).alias("val_mse"),
        )

    @cached_property
    def blacklist(self) -> DataFrame:
        k = F.col("k")
        reasons = F.array(*[F.lit(r) for r in BLACKLIST_REASONS])
        return self.suppliers.where(k % 7 == 3).select(
            "ticker",
            F.element_at(reasons, (k % 6 + 1).cast("int")).alias("reason"),
            (k % 2 == 1).alias("active"),
        )

    @cached_property
    def quarterly_metadata(self) -> DataFrame:
        quarters = self.income_quarterly.groupBy("ticker").agg(
            F.max("fiscal_quarter_end").alias("last_quarter_end"),
            F.count("*").alias("quarters_count"),
        )
        return (
            self.suppliers.select("ticker", "k")
            .join(quarters, "ticker", "left")
            .select(
                "ticker",
                F.date_sub(self.last_bar_date, (F.col("k") % 45).cast("int")).alias(
                    "last_fetch_date"
                ),
                "last_quarter_end",
                F.coalesce("quarters_count", F.lit(0)).alias("quarters_count"),
            )
        )

    # ---- events -----------------------------------------------------------------
    @cached_property
    def error_events(self) -> DataFrame:
        texts = F.array(*[F.lit(m) for m in ERROR_MESSAGES])
        return (
            self.raw("events")
            .where(F.col("event_type") == "error")
            .select(
                "event_id",
                "ts",
                ticker_of(F.col("user_id")).alias("ticker"),
                F.element_at(texts, (F.col("event_id") % 5 + 1).cast("int")).alias("message"),
            )
        )

    @cached_property
    def ticks(self) -> DataFrame:
        return self.raw("events").select(
            "event_id",
            "ts",
            ticker_of(F.col("user_id")).alias("ticker"),
            F.col("value").alias("price"),
        )
