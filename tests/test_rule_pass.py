"""The compiled rule pass: findings of rows, tickers and across sources, in one exchange a source."""

import datetime as dt

from pyspark.sql import functions as F

from tickerloom.operators.rule_pass import Rule, Source, findings, measure
from tickerloom.plans import all_queries, q_quality
from tickerloom.plans.domain import Domain


def sources(spark):
    bars = spark.createDataFrame(
        [("A", 1, 10.0), ("A", 2, 30.0), ("A", 3, None), ("B", 1, 5.0), (None, 1, 1.0), (None, 2, 9.0)],
        "ticker string, day int, close double")
    info = spark.createDataFrame([("A", "x"), ("B", None), ("C", "y")], "ticker string, name string")
    step = F.col("close") / F.col("prev")
    return [
        Source("bars", "prices", bars, {"n": F.count(F.lit(1)), "nulls": F.count_if(F.col("close").isNull())},
               [Rule("nulls", "HIGH", F.col("nulls"), F.col("nulls") > 0)],
               [Rule("jump", "LOW", step, step > 2)], {"prev": "close"}, "day"),
        Source("info", "names", info, {"n": F.count(F.lit(1))},
               row_rules=[Rule("blank", "LOW", F.lit(1.0), F.col("name").isNull())]),
    ]


def across():
    return [Rule("absent", "MEDIUM", F.lit(1.0), (measure("info", "n") > 0) & measure("bars", "n").isNull(), "prices")]


def test_findings_of_every_level(spark):
    got = {tuple(r) for r in findings(sources(spark), across()).collect()}
    assert got == {
        ("A", "prices", "jump", "LOW", 3.0), ("A", "prices", "nulls", "HIGH", 1.0), (None, "prices", "jump", "LOW", 9.0),
        ("B", "names", "blank", "LOW", 1.0), ("C", "prices", "absent", "MEDIUM", 1.0),
    }


def test_empty_sources_and_no_rules_across(spark):
    empty = [Source(s.name, s.table, s.rows.limit(0), s.measures, s.rules, s.row_rules, s.before, s.order)
             for s in sources(spark)]
    assert findings(empty, across()).collect() == []
    assert {r["issue"] for r in findings(sources(spark)).collect()} == {"jump", "nulls", "blank"}


def test_one_exchange_a_source(spark, tmp_path):
    stored = []
    for s in sources(spark):
        s.rows.write.parquet(str(tmp_path / s.name))
        rows = spark.read.parquet(str(tmp_path / s.name))
        stored.append(Source(s.name, s.table, rows, s.measures, s.rules, s.row_rules, s.before, s.order))
    plan = findings(stored, across())._jdf.queryExecution().sparkPlan().toString()
    full = findings(stored, across())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
    # one a source, and one for the aggregate across them where the union loses their partitioning
    assert 2 <= full.count("Exchange hashpartitioning") <= 3


def test_value_is_computed_only_where_the_rule_hits(spark):
    bars = spark.createDataFrame([("A", 1, 0.0), ("A", 2, 4.0), ("A", 3, 9.0)], "ticker string, day int, close double")
    jump = Rule("jump", "LOW", F.col("close") / F.col("prev"), F.col("prev") > 0)
    source = Source("bars", "prices", bars, {"n": F.count(F.lit(1))}, (), [jump], {"prev": "close"}, "day")
    assert [tuple(r) for r in findings([source]).collect()] == [("A", "prices", "jump", "LOW", 2.25)]


def _falling_to_zero(spark, path):
    """Base tables of one supplier whose close walks from 500 to 0 and then up by one."""
    steps = [0] * 166 + [1, 4]  # quantities that make steps of -3, -2 and 1 for key 7
    spark.createDataFrame(
        [(7, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), 7.0 + q, 100.0, 0.1, "N") for i, q in enumerate(steps)],
        "l_suppkey bigint, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string",
    ).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(7, "s", 1)], "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([(1, "n", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{path}/nation.parquet")
    spark.createDataFrame([(1, "r")], "r_regionkey int, r_name string").write.parquet(f"{path}/region.parquet")
    return Domain(spark, path)


def test_prices_of_zero_do_not_end_the_pass(spark, tmp_path):
    all_queries.load()
    d = _falling_to_zero(spark, str(tmp_path))
    assert [r[0] for r in d.bars.orderBy("date").select("close_Price").tail(3)] == [2.0, 0.0, 1.0]
    compiled, single = (f(d) for f in (q_quality.compiled_issues, q_quality.all_issues))
    assert {tuple(r) for r in compiled.collect()} == {tuple(r) for r in single.collect()}
    assert compiled.where("issue = 'close_not_positive'").count() == 1
