import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_exact_dedup import low
from tests.llm.test_minhash import brute as grouped
from tickerloom.llm import toxicity
from tickerloom.llm.frames import docs_of

SF = "/root/testdata/sf0.001"


def test_every_stage_equals_brute_force(spark):
    docs = docs_of(spark, SF)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, docs_of(spark, SF, "labels")).collect()}
    rows = {r.doc_id: r for r in docs.collect()}

    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns
    want = {i: r for i, r in rows.items() if not scored[i]}
    assert {r.doc_id: r for r in kept.collect()} == want

    frame = spark.createDataFrame(list(want.values()), docs.schema)
    last = {}
    for i in sorted(want):
        last[low(want[i].text)] = i
    want = {i: want[i] for i in last.values()}
    kept = stages["exact_dedup"](spark, frame, SF)
    assert kept.columns == docs.columns and {r.doc_id: r for r in kept.collect()} == want

    frame = spark.createDataFrame(list(want.values()), docs.schema)
    groups = grouped([(i, r.text) for i, r in want.items()], 5)
    want = {i: r for i, r in want.items() if groups[i][2]}
    kept = stages["near_dedup"](spark, frame, SF)
    assert kept.columns == docs.columns and {r.doc_id: r for r in kept.collect()} == want

    frame = spark.createDataFrame(list(want.values()), docs.schema)
    items = [(r.item_id, r.text) for r in docs_of(spark, SF, "benchmark").collect()]
    hits = contaminated([(i, r.text) for i, r in want.items()], items)
    want = {i: r for i, r in want.items() if not hits[i][4]}
    kept = stages["decontamination"](spark, frame, SF)
    assert kept.columns == docs.columns and {r.doc_id: r for r in kept.collect()} == want

    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(want)
    filled = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert filled.where("n > 2048 OR n != end").isEmpty()
    total = out.agg(F.sum("length")).first()[0]
    assert filled.count() == -(-total // 2048)


def test_stages_take_an_empty_table(spark):
    docs = docs_of(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
