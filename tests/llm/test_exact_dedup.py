import hashlib

import pytest

from tickerloom.llm.exact_dedup import duplicate_groups, exact_dedup

ROWS = "doc_id long, text string, head string, kept int"
CASES = [
    (1, "Abc", "x", 1), (2, "aBC", "y", 2), (3, "abd", None, 3), (4, None, "z", 4), (5, "", "z", 5),
    (6, "É", "q", 6), (7, "é", "q", 7), (8, "p" * 300 + "x", "l", 8), (9, "p" * 300 + "y", "l", 9),
    (10, "p" * 300 + "X", "l", 10), (None, "alone", "n", 11), (11, "word " * 40_000, "v", 12),
]


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("keys", [500_000, 0])
def test_groups_equal_brute_force(spark, keys):
    rows = duplicate_groups(spark.createDataFrame(CASES, ROWS), digest=True, broadcast_keys=keys).collect()
    assert len(rows) == len(CASES)
    by_id = {r.doc_id: r for r in rows}
    for i, text, *_ in CASES:
        same = [j for j, t, *_ in CASES if low(t) == low(text)]
        r = by_id[i]
        keep = max((j for j in same if j is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), i == keep)
        assert r.text_sha256 == hashlib.sha256(low(text).encode()).hexdigest()


def test_filter_keeps_one_row_of_each_group_and_all_columns(spark):
    docs = spark.createDataFrame([*CASES, (2, "aBC", "y", 2), (3, "other", "o", 1), (None, "alone", "n", 9)], ROWS)
    rows = exact_dedup(docs).collect()
    assert docs.columns == exact_dedup(docs).columns
    texts = [low(r.text) for r in rows]
    assert sorted(texts) == sorted({low(r.text) for r in docs.collect()})
    ids = sorted((r.doc_id for r in rows if r.doc_id is not None))
    assert ids == [2, 3, 3, 5, 6, 7, 9, 10, 11]


def test_empty_table(spark):
    docs = spark.createDataFrame([], ROWS)
    assert duplicate_groups(docs).count() == 0
    assert exact_dedup(docs).count() == 0


def test_filter_with_clashing_names(spark):
    rows = [(1, "a", 10, 11, 12, 13), (2, "A", 20, 21, 22, 23), (2, "b", 30, 31, 32, 33), (2, "b", 30, 31, 32, 33)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha long, _drop long, _twice long, _keep long")
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[1], rows[2]]
    assert sorted(map(tuple, exact_dedup(docs.where("_sha < 30")).collect())) == [rows[1]]


def test_few_dropped_keys_do_not_shuffle_the_texts(spark):
    rows = [(k * 7919 % 20_011, f"text {min(k, 19_990)}") for k in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40000")
    try:
        kept = exact_dedup(docs)
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert kept.count() == 19_991
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
