import hashlib
import random
import re

import pyarrow as pa
import pytest

from tickerloom.llm.decontaminate import clean_documents, contamination, hit_rows, without_spans
from tickerloom.llm.frames import BATCH_BYTES, ids_and_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    out = {}
    for d, text in docs:
        w, hit, named = words(text), set(), set()
        for item, body in items:
            b = words(body)
            if not b:
                continue
            size = min(n, len(b))
            windows = {tuple(b[i:i + size]) for i in range(len(b) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    named.add(str(item))
        sha = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(named), sha, bool(hit))
    return out


def cases():
    rng = random.Random(1)
    vocabulary = ["the", "Éa", "x1", "9", "of", "and", "日本"]
    text = lambda k: rng.choice([" ", ", ", "\n", "--"]).join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, text(rng.randint(10, 16))) for i in range(12)] + [(12, "rare short"), (13, None), (14, "!!"), (15, "")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, f"{text(5)} {items[i][1].upper()}. {text(7)} {items[i + 1][1]}") for i in range(10)]
    docs += [(200, None), (201, ""), (202, "a RARE, short b"), (203, "rare" * 9 + " short"), (204, "zz " * 50_000 + items[0][1])]
    return docs, items


@pytest.mark.parametrize("block", [500_000, 7])
def test_equals_brute_force(spark, block):
    docs, items = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(frame, bench, block_windows=block).collect()
    want = brute(docs, items)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert any(x[4] for x in want.values()) and not all(x[4] for x in want.values())


def test_clean_documents_and_spans(spark):
    docs, items = cases()
    frame = spark.createDataFrame([(i, t, "k", i) for i, t in docs], "doc_id long, text string, _text string, _words long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    kept = clean_documents(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, t in docs if not want[i][4]}
    cut = {r.doc_id: r.text for r in without_spans(frame, bench).collect()}
    assert all(cut[i] == t for i, t in docs if not want[i][4])
    for i, t in docs:
        if want[i][4]:
            assert len(words(cut[i])) == want[i][0] - want[i][1]


def test_texts_go_to_python_once_and_in_small_batches(spark):
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('x y ', 1000) AS text")
    bench = spark.createDataFrame([(1, "x y z")], "item_id long, text string")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    found = ids_and_texts(docs).mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in found) == 4000 and max(r.bytes for r in found) < 5_000_000
    assert hit_rows(docs, bench, keep=["doc_id", "text"]).columns == ["doc_id", "text", "_words", "_ranges", "_items"]
    assert hit_rows(docs, bench).columns == ["doc_id", "_words", "_ranges", "_items"]
    spark.conf.set(BATCH_BYTES[0], "1m")
    try:  # the session's own size stays
        assert max(r.bytes for r in ids_and_texts(docs).mapInArrow(sizes, "n long, bytes long").collect()) < 1_200_000
    finally:
        spark.conf.unset(BATCH_BYTES[0])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string")
    assert contamination(none, bench).count() == 0
    assert [r.n_hit for r in contamination(docs, bench).collect()] == [0, 0, 0]
