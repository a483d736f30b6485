import hashlib
import random
import zlib

import numpy as np

from tickerloom.llm.periodic_runs import (
    back_distances, document_runs, kept_words, periodic_runs, runs_of, stretches,
)
from tickerloom.llm.queries import with_repeated_tail


def brute(w, exponent=4, shortest=6):
    """Runs straight from the definition."""
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            own = w[s : s + n]
            smaller = any(own[p:] == own[:-p] for p in range(1, q))
            if n >= max(shortest, exponent * q) and not smaller:
                out.add((s, n, q))
    return sorted(out)


def repetitive(rng, most):
    w = []
    while len(w) < rng.randint(0, most):
        if rng.random() < 0.5:
            w += [rng.randrange(3) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
        else:
            w.append(rng.randrange(9))
    return [b"%d" % x for x in w]


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        w = repetitive(rng, 60)
        for exponent, shortest in ((4, 6), (3, 3), (5, 11)):
            want = brute(w, exponent, shortest)
            assert runs_of(w, exponent, shortest) == want
            spans = stretches(np.array(back_distances(w), np.int64), exponent, shortest)
            assert document_runs(w, spans, exponent, shortest) == want
        assert runs_of(w, 2, 2) == brute(w, 2, 2)


def test_long_repetitive_texts():
    assert runs_of([b"a"] * 60_000) == [(0, 60_000, 1)]
    assert runs_of([b"%d" % (i % 7000) for i in range(60_000)]) == [(0, 60_000, 7000)]
    # words of a Fibonacci string: every position has many squares, no fourth power
    a, b = "a", "ab"
    while len(b) < 20_000:
        a, b = b, b + a
    assert runs_of(b) == brute(b[:600]) == []


def expected(doc_id, text):
    words = with_repeated_tail(doc_id, (text or "").encode().split())
    runs = brute(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t).hexdigest()
    return (
        len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        sha("".join("%d,%d,%d\n" % r for r in runs).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def test_rows_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(x.decode() for x in repetitive(rng, 90)) for _ in range(80)]
    texts += [None, "", " \t\n\x0b", "a a a a a\x1ca", "la " * 9, "x  y\n" * 30, "é " * 6 + "ü", "w" * 70_000]
    rows = [(i, t, i, None) for i, t in enumerate(texts)] + [(None, "b " * 7, 0, "x"), (3, texts[3], 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, n_runs string")
    got = periodic_runs(docs, prepare=with_repeated_tail).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == expected(r.doc_id, "b " * 7 if r.doc_id is None else texts[r.doc_id])
    assert any(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and r.n_runs for r in got)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_collapsed_text(spark):
    docs = spark.createDataFrame([("k", "so la la la la la la it goes")], "doc_id string, text string")
    row = periodic_runs(docs, with_text=True).first()
    assert row.collapsed == "so la it goes" and [tuple(r) for r in row.runs] == [(1, 6, 1)]
    assert kept_words([b"x"], []) == [b"x"]
