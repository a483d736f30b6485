import random
import re
from itertools import combinations

import numpy as np
import pytest

from tickerloom.llm import grams, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def brute(docs, n):
    sets = {i: shingles(t, n) for i, t in docs}
    head = {i: i for i in sets}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        s, t = sets[a], sets[b]
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            x, y = sorted((root(a), root(b)))
            head[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def cases(seed, copies):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 6)))
    out = ["", None, " \t\n", "one", "ONE ", "one two", "One Two", "x " * 40_000, "x y " * 9_000]
    base = [word() for _ in range(120)]
    for _ in range(copies):  # a group whose members are not all alike
        out.append(" ".join(word() if rng.random() < 0.04 else w for w in base))
    for _ in range(40):
        own = [word() for _ in range(rng.randint(1, 40))]
        out.append(" ".join(own))
        if rng.random() < 0.6:
            own[rng.randrange(len(own))] = word()
            out.append("  ".join(own).upper())
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("n", "seed"), [(2, 1), (5, 2)])
def test_equals_brute_force(spark, n, seed):
    docs = cases(seed, 60)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = minhash.near_duplicates(frame, n).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == brute(docs, n)


def test_estimate_is_close_to_the_similarity():
    rng = np.random.default_rng(4)
    for similar in (0.5, 0.8, 0.95):
        union = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        both = int(similar * 4000)
        rest = (4000 - both) // 2
        a = np.concatenate([union[:both], union[both:both + rest]])
        b = np.concatenate([union[:both], union[both + rest:]])
        x, y = (minhash.packed(minhash.minima(grams.mix(s))).view(np.uint64) for s in (a, b))
        d = x ^ y
        agree = np.bitwise_count(~(d | d >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum()
        got = (agree / minhash.MINIMA - 0.25) / 0.75
        assert abs(got - similar) < minhash.MARGIN


def test_filter_nulls_repeats_and_empty(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = spark.createDataFrame(
        [(5, text, "r", 1), (7, text + " za", "r", 2), (None, text, "r", 3), (7, text + " za", "r", 4), (9, None, "r", 5)],
        "doc_id long, text string, vid string, key int",
    )
    rows = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2).collect()}
    assert rows == {(5, 5, True), (7, 5, False), (None, 5, False), (9, 9, True)}
    kept = minhash.near_dedup(docs, 2)
    assert kept.columns == docs.columns
    assert sorted(r.key for r in kept.collect()) == [1, 3, 5]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_texts_of_null_keys_link_others(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [(1, words), (None, words[:54]), (2, words[:48]), (None, ["x", *words[40:]]), (None, ["x", *words[40:], "y"])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    got = minhash.near_duplicates(docs, shingle=1, similar=85).collect()
    # 1 and 2 are 48/60 alike, but both are like the text without a key between them
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.n_shingles >= 48) == [
        (48, 1, False), (54, 1, False), (60, 1, True)
    ]
    assert [(r.component_id, r.kept) for r in got if r.n_shingles < 48] == [(None, True)] * 2


def test_group_around_the_threshold_equals_brute_force(spark):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(200)]
    docs = []
    for i in range(160):  # similarities of pairs lie between 0.7 and 0.95
        own = base[:]
        for at in rng.sample(range(200), rng.randint(8, 20)):
            own[at] = f"v{rng.randrange(40)}"
        docs.append((i, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = minhash.near_duplicates(frame, 1).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == brute(docs, 1)


def test_filter_with_clashing_names(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = spark.createDataFrame([(5, text, 1, 2), (7, text + " za", 3, 4)], "doc_id long, text string, _gone long, key long")
    assert [tuple(r) for r in minhash.near_dedup(docs, 2).collect()] == [(5, text, 1, 2)]


def crowd(seed, size, least, most, words=200):
    """Texts whose words are those of one of two bases but for some; most are linked with a base only."""
    rng = random.Random(seed)
    bases = [[f"w{k}" for k in range(words)], [f"w{k}" if k % 8 else f"u{k}" for k in range(words)]]
    out = [" ".join(b) for b in bases]
    for i in range(size):
        own = bases[i % 2][: words - rng.choice([0, 0, 3, 9])]
        for at in rng.sample(range(len(own)), rng.randint(least, most)):
            own[at] = f"v{rng.randrange(1 << 30)}"
        out.append(" ".join(own))
    return list(enumerate(out))


def test_crowd_of_near_copies_is_not_paired(spark, monkeypatch):
    docs = crowd(3, 400, 8, 40)
    counts = []
    kept = minhash.materialised

    def counted(df, name="table"):
        out = kept(df, name)
        if name == "mh-pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialised", counted)
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 1).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == brute(docs, 1)
    assert counts[-1] < 5 * len(docs)  # of about 80,000 pairs


@pytest.mark.parametrize("similar", [80, 85, 50])
def test_pairs_of_crowded_buckets_hold_every_link(spark, similar):
    rng = np.random.default_rng(similar)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    sets = []
    for _ in range(120):
        own = rng.choice(base, rng.integers(60, 121), replace=False)
        more = rng.integers(0, 40, rng.integers(0, 12)).astype(np.uint64)  # few values, so some are shared
        sets.append(np.unique(np.concatenate([own, more])))
    held = spark.createDataFrame([(v, bytearray(s.tobytes())) for v, s in enumerate(sets)], "vid long, set binary")
    comp = [int(c) for c in rng.integers(0, 50, len(sets))]
    placed = spark.createDataFrame(
        [(key, v, 1000 + comp[v], 100 + v, len(sets[v])) for key in (7, 8) for v in range(key == 8, len(sets))],
        "key long, vid long, comp long, fullness long, n long",
    )
    found = [tuple(r) for r in minhash._pairs_of_many(placed, held, similar).collect()]
    linked = set()
    for a, b in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if comp[a] != comp[b] and 100 * both >= similar * (len(sets[a]) + len(sets[b]) - both):
            linked.add((a, b))
    assert linked and linked <= set(found)
    assert len(set(found)) == len(found)
    assert all(a < b and comp[a] != comp[b] for a, b in found)
