import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tickerloom.llm.queries import without_a_letter
from tickerloom.llm.spelling import SPAN, _common, _continued, roots, spelling_variants, trie_nodes

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, factor=10, shortest=7, fewest=2, change=True):
    """Rows straight from the definition; neighbours by comparing all words."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if change and doc_id is not None and h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += len(run) >= shortest
    words = {w: n for w, n in counts.items() if n >= fewest}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = defaultdict(list)
    for a in words:
        for b in words:
            if near(a, b):
                by[a].append(b)
    form = {}
    for w in words:
        best = min(by[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= factor * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(by[w]), words.get(form.get(w))))
    return out


def rows_of(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def noisy_texts(rng, n):
    stems = ["banaaana", "straße", "ÉCOLEabc", "aaaaaaaa", "abcdefgh", "abcdefghi", "naïveté", "ÿÿÿÿÿÿÿ"]
    texts = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems[: 2 + i % 7])
            if rng.random() < 0.25:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("axÿ") + w[k + 1 :]])
            words.append(w)
        texts.append(rng.choice([" ", "1", ", "]).join(words))
    return texts


def test_rows_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(noisy_texts(rng, 120))]
    rows += [(500, None), (501, ""), (None, "Banaaana banaaana"), (3, rows[3][1]), (502, "q" * 40_000), (503, "q" * 40_000 + "r")]
    rows += [(504, "q" * 40_000), (505, "q" * 40_000 + "r")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    want = brute(rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several tasks, whatever the size
    try:
        assert rows_of(spelling_variants(docs, change=without_a_letter)) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(f is not None for _, f, *_ in want) > 5 and any(r[4] > 3 for r in want)
    assert rows_of(spelling_variants(docs, change=without_a_letter)) == want
    assert rows_of(spelling_variants(docs, factor=2, shortest=8, fewest=1)) == brute(rows, 2, 8, 1, False)
    assert spelling_variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(docs, factor=1)


def test_chain_of_forms(spark):
    text = " ".join(["abcdefgh"] * 900 + ["abcdefgx"] * 80 + ["abcdefxx"] * 7 + ["abcdexxx"] * 2)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = {r.word: (r.form, r.root) for r in spelling_variants(docs, factor=3).collect()}
    assert rows == {
        "abcdefgh": (None, "abcdefgh"), "abcdefgx": ("abcdefgh", "abcdefgh"),
        "abcdefxx": ("abcdefgx", "abcdefgh"), "abcdexxx": ("abcdefxx", "abcdefgh"),
    }
    forms = spark.createDataFrame([(i, i + 1) for i in range(9)], "id long, form long")
    assert {r.root for r in roots(forms).collect()} == {9}


def test_nodes_agree_where_words_do(spark):
    words = sorted({a + b + c for a in ("", "ab", "abab") for b in "abcd" for c in ("", "x", "xyx", "xyy")})
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = trie_nodes(frame).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    node = {}
    for r in rows:
        for i, number in enumerate(r.nodes):
            assert node.setdefault(r.word[: i + 1], number) == number
    assert len(set(node.values())) == len(node)
    assert [r.word for r in sorted(rows, key=lambda r: r.id)] == words
    assert _common("abc", "abd") == 2 and _common("", "a") == 0 and _common("ab", "ab") == 2


def test_nodes_go_on_over_several_tasks():
    # one word a task, all of them below "ab"
    ends = [(0, "aba", "aba", [0, 1, 2]), (2, "abb", "abb", [2 * SPAN + i for i in range(3)]),
            (5, "abbc", "abd", [5 * SPAN, 5 * SPAN + 1, 5 * SPAN + 7]), (6, "b", "b", [6 * SPAN])]
    assert _continued(ends) == [(0, []), (2, [0, 1]), (5, [0, 1, 2 * SPAN + 2]), (6, [])]
