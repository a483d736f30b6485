import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tickerloom.llm import packing
from tickerloom.llm.packing import bin_completion, best_fit, lower_bound

ROWS = "doc_id long, text string"


def expand(patterns):
    out = {}
    for pattern, times in patterns:
        for n in pattern:
            out[n] = out.get(n, 0) + times
    return out


def fewest(items, capacity):
    """Brute force: the least number of bins."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                go(k + 1, bins[:i] + [bins[i] + items[k]] + bins[i + 1:])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


def test_bin_completion_is_exact_on_small_sets():
    rng = random.Random(3)
    for _ in range(60):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = {n: items.count(n) for n in items}
        patterns = bin_completion(counts, 20)
        assert expand(patterns) == counts
        assert all(sum(p) <= 20 for p, _ in patterns)
        assert sum(m for _, m in patterns) == fewest(items, 20)


def test_bin_completion_beats_best_fit_where_that_wastes():
    counts = {6: 1, 5: 2, 4: 1, 3: 2, 2: 2}  # 30 in 3 bins of 10, best fit decreasing too
    assert sum(m for _, m in bin_completion(counts, 10)) == lower_bound(counts, 10) == 3
    hard = {7: 2, 6: 2, 5: 2, 4: 3, 3: 2}
    assert sum(m for _, m in bin_completion(hard, 12)) <= sum(m for _, m in best_fit(hard, 12))


def test_multiplicities_keep_large_counts_cheap():
    counts = {n: 10_000_000 + n for n in range(1, 2049, 3)}
    patterns = bin_completion(counts)
    assert expand(patterns) == counts
    assert len(patterns) < 20_000


def packed(spark, texts, capacity=2048):
    docs = spark.createDataFrame(list(enumerate(texts)), ROWS)
    return packing.pack(docs, capacity=capacity).toPandas()


def test_pieces_hold_the_library_ids_and_sequences_have_no_gaps(spark):
    rng = random.Random(5)
    odd = ["İstanbul ﬁne  é ́x", "a<|endoftext|>b <|startoftext|>", "", None, " \n\t ", "x y z\x1cq",
           "ΣΑΣ " * 30, "1234 don't I'LL", "日本語 текст 🎉🎉", "w" * 300, "word " * 5000]
    odd += [" ".join(rng.choice(["the", "cat's", "über", "12,5", "\n", "—", "Éa"]) for _ in range(rng.randint(0, 60)))
            for _ in range(60)]
    rows = packed(spark, odd, 64)
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    got = {(r.doc_id, r.piece): r for r in rows.itertuples()}
    for i, text in enumerate(odd):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            own = ids[at: at + 64]
            r = got.pop((i, k))
            assert (r.start, r.length) == (at, len(own))
            assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    assert not got
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        assert g.length.sum() <= 64


def test_empty_table_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([], ROWS)
    assert packing.pack(docs).count() == 0
    docs = spark.createDataFrame(
        [(1, "same", 9, 8), (1, "same", 9, 8), (None, None, 0, 0)], "doc_id long, text string, rank int, length int"
    )
    rows = packing.pack(docs).toPandas()
    assert len(rows) == 3 and rows.sequence_id.nunique() == 1


def test_dominated_fillings_take_up_no_branch():
    left = {3: 1, 4: 1, 5: 1, 7: 1, 12: 1}
    found = packing.completions(sorted(left), left, 13, 14, 4000)
    assert found[0] == [12]  # every other filling fits into the single length
    assert found == [[12]]
    assert packing.dominates([7, 5], [4, 3, 5]) and not packing.dominates([4, 3, 5], [7, 5])
