import random

import public_tokenizers
from tokenizers import Tokenizer

from tickerloom.llm.token_counts import VOCABULARY, MergeCounter, token_counts

PIECES = [" ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "don't", "'LL", "é", "日本", "½", "Ⅷ", "12",
          "a", "Hello", "world", " the", "<|endoftext|>", "<|endof", "!!", "🎉", "́", "٣", "_", "x" * 70, "\r\n",
          " \n", " \n ", "\n\n  ", "ª"]


def library():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def test_counts_equal_the_library():
    rng, own, lib = random.Random(2), MergeCounter(public_tokenizers.path(VOCABULARY)), library()
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        assert own.count(text) == len(lib.encode(text, add_special_tokens=False).ids), repr(text)


def test_rows(spark):
    long = "word, other.\n" * 30_000
    cases = [(1, None), (2, ""), (3, "é <|endoftext|>"), (3, "é <|endoftext|>"), (None, "x " * 600), (5, long), (6, "q" * 20_000)]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in cases], "doc_id long, text string, n_bytes string, n_tokens int")
    rows = token_counts(docs).collect()
    lib = library()
    want = sorted(
        (str(i), len((t or "").encode()), k := len(lib.encode(t or "", add_special_tokens=False).ids), k > 512)
        for i, t in cases
    )
    assert sorted((str(r.doc_id), *r[1:]) for r in rows) == want
    assert token_counts(docs.limit(0)).count() == 0
