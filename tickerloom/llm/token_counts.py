"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as a chain of byte symbols. A heap holds the ranks of adjacent pairs; the
lowest is popped, stale entries are skipped, the pair is merged and the two new neighbours are
pushed. The count is the initial symbols minus the merges: no identifiers are made. Counts of
frequent chunks are kept per worker.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.frames import byte_slices, ids_and_texts, sub_batches, texts_of

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
KEPT_CHUNKS = 400_000
LONGEST_KEPT = 64

#: Fixed value: the split pattern of the byte-level vocabulary.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than the blank and the line feed; texts with it are split as a whole.
ODD_SPACE = (
    "[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return [letters[b] for b in range(256)]


class Spaced(dict):
    """Token counts of a blank and the piece of text up to the next blank."""

    def __init__(self, counter: MergeCounter) -> None:
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        count = self.counter.whole(" " + piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= KEPT_CHUNKS:
                self.clear()
            self[piece] = count
        return count


class MergeCounter:
    """Counts tokens of texts under one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        number: dict[str, int] = {}
        name = lambda s: number.setdefault(s, len(number))
        self.first = [name(c) for c in byte_letters()]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(name(left) << 20 | name(right), (rank, name(left + right)))
        special = [t["content"] for t in spec["added_tokens"]]
        longest = sorted(special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest))) if special else None
        self.special_names = tuple(special)
        self.pre_tokens = regex.compile(PRE_TOKENS)
        self.odd_space = re.compile(ODD_SPACE)
        self.spaced = Spaced(self)

    def merged(self, word: bytes) -> int:
        """Tokens of one pre-token: symbols minus merges."""
        n = len(word)
        if n < 2:
            return n
        symbols = [self.first[b] for b in word]
        merges = self.merges
        heap = []
        for i in range(n - 1):
            found = merges.get(symbols[i] << 20 | symbols[i + 1])
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        count = n
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, left, right, new = pop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged away meanwhile
            symbols[i] = new
            symbols[j] = -1
            k = after[j]
            after[i] = k
            count -= 1
            if k < n:
                before[k] = i
                found = merges.get(new << 20 | symbols[k])
                if found:
                    push(heap, (found[0], i, new, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get(symbols[h] << 20 | new)
                if found:
                    push(heap, (found[0], h, symbols[h], new, found[1]))
        return count

    def whole(self, text: str) -> int:
        parts = self.pre_tokens.findall(text)
        if len(parts) > 8:
            return sum(self.merged(p.encode()) * n for p, n in Counter(parts).items())
        return sum(self.merged(p.encode()) for p in parts)

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        Where blanks stand alone, no pre-token reaches across the place before a blank, so the
        text is the sum of its pieces. Runs of blanks and other white space are split whole.
        """
        if "  " in text or text.endswith(" ") or self.odd_space.search(text):
            return self.whole(text)
        head, *pieces = text.split(" ")
        return self.whole(head) + sum(map(self.spaced.__getitem__, pieces))

    def count(self, text: str) -> int:
        if self.special is None or not any(s in text for s in self.special_names):
            return self.plain(text)
        ends = [0, *(x for m in self.special.finditer(text) for x in m.span()), len(text)]
        between = [text[a:b] for a, b in list(pairwise(ends))[::2]]
        return len(between) - 1 + sum(map(self.plain, between))


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(
    docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; special strings inside a text are one
    token each, as the library takes them. Null keys, repeated rows and further columns do
    not matter; an empty table gives an empty result. One pass, no shuffle.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    rows = ids_and_texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in sub_batches(batches):
            sizes = byte_slices(batch.column("text"))[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes[1:] - sizes[:-1], pa.int64()),
                    pa.array([own.count(t) for t in texts_of(batch.column("text"))], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
