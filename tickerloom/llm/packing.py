"""Best-fit packing of token pieces into sequences by bin completion on a length histogram.

Lengths are integers up to the capacity, so a corpus of any size is a histogram of at most
``capacity`` counts, and packing it is a cutting-stock problem. The search works on that
histogram alone: it yields patterns (a multiset of lengths) with multiplicities. Spark counts
the histogram, ranks the pieces of each length across all partitions and sends every piece to
its slot. Whatever the corpus, the driver holds a few thousand numbers.

Pattern search (bin completion): take the largest length left; enumerate the undominated
fillings of the room beside it, cheapest waste first; prune branches whose waste cannot beat
the incumbent; a best-fit packing is the first incumbent, and a packing that meets the lower
bound ends the search. A pattern is applied as often as its lengths allow at once.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.frames import ids_and_texts, materialised, sub_batches, texts_of

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Chunks of text that a worker remembers, in each of two generations.
KEPT_WORDS = 400_000
LONGEST_KEPT = 48
#: Stands between chunks that are tokenized together; chunks that hold it go alone.
BETWEEN = "~"
#: Most words and about the most letters of one call.
TOGETHER = 2000
LETTERS = 50_000

Pattern = tuple[int, ...]


# ---------------------------------------------------------------- tokens

#: ASCII marks without the apostrophe, with which contractions begin.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def parted(chunk: str) -> tuple[str, str]:
    """A chunk as its lower-cased word and the marks behind it, which together have the same ids.

    The tokenizer lower-cases and parts words from marks. Only what is Latin-1 is lower-cased
    here, where Python's rules are the tokenizer's, and only marks behind a letter are
    parted. Special strings are left to the tokenizer as they are.
    """
    try:
        chunk.encode("latin-1")
    except UnicodeEncodeError:
        return chunk, ""
    if "<|" in chunk:
        return chunk, ""
    low = chunk.lower()
    word = low.rstrip(MARKS)
    return (word, low[len(word):]) if word[-1:].isalpha() else (low, "")


def _groups(words: list[str]) -> Iterator[list[str]]:
    """Lists of at most TOGETHER words, which end with the word that makes LETTERS letters."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    k = 0
    while k < len(words):
        full = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + LETTERS))
        end = min(full + 1, k + TOGETHER)
        yield words[k:end]
        k = end


class WordIds(dict):
    """Bytes of the ids (little-endian, 32 bits) of blank-free chunks of text.

    The tokenizer treats white space as a break, so a text's ids are those of its chunks
    between blanks one after another. Chunks that are not known are tokenized many at a time,
    as one text in which a mark of a single id stands between them. When the younger generation
    is full it becomes the older one, which goes; what is met again is taken over.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.aged: dict[str, bytes] = {}
        self.kept = KEPT_WORDS
        mark = self._encode(BETWEEN)
        self.mark = int(mark[0]) if len(mark) == 1 else None
        # whether this vocabulary lower-cases and parts marks at all
        self.parts = all(
            np.array_equal(self._encode(a), self._encode(b))
            for m in [*MARKS, "!!", "***", ").", "$$$"]
            for a, b in ((f"AbÉ{m} Cd", f"abé {m} cd"), (f"Xy{m}", f"xy {m}"), (f"Xy{m}ßa", f"xy {m} ßa"))
        )
        self[""] = b""

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text."""
        if len(self) > self.kept:
            self.aged = dict(self)
            self.clear()
            self[""] = b""
        chunks: list[str] = []
        ends = [0]
        for text in texts:
            chunks += text.replace("\n", " ").split(" ")
            ends.append(len(chunks))
        found = list(map(self.get, chunks))
        new = [i for i, ids in enumerate(found) if ids is None]
        unknown = set(map(chunks.__getitem__, new))
        long = {w for w in unknown if len(w) > LONGEST_KEPT}
        self._learn(unknown - long)
        passing = self._tokenize(long)
        for i in new:
            ids = self.get(chunks[i])
            found[i] = passing[chunks[i]] if ids is None else ids
        for start, end in pairwise(ends):
            yield b"".join(found[start:end])

    def _learn(self, chunks: set[str]) -> None:
        aged, fresh = self.aged, set()
        chunked, words, marks = [], [], []  # no tuples: many would call for garbage collections
        for chunk in chunks:
            ids = aged.get(chunk)
            if ids is not None:
                self[chunk] = ids
                continue
            word, mark = parted(chunk) if self.parts else (chunk, "")
            if word not in self:
                if word in aged:
                    self[word] = aged[word]
                else:
                    fresh.add(word)
            if mark and mark not in self:
                fresh.add(mark)
            if word != chunk:
                chunked.append(chunk)
                words.append(word)
                marks.append(mark)
        self.update(self._tokenize(fresh))
        for i, chunk in enumerate(chunked):
            self[chunk] = self[words[i]] + self[marks[i]]

    def _tokenize(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word, many in one call; at most TOGETHER words or LETTERS letters a call."""
        alone = [w for w in words if self.mark is None or BETWEEN in w]
        out = {w: self[w] for w in alone}
        rest = words.difference(alone)
        # between words of letters alone the mark needs no blanks around it
        plain = list(filter(str.isalpha, rest))
        for some, between in ((plain, BETWEEN), (list(rest.difference(plain)), f" {BETWEEN} ")):
            for together in _groups(some):
                ids = self._encode(between.join(together))
                ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
                data, start = ids.tobytes(), 0
                for w, end in zip(together, ends, strict=True):
                    out[w] = data[4 * start : 4 * end]
                    start = end + 1
        return out

    def __missing__(self, chunk: str) -> bytes:
        return self._encode(chunk).tobytes()


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str, kept: int = KEPT_WORDS) -> WordIds:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    _word_ids[path].kept = kept
    return _word_ids[path]


_PIECES = (
    "doc_id {}, piece int, start long, length long, ids_crc32 long, part int, rank long{}"
)


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, kept_words: int = KEPT_WORDS,
) -> DataFrame:
    """Token pieces of at most ``capacity``; ``part`` and ``rank`` number those of a length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer, kept_words)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        stop = np.array([end_id], "<u4").tobytes()
        for batch in sub_batches(batches):
            row, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            for i, data in enumerate(words.of(texts_of(batch.column("text")))):
                data += stop
                total = len(data) // 4
                for k, at in enumerate(range(0, total, capacity)):
                    own = data[4 * at : 4 * (at + capacity)]
                    size = len(own) // 4
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(own))
                    rank.append(int(seen[size]))
                    seen[size] += 1
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int32))
            columns = [
                batch.column("doc_id").take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = ids_and_texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, _PIECES.format(kind, ", ids array<int>" if with_ids else ""))


# ---------------------------------------------------------------- search on the histogram

def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and by the items too large to share (L2)."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    for k in sorted({n for n in counts if 2 * n <= capacity} | {0}):
        big = sum(c for n, c in counts.items() if n > capacity - k)
        mid = [(n, c) for n, c in counts.items() if capacity - k >= n and 2 * n > capacity]
        small = sum(n * c for n, c in counts.items() if k <= n and 2 * n <= capacity)
        n_mid = sum(c for _, c in mid)
        room = n_mid * capacity - sum(n * c for n, c in mid)
        best = max(best, big + n_mid + max(0, -(-(small - room) // capacity)))
    return best


def _best_fit(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """Fills ``room`` with the largest length that fits, again and again."""
    out: list[int] = []
    taken: dict[int, int] = {}
    at = bisect_right(lengths, room) - 1
    while room and at >= 0:
        n = lengths[at]
        if n <= room and left[n] > taken.get(n, 0):
            out.append(n)
            taken[n] = taken.get(n, 0) + 1
            room -= n
        else:
            at -= 1
        at = min(at, bisect_right(lengths, room) - 1)
    return out


def dominates(one: list[int], other: list[int]) -> bool:
    """The lengths of ``other`` fit into those of ``one``, one or several into each.

    Common lengths stand for themselves; the rest are placed first-fit, largest first, so a
    yes is always right.
    """
    rest = Counter(other) - Counter(one)
    rooms = sorted((Counter(one) - Counter(other)).elements())
    for n in sorted(rest.elements(), reverse=True):
        at = next((k for k, room in enumerate(rooms) if n <= room), -1)
        if at < 0:
            return False
        rooms[at] -= n
    return True


def completions(
    lengths: list[int], left: dict[int, int], room: int, waste: int, nodes: int, most: int | None = None,
    spent: list[int] | None = None,
) -> list[list[int]]:
    """Undominated fillings of ``room`` of waste below ``waste``, least waste first, ``most`` of them.

    A filling is dominated if its lengths fit into those of another found one, one or several
    into each, or if a length outside fits in its waste: such fillings never beat the one that
    dominates them. At most ``nodes`` steps are made, with 24 lengths in each; ``spent`` (one
    number) is raised by those made.
    """
    found: list[tuple[int, list[int]]] = []
    budget = [nodes]

    def extend(at: int, room: int, chosen: list[int]) -> None:
        if budget[0] <= 0:
            return
        budget[0] -= 1
        at = min(at, bisect_right(lengths, room) - 1)
        used = chosen.count(lengths[at]) if at >= 0 else 0
        while at >= 0 and left[lengths[at]] <= used:
            at -= 1
            used = chosen.count(lengths[at]) if at >= 0 else 0
        if at < 0:
            if room < waste:
                found.append((room, list(chosen)))
            return
        tries = 0
        while at >= 0 and budget[0] > 0 and tries < 24:
            n = lengths[at]
            if left[n] > chosen.count(n):
                tries += 1
                chosen.append(n)
                extend(at, room - n, chosen)
                chosen.pop()
                if found and found[-1][0] == 0:
                    return
            at -= 1

    extend(len(lengths) - 1, room, [])
    if spent is not None:
        spent[0] += nodes - budget[0]
    kept: list[tuple[int, list[int]]] = []
    for spare, chosen in sorted(found, key=lambda x: (x[0], len(x[1]), [-n for n in x[1]])):
        at = bisect_right(lengths, spare) - 1
        fits = next((lengths[i] for i in range(at, -1, -1) if left[lengths[i]] > chosen.count(lengths[i])), 0)
        if not fits and not any(dominates(x[1], chosen) for x in kept):
            kept.append((spare, chosen))
            if len(kept) == most:
                break
    return [x[1] for x in kept]


def _apply(left: dict[int, int], pattern: list[int], most: int | None = None) -> int:
    """Takes ``pattern`` as often as it goes (at most ``most`` times) from ``left``."""
    need: dict[int, int] = {}
    for n in pattern:
        need[n] = need.get(n, 0) + 1
    times = min(left[n] // k for n, k in need.items())
    times = times if most is None else min(times, most)
    for n, k in need.items():
        left[n] -= k * times
        if not left[n]:
            del left[n]
    return times


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of a best-fit decreasing packing with their multiplicities."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        lengths = sorted(left)
        top = lengths[-1]
        left[top] -= 1
        pattern = [top, *_best_fit(lengths, left, capacity - top)]
        left[top] += 1
        out.append((tuple(pattern), _apply(left, pattern)))
    return out


def bin_completion(
    counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 400, branches: int = 3,
    searches: int = 200, effort: int = 100_000,
) -> list[tuple[Pattern, int]]:
    """Patterns with multiplicities that hold every piece in as few bins as the search finds.

    ``counts`` maps lengths (1..capacity) to numbers of pieces. ``nodes`` bounds a single
    enumeration, ``searches`` the completions tried after the first descent and ``effort`` the steps
    of all enumerations together (a bin costs one more for each 50 lengths left), which are what
    takes time. When the effort is used up, what is left is filled by best fit, and the
    incumbent (never worse than best fit) is returned.
    """
    bound = lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    fewest = sum(m for _, m in incumbent)
    if fewest <= bound:
        return incumbent
    spare_most = fewest * capacity - sum(n * c for n, c in counts.items())
    budget = [searches]
    spent = [0]

    def descend(left: dict[int, int], bins: int, spare: int, done: list) -> None:
        nonlocal incumbent, fewest, spare_most
        left, done = dict(left), list(done)
        while left:
            # every finished bin's waste counts; beyond the incumbent's less one bin it is lost
            if spare > spare_most - capacity:
                return
            if spent[0] >= effort:
                rest = best_fit(left, capacity)
                bins += sum(m for _, m in rest)
                done += rest
                break
            lengths = sorted(left)
            top = lengths[-1]
            left[top] -= 1
            options = completions(lengths, left, capacity - top, capacity - top + 1, nodes, branches, spent) or [[]]
            spent[0] += 1 + len(lengths) // 50
            left[top] += 1
            for other in options[1:branches]:
                if budget[0] <= 0 or fewest <= bound:
                    break
                budget[0] -= 1
                trial = dict(left)
                pattern = [top, *other]
                times = _apply(trial, pattern)
                descend(trial, bins + times, spare + times * (capacity - sum(pattern)),
                        [*done, (tuple(pattern), times)])
                if spent[0] >= effort:
                    return  # the branch below has been completed; there is none left for this one
            pattern = [top, *options[0]]
            times = _apply(left, pattern)
            bins += times
            spare += times * (capacity - sum(pattern))
            done.append((tuple(pattern), times))
        if bins < fewest:
            incumbent, fewest = done, bins
            spare_most = fewest * capacity - sum(n * c for n, c in counts.items())

    descend({n: c for n, c in counts.items() if c}, 0, 0, [])
    return incumbent


def slots(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For every length its intervals of ranks: first rank, first sequence, offset in it."""
    rows: list[tuple[int, int, int, int]] = []
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


# ---------------------------------------------------------------- operator

def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, kept_words: int = KEPT_WORDS,
) -> DataFrame:
    """Pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single token ``end_id``; rows that repeat a doc_id are packed
    one by one; ties between equal lengths fall as the input partitions lie, which changes
    places but not the number of sequences. ``tokenizer`` is a path; default is the word-end
    BPE of the installed public vocabularies. ``with_ids`` adds the ids themselves. A worker
    remembers up to twice ``kept_words`` chunks of text (about 0.2 KB each), which changes its
    speed only.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    cut = materialised(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids, kept_words), "pieces")
    by_part = materialised(
        cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts"
    )
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(bin_completion(counts, capacity)) if counts else slots([])
    # ranks of a length go on from part to part; there are at most capacity x parts rows
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")
    )
    ranked = cut.join(offsets, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # a few rows for each length
    names = [f.name for f in cut.schema.fields if f.name not in ("part", "rank")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        wide = np.int64(1 << 40)
        key = t["length"] * wide + t["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length * wide + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array(t["sequence"][at] + rank - t["rank"][at]),
                    pa.array(t["offset"][at]),
                ],
                names=[*names, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name in names)
    return ranked.select(*names, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")
