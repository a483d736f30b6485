"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against all documents.

Every window of ``n`` consecutive benchmark words (an item with fewer words is one window) is
hashed; documents are scanned with rolling hashes, each hit is verified byte for byte, and
hit words are marked. One pass over the documents, no shuffle.

The hash set is broadcast in blocks of at most ``block_windows`` windows, so its size is
bounded whatever the benchmark's: a larger benchmark is scanned block after block in the same
stage, each block adding its hits to the row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.llm import grams
from tickerloom.llm.frames import byte_slices, ids_and_texts, in_parts, materialised, sub_batches

WINDOW = 10
BLOCK_WINDOWS = 500_000
FILTER_BITS = 22

_WINDOWS = "item string, n int, hash long, window binary"


def benchmark_windows(
    benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """Distinct (item, n, hash, window) of a benchmark; null texts have no words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches):
            raw, offsets = byte_slices(batch.column("text"))
            w = grams.words(raw, offsets, grams.ALPHANUMERIC)
            items = batch.column("doc_id").to_pylist()
            out: set[tuple] = set()
            counts = np.diff(w.first)
            for d, count in enumerate(counts.tolist()):
                if not count:
                    continue
                size = min(n, count)
                begin = np.arange(w.first[d], w.first[d + 1] - size + 1)
                hashes = w.hashes(begin, size).view(np.int64).tolist()
                out |= {(items[d], size, h, w.bytes_of(b, size))
                        for b, h in zip(begin.tolist(), hashes, strict=True)}
            rows = sorted(out, key=repr)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.binary()),
                ],
                names=["item", "n", "hash", "window"],
            )

    rows = ids_and_texts(benchmark, id_col, text_col)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInArrow(cut, _WINDOWS).distinct()


class WindowSet:
    """One block of benchmark windows: sorted hashes, a bit filter, the windows and their items."""

    def __init__(self, rows) -> None:
        by_window: dict[tuple[int, bytes], list[str]] = {}
        hash_of: dict[tuple[int, bytes], int] = {}
        for item, n, h, window in rows:
            key = (n, bytes(window))
            by_window.setdefault(key, []).append(item)
            hash_of[key] = h
        self.sizes = sorted({n for n, _ in by_window})
        self.by_hash: dict[int, dict[int, list[tuple[bytes, list[str]]]]] = {}
        self.sorted: dict[int, np.ndarray] = {}
        self.bits: dict[int, np.ndarray] = {}
        for size in self.sizes:
            table: dict[int, list] = {}
            for key, items in by_window.items():
                if key[0] == size:
                    table.setdefault(hash_of[key], []).append((key[1], items))
            self.by_hash[size] = table
            hashes = np.sort(np.array(list(table), np.int64).view(np.uint64))
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.sorted[size], self.bits[size] = hashes, bits

    def candidates(self, hashes: np.ndarray, size: int) -> np.ndarray:
        near = np.flatnonzero(self.bits[size][(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        table = self.sorted[size]
        at = np.minimum(np.searchsorted(table, hashes[near]), len(table) - 1)
        return near[table[at] == hashes[near]]


def _scan(rows: DataFrame, block, n_words: bool, text_col: str, wanted: list[str]) -> DataFrame:
    """Columns ``wanted`` of each row and the hit ranges (word begin, word end) and items of one block."""
    schema = T.StructType(
        [rows.schema[name] for name in wanted]
        + [
            T.StructField("_words", T.LongType()),
            T.StructField("_ranges", T.ArrayType(T.IntegerType())),
            T.StructField("_items", T.ArrayType(T.StringType())),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowSet = block.value
        for batch in sub_batches(batches, column=text_col):
            raw, offsets = byte_slices(pc.fill_null(batch.column(text_col), ""))
            w = grams.words(raw, offsets, grams.ALPHANUMERIC)
            n = batch.num_rows
            ranges: list[list[int]] = [[] for _ in range(n)]
            items: list[set[str]] = [set() for _ in range(n)]
            if not n_words:
                ranges = [list(x) for x in batch.column("_ranges").to_pylist()]
                items = [set(x) for x in batch.column("_items").to_pylist()]
            for size in windows.sizes:
                begin = w.runs(size)
                if not len(begin):
                    continue
                hashes = w.hashes(begin, size)
                for k in windows.candidates(hashes, size).tolist():
                    b = int(begin[k])
                    text = w.bytes_of(b, size)
                    for window, named in windows.by_hash[size][int(hashes[k : k + 1].view(np.int64)[0])]:
                        if window == text:
                            d = int(w.doc[b])
                            at = b - int(w.first[d])
                            ranges[d] += [at, at + size]
                            items[d].update(named)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(name) for name in wanted],
                    pa.array(np.diff(w.first), pa.int64()),
                    pa.array(ranges, pa.list_(pa.int32())),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                names=[*wanted, "_words", "_ranges", "_items"],
            )

    return rows.mapInArrow(scan, schema)


def _blocks(windows: DataFrame, block_windows: int) -> list:
    """Broadcasts of at most ``block_windows`` windows each, together all of them."""
    spark = windows.sparkSession
    stored = materialised(windows, "bench-windows")
    n = max(1, -(-stored.count() // block_windows))
    part = F.pmod(F.xxhash64("n", "window"), F.lit(n))
    return [
        spark.sparkContext.broadcast(
            WindowSet((r.item, r.n, r.hash, r.window) for r in stored.where(part == k).toLocalIterator())
        )
        for k in range(n)
    ]


def hit_rows(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    block_windows: int = BLOCK_WINDOWS, keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` of each row plus _words, _ranges and _items; the text goes to Python once,
    and comes back only if it is kept or another block is to read it."""
    kept = keep if keep is not None else [id_col]
    text = text_col if text_col in kept else "_text"
    rows = in_parts(docs).select(*kept, *([] if text in kept else [F.col(text_col).alias(text)]))
    windows = benchmark_windows(benchmark, n, item_col, item_text)
    blocks = _blocks(windows, block_windows)
    for k, block in enumerate(blocks):
        wanted = kept if text in kept or k == len(blocks) - 1 else [*kept, text]
        rows = _scan(rows, block, k == 0, text, wanted)
    return rows


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words and no hits; a null doc_id stays null; repeated rows are judged
    one by one; an empty benchmark hits nothing. ``items_sha256`` is of the empty text where
    no item occurs. Null item ids count as no item, but their windows still hit.
    """
    rows = hit_rows(docs, benchmark, n, id_col, text_col, item_col, item_text, block_windows)
    out = "doc_id {}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    kind = docs.schema[id_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, items, shas = [], [], []
            for ranges, named in zip(
                batch.column("_ranges").to_pylist(), batch.column("_items").to_pylist(), strict=True
            ):
                hit.append(_covered(ranges))
                names = sorted({x for x in named if x is not None})
                items.append(len(names))
                shas.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column("_words"), pa.array(hit, pa.int64()),
                    pa.array(items, pa.int64()), pa.array(shas, pa.string()),
                    pa.array([h > 0 for h in hit], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    rows = rows.select(F.col(id_col).alias("doc_id"), "_words", "_ranges", "_items")
    return rows.mapInArrow(digest, out.format(kind))


def _covered(ranges: list[int]) -> int:
    """Words inside the union of the ranges."""
    total, reach = 0, 0
    for begin, end in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        if end > reach:
            total += end - max(begin, reach)
            reach = end
    return total


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` without the contaminated documents; all columns and clean rows stay as they are."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    rows = hit_rows(plain, benchmark, n, names[0], text, item_col, item_text, block_windows, keep=names)
    return rows.where(F.size("_ranges") == 0).select(*names).toDF(*docs.columns)


def without_spans(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` with the hit words cut out of the text, from the first byte of each run of hit
    words to the last; everything else stays byte for byte."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    rows = hit_rows(plain, benchmark, n, names[0], text, item_col, item_text, block_windows, keep=names)

    @F.pandas_udf("string")
    def cut(texts, ranges):
        import pandas as pd

        return pd.Series([
            t if t is None or not len(r) else cut_words(t, list(r))
            for t, r in zip(texts, ranges, strict=True)
        ])

    return rows.withColumn(text, cut(text, "_ranges")).select(*names).toDF(*docs.columns)


def cut_words(text: str, ranges: list[int]) -> str:
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    inside = grams.ALPHANUMERIC[grams._LOWER[data]]
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, reach = [], 0
    merged: list[list[int]] = []
    for begin, end in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([begin, end])
    for begin, end in merged:
        out.append(raw[reach : starts[begin]])
        reach = ends[end - 1]
    return (b"".join(out) + raw[reach:]).decode()
