"""Runs of repeated words: a suffix automaton whose suffix links form a link-cut tree.

A run is a stretch of consecutive words with smallest period q that no neighbouring word
extends; wanted are runs of at least ``exponent`` periods and ``shortest`` words.

Words are appended to a suffix automaton one by one. The suffixes of what has been read are
the path from the root of the suffix-link tree to the newest state. A link-cut tree keeps that
tree as preferred paths, each with one colour: the position where its strings ended last. An
access from the newest state walks the path segment by segment; a segment whose deepest state
holds suffixes of up to l words and ended last d words ago says that the last l + d words have
period d, and no longer suffix does. With l >= d that is a square; stretches of the same
start and period are one run, which ends where they end. The walk recolours the path with the
present position; it costs O(log n) amortised, whatever repeats in the text.

Where a run of period q and exponent e goes on for its first q words, every word stands at most q
places after its last occurrence, for (e - 1) q places. Stretches where that cannot hold are
cut away first, exactly and for all rows of a batch together, so that the automaton reads
only what may lie in a run. Texts never leave their row: no shuffle.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickerloom.llm.frames import ids_and_texts, sub_batches

EXPONENT = 4
SHORTEST = 6

#: start, length, period
Run = tuple[int, int, int]
Prepare = Callable[[object, list[bytes]], list[bytes]]


# ---------------------------------------------------------------- suffix automaton

class RunFinder:
    """Suffix automaton over hashable symbols with link-cut access along suffix links.

    States are numbers; state 0 is the root. Most states have one transition, which lies in
    two arrays; further ones are in a dictionary of their own. ``up``, ``low`` and ``high`` are
    the splay trees of the preferred paths (``low``: nearer the root of the link tree); the
    ``up`` of a splay root is its path's parent state. ``ended`` holds for splay roots only.
    """

    def __init__(self, exponent: int = EXPONENT) -> None:
        self.exponent = exponent
        self.size = array("i", [0])
        self.link = array("i", [-1])
        self.symbol = array("i", [-1])
        self.target = array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.up = array("i", [-1])
        self.low = array("i", [-1])
        self.high = array("i", [-1])
        self.ended = array("i", [-1])
        self.newest = 0
        self.codes: dict = {}
        self.ends: dict[tuple[int, int], int] = {}

    def _state(self, size: int, link: int, symbol: int, target: int, ended: int) -> int:
        self.size.append(size)
        self.link.append(link)
        self.symbol.append(symbol)
        self.target.append(target)
        self.up.append(link)
        self.low.append(-1)
        self.high.append(-1)
        self.ended.append(ended)
        return len(self.size) - 1

    def _step(self, state: int, code: int) -> int:
        if self.symbol[state] == code:
            return self.target[state]
        more = self.more.get(state)
        return more.get(code, -1) if more else -1

    def _point(self, state: int, code: int, to: int) -> None:
        own = self.symbol[state]
        if own == code or own < 0:
            self.symbol[state], self.target[state] = code, to
        else:
            self.more.setdefault(state, {})[code] = to

    def _splay(self, x: int) -> None:
        """Makes ``x`` the root of the splay tree of its preferred path."""
        up, low, high = self.up, self.low, self.high
        while True:
            p = up[x]
            if p < 0:
                return
            left = low[p] == x
            if not left and high[p] != x:
                return
            g = up[p]
            inner = g >= 0 and (low[g] == p or high[g] == p)
            if inner:
                # straight: parent first, bent: x twice
                self._rotate(p if (low[g] == p) == left else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, low, high = self.up, self.low, self.high
        p = up[x]
        g = up[p]
        if low[p] == x:
            child = high[x]
            low[p] = child
            high[x] = p
        else:
            child = low[x]
            high[p] = child
            low[x] = p
        if child >= 0:
            up[child] = p
        up[p] = x
        up[x] = g
        if g >= 0 and low[g] == p:
            low[g] = x
        elif g >= 0 and high[g] == p:
            high[g] = x
        else:
            self.ended[x] = self.ended[p]  # the colour of a path lies at its splay root

    def append(self, symbol, at: int) -> None:
        """Reads the symbol at position ``at`` (0, 1, ...) and notes the runs that reach it."""
        code = self.codes.setdefault(symbol, len(self.codes))
        size, link = self.size, self.link
        new = self._state(at + 1, -1, -1, -1, at)
        p = self.newest
        while p >= 0 and (q := self._step(p, code)) < 0:
            self._point(p, code, new)
            p = link[p]
        if p < 0:
            parent = 0
        elif size[q] == size[p] + 1:
            parent = q
        else:
            parent = self._split(p, q, code)
        link[new] = self.up[new] = parent
        self.newest = new
        self._access(new, at)

    def _split(self, p: int, q: int, code: int) -> int:
        """A state for the shorter strings of ``q``, between it and its link."""
        self._splay(q)
        clone = self._state(self.size[p] + 1, self.link[q], self.symbol[q], self.target[q], self.ended[q])
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        # it has ended where q has, so it joins q's preferred path right above q
        low = self.low[q]
        self.low[clone] = low
        if low >= 0:
            self.up[low] = clone
        self.low[q] = clone
        self.up[clone] = q
        self.link[q] = clone
        while p >= 0 and self._step(p, code) == q:
            self._point(p, code, clone)
            p = self.link[p]
        return clone

    def _access(self, new: int, at: int) -> None:
        """Walks the segments above ``new`` and gives the whole path the colour ``at``."""
        up, high, ended, size = self.up, self.high, self.ended, self.size
        beyond = self.exponent - 1
        below, v = new, up[new]
        while v >= 0:
            self._splay(v)
            length, apart = size[v], at - ended[v]
            if length and length >= beyond * apart:
                self.ends[at - length - apart + 1, apart] = at
            cut = high[v]
            if cut >= 0:
                ended[cut] = ended[v]
            high[v] = below
            below, v = v, up[v]
        ended[below] = at


def runs_of(symbols: Sequence, exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[Run]:
    """All runs of at least ``exponent`` (>= 2) periods and ``shortest`` symbols, by start and period.

    At an exponent below 3 a stretch of twice its smallest period may be noted as well, so the
    smallest period of each start and end is taken.
    """
    finder = RunFinder(exponent)
    for at, symbol in enumerate(symbols):
        finder.append(symbol, at)
    found = sorted(
        (start, end - start + 1, period) for (start, period), end in finder.ends.items()
        if end - start + 1 >= shortest
    )
    if exponent >= 3:
        return found
    return [
        r for i, r in enumerate(found)
        if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found)
    ]


# ---------------------------------------------------------------- what may lie in a run

def back_distances(words: list[bytes]) -> list[int]:
    """How many places ago each word stood last; beyond any length where it is new."""
    last: dict[bytes, int] = {}
    none = -(1 << 40)
    out = []
    for i, w in enumerate(words):
        out.append(i - last.get(w, none))
        last[w] = i
    return out


def stretches(back: np.ndarray, exponent: int, shortest: int) -> list[tuple[int, int]]:
    """Maximal stretches [a, b) that may hold a run but for its first period.

    A run of period q there has at least (exponent - 1) q places, each at most q after the last
    occurrence of its word; so no distance in a stretch of m places exceeds m / (exponent - 1).
    Places beyond that split it, until nothing changes.
    """
    share = exponent - 1
    least = max(share, shortest - shortest // exponent)
    ok = np.ones(len(back), bool)
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        a, b = edges[::2], edges[1::2]
        long = b - a >= least
        a, b = a[long], b[long]
        bound = np.zeros(len(back) + 1, np.int64)  # of the stretch at a place, 0 outside
        bound[a] += (b - a) // share
        bound[b] -= (b - a) // share
        keep = back <= np.cumsum(bound[:-1])
        if (keep == ok).all():
            return list(zip(a.tolist(), b.tolist(), strict=True))
        ok = keep


def document_runs(
    words: list[bytes], spans: list[tuple[int, int]], exponent: int = EXPONENT, shortest: int = SHORTEST
) -> list[Run]:
    """Runs of a text whose stretches are ``spans``; the automaton reads those and a period before."""
    found: list[Run] = []
    for a, b in spans:
        first = max(0, a - (b - a) // (exponent - 1) - 1)
        found += [
            (first + s, n, q) for s, n, q in runs_of(words[first:b], exponent, shortest)
            if first + s + q >= a  # what lies before belongs to another stretch
        ]
    return sorted(set(found))


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


# ---------------------------------------------------------------- operator

_COLUMNS = (
    "doc_id {}, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string{}"
)


def periodic_runs(
    docs: DataFrame, exponent: int = EXPONENT, shortest: int = SHORTEST, id_col: str = "doc_id",
    text_col: str = "text", prepare: Prepare | None = None, with_text: bool = False,
) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text.

    Words are what stands between ASCII white space; ``exponent`` is at least 3. The longest run
    (``start``, ``length``, ``period``, ``exponent_milli``) is the first of equally long ones, then
    that of the smaller period; all four are null without a run. ``runs_sha256`` digests a line
    ``start,length,period`` for each run; ``collapsed_sha256`` the words that no run repeats.
    ``with_text`` adds that text itself as ``collapsed``, and the runs as an array ``runs``.
    ``prepare(doc_id, words)`` may rewrite the words first.

    Null and empty texts have no words and no run. Rows that repeat a key, and null keys, are
    rows of their own; other columns are not read. A text of any length is read whole.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than 3 periods are not looked for in documents")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches):
            ids = batch.column("doc_id")
            rows = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            if prepare:
                rows = [prepare(k, w) for k, w in zip(ids.to_pylist(), rows, strict=True)]
            # a text's first word is new, so no stretch reaches across two texts
            back = [np.array(back_distances(w), np.int64) for w in rows]
            starts = np.cumsum([0] + [len(w) for w in rows])
            spans: dict[int, list[tuple[int, int]]] = {}
            every = np.concatenate([np.zeros(0, np.int64), *back])
            for a, b in stretches(every, exponent, shortest):
                row = int(np.searchsorted(starts, a, side="right")) - 1
                spans.setdefault(row, []).append((a - int(starts[row]), b - int(starts[row])))
            out: list[list] = [[] for _ in range(9)]
            for i, words in enumerate(rows):
                runs = document_runs(words, spans[i], exponent, shortest) if i in spans else []
                top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                text = b" ".join(kept_words(words, runs))
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                values = [
                    len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
                    hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest(),
                ]
                if with_text:
                    values += [text.decode(), [{"start": s, "length": n, "period": q} for s, n, q in runs]]
                for column, value in zip(out, values, strict=False):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            if with_text:
                kinds += [pa.string(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=names)

    rows = ids_and_texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    extra = ", collapsed string, runs array<struct<start:long,length:long,period:long>>" if with_text else ""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    names += ["collapsed", "runs"] if with_text else []
    return rows.mapInArrow(scan, _COLUMNS.format(kind, extra))
