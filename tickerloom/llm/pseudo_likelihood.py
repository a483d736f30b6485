"""Masked pseudo-likelihood: every token predicted from both sides by a window network.

Tokens are words; the corpus itself gives the vocabulary (Spark counts every word of every
document) and the chance of a word within its class. The network is a small one in numpy: the
embeddings of the words left and right, a hidden layer, and a softmax over word classes:

    log p(w | window) = log p(class(w) | window) + log p(w | class(w))

p(w | class) is the word's own count over that of its class, for every word of the corpus: the
counts stay a Spark table, and the words without an embedding meet it in a join. Embedded are
the ``VOCABULARY`` most frequent words and all others that come ``sqrt(tokens) / RARE`` times
(at least ``LEAST``), so the embedded words grow with the corpus, about as the root of its
size; only what the rest look like as context and their class is shared, by their last letters.

It is trained on all documents by parameter mixing: in each round every partition of texts
starts from the shared parameters, masks every ``rounds``-th token of every document (another
one each round, so every token of every document is a target once) and makes one pass of
AdaGrad over these windows; the results are averaged by the number of windows. A document's score is the sum of the conditional log-probabilities of
all its tokens, none of which is predicted from itself.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.frames import ids_and_texts, materialised, sub_batches, texts_of

WINDOW = 2
DIM, HIDDEN = 12, 24
#: Words with an embedding and a class entry of their own, in the order of their counts: so many
#: at least, and all of at least LEAST and sqrt(tokens) / RARE; the rest share entries by their
#: last letters.
VOCABULARY = 4096
LEAST, RARE = 5, 100
ENDINGS = 256
CLASSES = 64
ROUNDS = 2
SLICE = 1024
GROUPS = 256
#: Logarithms of counts are summed as whole numbers of this fraction, so in any order.
UNIT = 1 << 30

TOKEN = re.compile(r"\w+|[^\w\s]")
MARK = re.compile(r"[^\w\s]")
#: ASCII that is neither a mark nor a blank outside ASCII_BLANKS.
ASCII_BLANKS = " \t\n\r\v\f"
PLAIN = bytes(k for k in range(128) if not MARK.match(chr(k)) and not "\x1c" <= chr(k) <= "\x1f")
#: Kinds of marks that a text may hold to be split by its blanks.
MARKS = 32
#: Tokens that a task counts at a time.
COUNTED = 1 << 21
#: Logits of at most this size need no maximum taken off: sums of their exponentials stay finite.
LOGITS = 64.0


def spaced(text: str) -> str:
    """The lower-cased text with ASCII blanks between all tokens, as TOKEN finds them, and no others."""
    low = text.lower()
    rest = low.encode("utf-8", "surrogatepass").translate(None, PLAIN).decode("utf-8", "surrogatepass")
    found = "".join(set(rest))
    marks = MARK.findall(found)
    if len(marks) > MARKS:
        return " ".join(TOKEN.findall(low))
    for mark in marks:
        low = low.replace(mark, f" {mark} ")
    for blank in filter(str.isspace, found):
        low = low.replace(blank, " ")
    return low.strip(ASCII_BLANKS)


def tokens(text: str) -> list[str]:
    """All tokens of the lower-cased text, as TOKEN finds them: blanks around each mark, then a split."""
    return spaced(text).split()


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts in a row, split by Arrow, and the number of tokens of each text."""
    split = pc.ascii_split_whitespace(pa.array([spaced(t) or None for t in texts], pa.string()))
    return split.flatten(), pc.fill_null(pc.list_value_length(split), 0).to_numpy()


def ending(word: str) -> int:
    """The shared entry of a word outside the vocabulary."""
    h = 0
    for c in word[-3:]:
        h = (h * 131 + ord(c)) & 0xFFFFFFFF
    return h % ENDINGS


@dataclass
class Lexicon:
    """Entry of each embedded word, class of each entry, log p(word | class)."""

    number: dict[str, int]
    classes: np.ndarray  # of entries; the entry after the last is the page's edge
    own: np.ndarray  # log p(word | class) of embedded words; of the rest without log(count)
    least: tuple[int, str] | None  # count and text of the last embedded word

    @property
    def edge(self) -> int:
        return len(self.number) + ENDINGS

    def reader(self) -> Entries:
        return Entries(self)

    def embedded(self) -> Column:
        """On columns word, n: the word has an entry of its own."""
        n, word = self.least or (1 << 62, "")
        return (F.col("n") > n) | ((F.col("n") == n) & (F.col("word") <= word))


class Entries(dict):
    """Entries of words; those outside the vocabulary are found by ending."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__(lexicon.number)
        self.size = len(lexicon.number)

    def __missing__(self, word: str) -> int:
        return self.size + ending(word)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n over all documents; words are counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            found = pa.chunked_array(held, pa.string()).value_counts()
            return pa.RecordBatch.from_arrays(found.flatten(), names=["word", "n"])

        for batch in sub_batches(batches):
            words = words_of(texts_of(batch.column("text")))[0]
            held.append(words)
            size += len(words)
            if size >= COUNTED:
                yield out()
                held, size = [], 0
        yield out()

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(counts: DataFrame, vocabulary: int = VOCABULARY) -> Lexicon:
    """Entries of the frequent words, and what all other words amount to by ending."""
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    often = max(LEAST, int(np.sqrt(tokens) / RARE))
    most = counts.orderBy(F.desc("n"), "word").limit(vocabulary)
    rank = most if (most.agg(F.min("n")).first()[0] or 0) < often else counts.where(F.col("n") >= often)
    top = rank.toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words = top.column("word").to_pylist()
    number = {w: k for k, w in enumerate(words)}
    totals = top.column("n").to_numpy().astype(np.float64)
    shared = np.zeros(ENDINGS)
    lexicon = Lexicon(number, np.zeros(0), np.zeros(0), (int(totals[-1]), words[-1]) if words else None)

    def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(ENDINGS, np.int64)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mass[ending(word)] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS)), pa.array(mass)], names=["k", "n"])

    rest = counts.where(~lexicon.embedded()).select("word", "n")
    for r in rest.mapInArrow(endings, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        shared[r.k] = r.n
    mass = np.concatenate([totals, shared])
    # classes of about equal mass in the order of the entries: frequent words stand alone
    share = np.cumsum(mass) / max(1.0, mass.sum())
    lexicon.classes = np.minimum((share * CLASSES).astype(np.int64), CLASSES - 1)
    per_class = np.bincount(lexicon.classes, weights=mass, minlength=CLASSES)
    lexicon.own = -np.log(np.maximum(per_class, 1.0))[lexicon.classes]
    lexicon.own[: len(number)] += np.log(totals)
    return lexicon


def encoded(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """row, doc_id, entries (32-bit numbers as bytes) of every text; rare and times: its words
    without an embedding and how often each comes. ``row`` numbers the rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(lexicon)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = known.value
        row = TaskContext.get().partitionId() << 33
        for batch in sub_batches(batches, 1 << 20):
            rows = np.arange(row, row + len(batch))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column("doc_id"), *entries_and_rare(lexicon, texts_of(batch.column("text")))],
                names=["row", "doc_id", "entries", "rare", "times"],
            )
            row += len(batch)

    return docs.mapInArrow(
        encode, f"row long, doc_id {kind}, entries binary, rare array<string>, times array<long>"
    )


def entries_and_rare(lexicon: Lexicon, texts: list[str]) -> list[pa.Array]:
    """Entries of all tokens of each text, as bytes; its words without an embedding; how often each comes."""
    words, sizes = words_of(texts)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    coded = words.dictionary_encode()
    distinct, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    size, endings = len(lexicon.number), {w[-3:]: 0 for w in distinct}
    for w in endings:
        endings[w] = size + ending(w)
    entry = np.array([lexicon.number.get(w, -1) for w in distinct], np.int32)
    rare = entry < 0
    entry[rare] = [endings[distinct[k][-3:]] for k in np.flatnonzero(rare).tolist()]
    data = pa.py_buffer(entry.take(code))
    entries = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * ends).astype(np.int32)), data])
    at = np.flatnonzero(rare.take(code))
    doc = np.searchsorted(ends, at, side="right") - 1
    met, times = np.unique(doc * max(1, len(distinct)) + code[at], return_counts=True)
    doc, which = np.divmod(met, max(1, len(distinct)))
    cut = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
    return [
        entries, pa.ListArray.from_arrays(cut, coded.dictionary.take(pa.array(which, pa.int64()))),
        pa.ListArray.from_arrays(cut, pa.array(times, pa.int64())),
    ]


def entries_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int32) for x in column]


@dataclass
class Network:
    """Embeddings, hidden layer and class layer."""

    e: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def start(entries: int, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        wide = 2 * WINDOW * DIM
        return Network(
            (rng.standard_normal((entries, DIM)) * 0.1).astype(np.float32),
            (rng.standard_normal((wide, HIDDEN)) / np.sqrt(wide)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            (rng.standard_normal((HIDDEN, CLASSES)) * 0.1).astype(np.float32),
            np.zeros(CLASSES, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.e, self.w1, self.b1, self.w2, self.b2]

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings, hidden layer and logits of each window."""
        x = self.e.take(context.ravel(), axis=0).reshape(len(context), -1)
        h = x @ self.w1
        h += self.b1
        np.tanh(h, out=h)
        z = h @ self.w2
        z += self.b2
        if np.abs(self.w2).sum(axis=0).max() + np.abs(self.b2).max() > LOGITS:  # no |h| is over 1
            z -= z.max(axis=1, keepdims=True)
        return x, h, z

    def log_class(self, context: np.ndarray, label: np.ndarray) -> np.ndarray:
        """log p(label | window) of each window."""
        z = self.forward(context)[2]
        own = z.ravel().take(np.arange(len(label)) * CLASSES + label)
        np.exp(z, out=z)
        return own - np.log(z @ np.ones(CLASSES, np.float32))


def windows(entries: np.ndarray, edge: int, step: int = 1, start: int = 0) -> np.ndarray:
    """Entries left and right of each ``step``-th token, the page's edge where there is none."""
    padded = np.full(len(entries) + 2 * WINDOW, edge, np.int32)
    padded[WINDOW : WINDOW + len(entries)] = entries
    shifts = [k for k in range(2 * WINDOW + 1) if k != WINDOW]
    return np.stack([padded[k : k + len(entries)][start::step] for k in shifts], axis=1)


def train_pass(net: Network, squares: list[np.ndarray], context: np.ndarray, label: np.ndarray, rate: float) -> None:
    """One AdaGrad step on a batch of windows."""
    x, h, d = net.forward(context)
    n = len(label)
    np.exp(d, out=d)
    ones = np.ones(max(n, CLASSES), np.float32)  # sums as products: numpy's along short rows are slow
    d *= (1 / (d @ ones[:CLASSES] * n))[:, None]
    d.ravel()[np.arange(n) * CLASSES + label] -= np.float32(1 / n)
    gw2, gb2 = h.T @ d, ones[:n] @ d
    dh = (d @ net.w2.T) * (1 - h * h)
    gw1, gb1 = x.T @ dh, ones[:n] @ dh
    dx = (dh @ net.w1.T).reshape(-1, DIM)
    flat = context.ravel()
    # sixteen bits are sorted by their digits
    order = np.argsort(flat.astype(np.uint16) if len(net.e) <= 1 << 16 else flat, kind="stable")
    ranked = flat.take(order)
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    # complex numbers only to add two floats at a time
    pairs = dx.take(order, axis=0).view(np.complex64)
    met, ge = ranked[first], np.add.reduceat(pairs, first, axis=0).view(np.float32)
    # only the embeddings met move, however many there are
    square = squares[0].take(met, axis=0) + ge * ge
    squares[0][met] = square
    net.e[met] = net.e.take(met, axis=0) - rate * ge / (np.sqrt(square) + 1e-6)
    for part, square, g in zip(net.parts()[1:], squares[1:], (gw1, gb1, gw2, gb2), strict=True):
        square += g * g
        part -= rate * g / (np.sqrt(square) + 1e-6)


def summed(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and the sum of the rows of each."""
    order = np.argsort(ids, kind="stable")
    ranked = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return ranked[first], np.add.reduceat(rows[order], first, axis=0)


def sheet(net: Network) -> np.ndarray:
    """All parameters in rows of DIM: the embeddings, then the layers, padded."""
    dense = np.concatenate([p.ravel() for p in net.parts()[1:]])
    padded = np.zeros(-(-len(dense) // DIM) * DIM, np.float32)
    padded[: len(dense)] = dense
    return np.concatenate([net.e, padded.reshape(-1, DIM)])


def train(texts: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS, rate: float = 0.05, batch_size: int = 4096) -> Network:
    """Parameter mixing over all ``encoded`` texts: each task's pass, averaged by its windows.

    A task sends the layers and the embeddings that it has met, each with its weight (windows,
    and places in windows), in slices of SLICE rows; slices are averaged in parallel, and the
    driver holds one set of parameters.
    """
    spark = texts.sparkSession
    net = Network.start(lexicon.edge + 1)
    known = spark.sparkContext.broadcast(lexicon.classes)
    edge = lexicon.edge
    shape = "slice int, ids binary, data binary"

    def packed(slices: list[int], part: list[int], ids: list[np.ndarray], data: list[np.ndarray]) -> dict:
        return {
            "slice": pa.array(slices, pa.int32()), "part": pa.array(part, pa.int32()),
            "ids": pa.array([x.astype(np.int32).tobytes() for x in ids], pa.binary()),
            "data": pa.array([x.astype(np.float64).tobytes() for x in data], pa.binary()),
        }

    for k in range(rounds):
        current = spark.sparkContext.broadcast(net)

        def fit(batches: Iterator[pa.RecordBatch], current=current, k=k) -> Iterator[pa.RecordBatch]:
            own: Network = pickle.loads(pickle.dumps(current.value))
            classes = known.value
            squares = [np.full(p.shape, 1e-4, np.float32) for p in own.parts()]
            places = np.zeros(len(own.e), np.int64)
            seen, contexts, labels, held = 0, [], [], 0
            step = rate / (1 + k)

            def learn() -> None:
                context, label = np.concatenate(contexts), np.concatenate(labels)
                np.add(places, np.bincount(context.ravel(), minlength=len(places)), out=places)
                rng = np.random.default_rng(len(label))
                mixed = rng.permutation(len(label))
                for at in range(0, len(mixed), batch_size):
                    some = mixed[at : at + batch_size]
                    train_pass(own, squares, context.take(some, axis=0), label.take(some), step)

            for batch in batches:
                for entries in entries_of(batch.column("entries")):
                    label = classes[entries[k::rounds]]
                    if len(label):
                        contexts.append(windows(entries, edge, rounds, k))
                        labels.append(label)
                        held += len(label)
                        seen += len(label)
                    if held > 50_000:
                        learn()
                        contexts, labels, held = [], [], 0
            if held:
                learn()
            if seen:
                rows = sheet(own)
                weight = np.concatenate([places, np.full(len(rows) - len(places), seen)])
                met = np.flatnonzero(weight)
                data = np.concatenate([rows[met] * weight[met, None].astype(np.float64), weight[met, None]], axis=1)
                slices, at = np.unique(met // SLICE, return_index=True)
                part = [TaskContext.get().partitionId()] * len(slices)
                yield pa.RecordBatch.from_pydict(packed(
                    slices.tolist(), part, np.split(met, at[1:]), np.split(data, at[1:])
                ))

        def add(key, table):
            ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in table.column("ids")])
            data = np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in table.column("data")])
            ids, data = summed(ids, data.reshape(len(ids), DIM + 1))
            return pa.table(packed([key[0].as_py()], [0], [ids], [data])).drop_columns(["part"])

        sent = texts.select("entries").mapInArrow(fit, "slice int, part int, ids binary, data binary")
        sent = materialised(sent, "lm-parameters")
        # sums of GROUPS groups of tasks first, so that no sum reads more rows than a group has
        sums = sent.groupBy("slice", F.pmod("part", F.lit(GROUPS)).alias("g")).applyInArrow(add, shape)
        rows = sheet(net)
        for r in sums.groupBy("slice").applyInArrow(add, shape).collect():
            ids = np.frombuffer(bytes(r.ids), np.int32)
            data = np.frombuffer(bytes(r.data), np.float64).reshape(len(ids), DIM + 1)
            rows[ids] = data[:, :-1] / data[:, -1:]
        flat = rows.ravel()
        parts, at = [], 0
        for p in net.parts():
            parts.append(flat[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        net = Network(*parts)
    return net


def scores(texts: DataFrame, counts: DataFrame, lexicon: Lexicon, net: Network) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum) and mean_log_likelihood of every ``encoded`` text.

    A word without an embedding is rarer than all that have one, so no key of the join with
    the counts is a hot one.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()
    shared = texts.sparkSession.sparkContext.broadcast((lexicon.classes, lexicon.own, lexicon.edge, net))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, log_own, edge, own = shared.value

        def values(all_entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            sizes = np.array([len(e) for e in all_entries])
            if not sizes.sum():
                return sizes, np.zeros(len(sizes))
            context = np.concatenate([windows(e, edge) for e in all_entries if len(e)])
            entry = np.concatenate(all_entries)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            value = np.empty(len(entry))
            for at in range(0, len(entry), 4096):
                e = entry[at : at + 4096]
                value[at : at + 4096] = own.log_class(context[at : at + 4096], classes[e]) + log_own[e]
            return sizes, np.bincount(doc, weights=value, minlength=len(sizes))

        for batch in batches:
            sizes, sums, some, held = [], [], [], 0
            for entries in [*entries_of(batch.column("entries")), None]:
                if some and (entries is None or held + len(entries) > 200_000):
                    n, total = values(some)
                    sizes.append(n)
                    sums.append(total)
                    some, held = [], 0
                if entries is not None:
                    some.append(entries)
                    held += len(entries)
            if sizes:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"), pa.array(np.concatenate(sizes), pa.int64()),
                     pa.array(np.concatenate(sums), pa.float64())],
                    names=["row", "doc_id", "n_tokens", "base"],
                )

    base = texts.select("row", "doc_id", "entries").mapInArrow(
        score, f"row long, doc_id {kind}, n_tokens long, base double"
    )
    log_n = F.round(F.log("n") * UNIT).cast("long")
    rest = counts.where(~lexicon.embedded()).select("word", log_n.alias("log_n"))
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    rare = rare.select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(rest, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("log_n")).alias("more"))
    total = F.col("base") + F.coalesce("more", F.lit(0)) / UNIT
    return base.join(rare, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood")).withColumn(
        "mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    )


def masked_pseudo_likelihood(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, rounds: int = ROUNDS
) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood of every row, trained on all rows.

    Texts without tokens (null, empty, white space) have 0 tokens, a sum of 0 and a null mean.
    Null keys and repeated rows are scored as rows of their own; other columns are not read;
    an empty table gives an empty result.
    """
    rows = ids_and_texts(docs, id_col, text_col)
    counts = materialised(word_counts(rows), "lm-counts")
    lexicon = build_lexicon(counts, vocabulary)
    texts = materialised(encoded(rows, lexicon), "lm-entries")
    net = train(texts, lexicon, rounds)
    return scores(texts, counts, lexicon, net)
