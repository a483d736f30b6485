"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Spark counts the document frequencies of hashed n-grams over every training document; the
weights are fitted on a bounded sample by follow-the-regularised-leader with elastic-net
penalties (L1 leaves most weights at zero), a temperature is fitted on a part of the sample
that the weights have not seen, and every whole text is scored in one map pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.frames import materialised, sub_batches, texts_of
from tickerloom.llm.sampling import fold_of, sample_per_label

BITS = 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
MOST_PER_LANGUAGE = 1500
LONGEST = 50_000

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Code point -> lower-case letter, or a blank for whatever is no letter."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x40000):  # no plane above the third holds letters
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low[0])
        _letters.append(table)
    return _letters[0]


def grams_of(text: str) -> np.ndarray:
    """Hash buckets of all character n-grams of the whole text; empty without a letter."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = letter_table()[np.minimum(raw, 0x10FFFF)]
    if not (points != 32).any():
        return np.zeros(0, np.int64)
    points = np.concatenate([[32], points, [32]]).astype(np.uint32)
    out = []
    h = np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(1)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            out.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(out).astype(np.int64)


def weighted(buckets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse TF-IDF vector of length one: (buckets, values)."""
    counts = np.bincount(buckets, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt((values * values).sum())
    return at, (values / norm if norm else values)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default=None)
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray | None:
        buckets = grams_of(text)
        if not len(buckets) or not self.languages:
            return None
        at, values = weighted(buckets, self.idf)
        return values @ self.weights[at] + self.weights[-1]

    def predict(self, text: str) -> tuple[str, float]:
        logits = self.logits(text)
        if logits is None:
            return UNKNOWN, 0.0
        p = softmax(logits / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_weights(
    samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 7,
) -> np.ndarray:
    """FTRL-proximal, one row of weights per bucket and a last row of intercepts."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def current(at: np.ndarray) -> np.ndarray:
        za = z[at]
        w = -(za - np.sign(za) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(za) <= l1] = 0.0
        return w

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            at, values, label = samples[i]
            at = np.append(at, size - 1)
            values = np.append(values, 1.0)
            w = current(at)
            p = softmax(values @ w)
            p[label] -= 1.0
            g = values[:, None] * p[None, :]
            held = n[at]
            sigma = (np.sqrt(held + g * g) - np.sqrt(held)) / alpha
            z[at] += g - sigma * w
            n[at] = held + g * g
    return current(np.arange(size))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log-loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]).mean())

    low, high, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all ``texts`` each bucket occurs, and how many there are.

    Every task sends one count per bucket it met: at most 2**BITS rows, whatever it read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for text in texts_of(batch.column("text")):
                buckets = grams_of(text)
                if len(buckets):
                    seen = np.zeros(1 << BITS, bool)
                    seen[buckets] = True
                    met[:-1] += seen
                    met[-1] += 1
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(met[at])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long")
    rows = rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros((1 << BITS) + 1, np.int64)
    for r in rows:
        df[r.bucket] = r.n
    return df[:-1], int(df[-1])


def train(
    labelled: DataFrame, most: int = MOST_PER_LANGUAGE, longest: int = LONGEST, epochs: int = 3
) -> LanguageModel:
    """Fits on columns text and lang; rows without either are not used.

    ``most`` texts of each language (those over ``longest`` characters last) train the weights;
    document frequencies come from all rows. Every fifth sampled text calibrates.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = sample_per_label(labelled, "lang", most, longest).collect()
    frequencies, total = document_frequencies(labelled)
    languages = sorted({r.lang for r in sample})
    model = LanguageModel(languages, np.log((1.0 + total) / (1.0 + frequencies)) + 1.0)
    number = {name: k for k, name in enumerate(languages)}
    rows = sorted((r.text, number[r.lang]) for r in sample)
    vectors = [(*weighted(b, model.idf), label) for text, label in rows if len(b := grams_of(text))]
    check = [v for i, v in enumerate(vectors) if i % 5 == 0] if len(vectors) >= 20 else []
    fit = [v for i, v in enumerate(vectors) if i % 5 or not check]
    if not languages:
        return model
    weights = fit_weights(fit, len(languages), epochs)
    if check:
        logits = np.array([values @ weights[at] + weights[-1] for at, values, _ in check])
        model.temperature = fit_temperature(logits, np.array([v[2] for v in check]))
    model.weights = weights.astype(np.float32)
    return model


def predictions(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text; ``und`` and 0 without text or letter."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows x languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sub_batches(batches):
            found = [own.predict(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def identify(
    docs: DataFrame, folds: int = 4, held_out: int = 2, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang", most: int = MOST_PER_LANGUAGE,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learnt from the other folds only.

    Null texts and texts without a letter get ``und`` with score 0, as does every row when no
    row has a language. Repeated rows are predicted one by one; a null key is never held out
    by chance (it counts as the empty text); other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    fold = fold_of(F.col("doc_id"), folds)
    model = train(rows.where(fold != held_out), most)
    found = predictions(rows, model)
    return found.select("doc_id", (fold == held_out).alias("held_out"), "lang_pred", "score")
