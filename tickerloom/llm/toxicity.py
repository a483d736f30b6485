"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are lexicon entries (words and word beginnings that a bounded labelled sample shows to
be telling) and hand-written patterns; each votes on a text or abstains. A generative model of
the votes given the hidden label is fitted by expectation-maximisation; correlated voters,
found by the correlation of what the label does not explain, share one vote. Its posterior
labels train a logistic regression over the same kind of features, which scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.frames import in_parts, sub_batches, texts_of
from tickerloom.llm.sampling import fold_of, ranked_sample

MOST_TOXIC, MOST_CLEAN = 3000, 6000
LONGEST = 50_000
THRESHOLD = 0.7
BEGINNINGS = (3, 4, 5, 7)
WORD = re.compile(r"[^\W\d_]+")

#: Pattern voters: what abuse often looks like, whatever the language.
PATTERNS = {
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b\W+){4}"),
    "exclaiming": re.compile(r"!{3,}"),
    "masked": re.compile(r"\b\w+[*@#$]{2,}\w*\b"),
    "second_person": re.compile(r"\b(?:you are|you're|shut up|go away|i hate)\b", re.IGNORECASE),
    "stretched": re.compile(r"([a-z])\1{3,}", re.IGNORECASE),
    "mocking": re.compile(r"(?:ha){4,}|lo+l", re.IGNORECASE),
}


def features_of_word(word: str) -> list[str]:
    return [word, *(word[:n] + "~" for n in BEGINNINGS if len(word) > n)]


def text_features(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(WORD.findall(text.lower())):
        out.update(features_of_word(word))
    return out


def numbered(texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
    """Feature numbers of each text, and the names of the features."""
    number: dict[str, int] = {}
    rows = [
        np.array(sorted(number.setdefault(f, len(number)) for f in text_features(t)), np.int32)
        for t in texts
    ]
    return rows, list(number)


def families(rows: list[np.ndarray], size: int, rare: int = 20, bands: int = 5) -> np.ndarray:
    """A number for each text, shared by near copies: two equal minima over their rare words.

    Copies would otherwise count as independent evidence for every word they share.
    """
    often = np.zeros(size, np.int64)
    for r in rows:
        often[r] += 1
    head = np.arange(len(rows))

    def root(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    rng = np.random.default_rng(3)
    own_rare = [r[often[r] <= rare] for r in rows]
    for _ in range(bands):
        one, two = rng.permutation(size), rng.permutation(size)
        first: dict[tuple[int, int], int] = {}
        for i, own in enumerate(own_rare):
            if len(own) >= 6:
                key = (int(own[one[own].argmin()]), int(own[two[own].argmin()]))
                if key[0] != key[1]:
                    head[root(i)] = root(first.setdefault(key, i))
    return np.array([root(i) for i in range(len(rows))])


def upper_tail(p: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """Chernoff bound of the chance that a binomial(n, rate) reaches p (1 where p <= n rate)."""
    share = np.clip(p / np.maximum(n, 1), 1e-12, 1.0)
    rest = np.clip(1 - share, 1e-12, 1.0)
    log = -n * (share * np.log(share / rate) + rest * np.log(rest / (1 - rate)))
    return np.where(share > rate, np.exp(np.minimum(log, 0)), 1.0)


def mine(
    rows: list[np.ndarray], toxic: np.ndarray, family: np.ndarray, names: list[str],
    chance: float = 0.2, precision: float = 0.8, most: int = 400,
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the telling features: (toxic ones, strongest first; clean ones).

    A feature tells if its count among toxic (clean) families would arise by chance in fewer
    than ``chance`` of all features together, and toxic ones are right ``precision`` times.
    """
    counts = np.zeros((2, len(names)))
    seen: set[tuple[int, int]] = set()
    for r, y, f in zip(rows, toxic.tolist(), family.tolist(), strict=True):
        if (f, y) in seen:
            continue
        seen.add((f, y))
        counts[y, r] += 1
    rate = float(np.clip(sum(y for _, y in seen) / max(1, len(seen)), 1e-3, 1 - 1e-3))
    limit = chance / max(1, int((counts.sum(axis=0) >= 3).sum()))

    def telling(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n = counts.sum(axis=0)
        sure = upper_tail(counts[1], n, rate) < limit
        return at[sure & (counts[1] >= precision * np.maximum(n, 1))]

    everything = np.arange(len(names))
    bad = telling(everything, counts)
    good = everything[upper_tail(counts[0], counts.sum(axis=0), 1 - rate) < limit]
    begin = np.array([f for f in bad if names[f].endswith("~")], np.int64)
    whole = {names[f]: f for f in bad if not names[f].endswith("~")}
    under = {
        int(f): np.array([k for w, k in whole.items() if w.startswith(names[f][:-1])], np.int64)
        for f in begin
    }
    beyond = np.zeros((2, len(begin)))
    for r, y in zip(rows, toxic.tolist(), strict=True):
        for k in np.flatnonzero(np.isin(begin, r)).tolist():
            beyond[y, k] += not np.isin(under[int(begin[k])], r).any()
    # one more word of a family is enough evidence where the family itself already tells
    enough = (beyond[1] >= 2) & (beyond[1] >= precision * np.maximum(beyond.sum(axis=0), 1))
    bad = np.array([*whole.values(), *begin[enough]], np.int64)
    n = counts.sum(axis=0)
    bad = bad[np.lexsort((bad, -counts[1, bad], -counts[1, bad] / np.maximum(n[bad], 1)))]
    return bad[:most], good


def votes(texts: list[str], rows: list[np.ndarray], lexicon: np.ndarray) -> np.ndarray:
    """One row per text, one column per voter: 1 where it fires, 0 where it abstains.

    The columns are the lexicon, the patterns and, last, the voter that speaks for clean where
    the whole lexicon is silent.
    """
    at = {int(f): k for k, f in enumerate(lexicon)}
    out = np.zeros((len(texts), len(lexicon) + len(PATTERNS) + 1), np.float64)
    for i, (text, own) in enumerate(zip(texts, rows, strict=True)):
        for f in own[np.isin(own, lexicon)].tolist():
            out[i, at[f]] = 1.0
        for k, pattern in enumerate(PATTERNS.values()):
            out[i, len(lexicon) + k] = float(pattern.search(text) is not None)
    out[:, -1] = out[:, : len(lexicon)].sum(axis=1) == 0
    return out


@dataclass
class LabelModel:
    """P(voter fires | label), the label's prior, and each voter's share of a full vote."""

    prior: float = 0.5
    fires: np.ndarray = field(default=None)  # 2 x voters
    share: np.ndarray = field(default=None)
    correlation: np.ndarray = field(default=None)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """An abstention says nothing; what fires adds its log-likelihood ratio."""
        ratio = np.log(self.fires[1] / self.fires[0])
        x = np.log(self.prior / (1 - self.prior)) + v @ (ratio * self.share)
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_label_model(v: np.ndarray, n_lexicon: int, prior: float, rounds: int = 25) -> LabelModel:
    """Expectation-maximisation, started from the lexicon's majority; no label is read.

    After every round the residual correlations of the voters are estimated, and a voter that
    moves with k others counts 1 / (1 + k).
    """
    n, m = v.shape
    model = LabelModel(prior, np.full((2, m), 0.5), np.ones(m), np.eye(m))
    q = np.clip(v[:, :n_lexicon].sum(axis=1) > 0, 0.02, 0.98).astype(float)
    for _ in range(rounds):
        for y, weight in ((1, q), (0, 1 - q)):
            model.fires[y] = (weight @ v + 0.5) / (weight.sum() + 1.0)
        model.fires = np.clip(model.fires, 1e-4, 1 - 1e-4)
        expected = q[:, None] * model.fires[1] + (1 - q)[:, None] * model.fires[0]
        rest = v - expected
        spread = np.sqrt((rest * rest).sum(axis=0)) + 1e-9
        model.correlation = (rest.T @ rest) / np.outer(spread, spread)
        tied = np.where(model.correlation > 0.6, model.correlation, 0.0)
        model.share = 1.0 / np.maximum(1.0, tied.sum(axis=1))
        new = model.posterior(v)
        if np.abs(new - q).max() < 1e-4:
            break
        q = new
    return model


def fit_classifier(
    rows: list[np.ndarray], q: np.ndarray, size: int, epochs: int = 60, rate: float = 0.3,
    l1: float = 2e-4, seed: int = 5,
) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse presence features and soft labels (AdaGrad, L1)."""
    w, g2 = np.zeros(size), np.full(size, 1e-8)
    b, b2 = 0.0, 1e-8
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[at].sum() + b, -40, 40)))
            d = p - q[i]
            g2[at] += d * d
            step = rate / np.sqrt(g2[at])
            moved = w[at] - step * d
            w[at] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            b2 += d * d
            b -= rate * d / np.sqrt(b2)
    return w, b


def steepness(x: np.ndarray, q: np.ndarray, rounds: int = 60, most: float = 6.0) -> tuple[float, float]:
    """Slope (1 to ``most``) and shift of the logits that fit the posterior labels best."""
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -40, 40)))
        d, h = p - q, p * (1 - p) + 1e-6
        hessian = np.array([[(h * x * x).sum(), (h * x).sum()], [(h * x).sum(), h.sum()]])
        step = np.linalg.solve(hessian + 1e-3 * np.eye(2), [(d * x).sum(), d.sum()])
        step *= min(1.0, 0.5 / max(1e-9, float(np.abs(step).max())))
        a, c = float(np.clip(a - step[0], 1.0, most)), c - float(step[1])
    return a, c


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    intercept: float
    voters: list[str] = field(default_factory=list)
    labels: LabelModel | None = None

    def scorer(self):
        """A function text -> score that remembers what each word contributes."""
        known: dict[str, tuple[str, ...]] = {}
        weights, intercept = self.weights, self.intercept

        def score(text: str) -> float:
            found: set[str] = set()
            for word in set(WORD.findall(text.lower())):
                own = known.get(word)
                if own is None:
                    own = tuple(f for f in features_of_word(word) if f in weights)
                    if len(known) > 150_000:
                        known.clear()
                    if len(word) <= 48:
                        known[word] = own
                if own:
                    found.update(own)
            for name, pattern in PATTERNS.items():
                if name in weights and pattern.search(text):
                    found.add(name)
            x = intercept + sum(map(weights.__getitem__, sorted(found)))
            return float(1 / (1 + np.exp(-min(max(x, -40.0), 40.0))))

        return score


def train(sample: DataFrame) -> ToxicityModel:
    """Fits on a bounded sample of columns text and toxic (``labelled_sample``)."""
    rows = sorted((r.text, int(r.toxic)) for r in sample.collect())
    toxic = np.array([y for _, y in rows])
    if not len(rows) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(rows) else 0.0
        return ToxicityModel({}, 3.0 if share == 1.0 else -3.0)
    texts = [t for t, _ in rows]
    found, names = numbered(texts)
    lexicon, clean = mine(found, toxic, families(found, len(names)), names)
    v = votes(texts, found, lexicon)
    labels = fit_label_model(v, len(lexicon), float(np.clip(toxic.mean(), 0.01, 0.99)))
    q = labels.posterior(v)
    return classifier(texts, found, names, lexicon, clean, v, q, labels)


def classifier(
    texts: list[str], found: list[np.ndarray], names: list[str], lexicon: np.ndarray,
    clean: np.ndarray, v: np.ndarray, q: np.ndarray, labels: LabelModel | None = None,
) -> ToxicityModel:
    """The linear model over the voters and the features that tell clean texts, fitted to q."""
    used = [*lexicon.tolist(), *clean.tolist()]
    column = {f: k for k, f in enumerate(used)}
    vectors = [
        np.array(
            [*(column[f] for f in own[np.isin(own, used)].tolist()),
             *(len(used) + k for k in range(len(PATTERNS)) if v[i, len(lexicon) + k])], np.int64)
        for i, own in enumerate(found)
    ]
    w, b = fit_classifier(vectors, q, len(used) + len(PATTERNS))
    a, c = steepness(np.array([w[at].sum() + b for at in vectors]), q)
    w, b = a * w, a * b + c
    weights = dict(zip([*(names[f] for f in used), *PATTERNS], w.tolist(), strict=True))
    return ToxicityModel(
        {f: x for f, x in weights.items() if x}, float(b), [names[f] for f in lexicon], labels
    )


def scores(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every whole text."""
    rows = in_parts(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of the sample only

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.scorer()
        for batch in sub_batches(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([own(t) for t in texts_of(batch.column("text"))], pa.float64())],
                names=["doc_id", "score"],
            )

    found = rows.mapInArrow(score, f"doc_id {kind}, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, folds: int, held_out: int, most: tuple[int, int] = (MOST_CLEAN, MOST_TOXIC),
    longest: int = LONGEST,
) -> DataFrame:
    """text, toxic of at most ``most[label]`` distinct texts of each label outside the held-out fold.

    Only keys and hashes meet the labels; the chosen keys are a broadcast of bounded size that
    fetches the texts, so no text is shuffled but those of the sample. Texts over ``longest``
    characters come last, the shortest first (``sampling.ranked_sample``).
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(F.col("text").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
    rows = rows.withColumns({"_h": F.xxhash64("text"), "_n": F.char_length("text")})
    hashes = rows.select("doc_id", "_h", "_n").join(known, "doc_id").groupBy("toxic", "_h").agg(
        F.min("doc_id").alias("doc_id"), F.max("_n").alias("_n")
    )
    limit = F.when(F.col("toxic") == 1, most[1]).otherwise(most[0])
    chosen = ranked_sample(hashes, "toxic", limit, longest)
    rows = rows.drop("_n")
    found = rows.join(F.broadcast(chosen), ["doc_id", "_h"])
    return found.groupBy("toxic", "_h").agg(F.first("text").alias("text")).select("text", "toxic")


def toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1,
    id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    most: tuple[int, int] = (MOST_CLEAN, MOST_TOXIC),
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of the held-out fold are not read.

    Null and empty texts get the score of a text without features. Of several labels of one
    doc_id the largest counts; null labels are not used; without labels of both kinds every
    text gets the same score. Repeated rows are scored one by one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train(labelled_sample(rows, labels, folds, held_out, most))
    found = scores(rows, model, threshold)
    return found.select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", "predicted"
    )


def without_toxic(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1,
    id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    most: tuple[int, int] = (MOST_CLEAN, MOST_TOXIC),
) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; columns stay.

    Nulls, repeated rows, ties and empty tables as for :func:`toxicity`; a null or empty text
    stays unless texts without features are rejected. Columns may have any names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train(labelled_sample(rows, labels, folds, held_out, most))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in sub_batches(batches, column=f"_c{at}"):
            stay = [score(t) < threshold for t in texts_of(batch.column(at))]
            yield batch.filter(pa.array(stay, pa.bool_()))

    plain = in_parts(docs).toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
