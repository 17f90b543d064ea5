"""Toxicity by a classifier chain: categories are predicted one after the other, and each later linear model also sees the earlier probabilities.

The last category is the label itself (``toxic``); the two before it are drawn from the labelled sample by rule: ``abusive_terms`` (a text has an indicator, a
word or word start that nearly only toxic texts of the sample have) and ``repeated_abuse`` (REPEATED or more). In training, earlier probabilities are those of models
that have not seen the row (out of fold), so later models learn to trust them only as far as they hold.

Features are words (runs of letters, lower case) and word starts of 4 to 7 letters that toxic texts have significantly more often, at most ``most_features``; their
value is log(1 + count). The chain is fitted on a bounded sample: at most ``max_train_docs`` labelled documents, those with the smallest hash of the id,
with one text each, the one of the smallest hash. Counts are
made where the texts are; what reaches the driver is bounded by the sample and the number of features.

Defined cases: a null or empty text has no features and gets the intercepts' probabilities; each row gives one row, repeated rows and null ids too; without both labels in the
sample nothing is toxic (probability 0); an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.common import Cache, id_and_text, kind_of, one_row_each, slices, where_text

CATEGORIES = ("abusive_terms", "repeated_abuse", "toxic")
REPEATED, PURITY, LEAST_DOCS = 3, 0.9, 4
WORD = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6, 7)


@dataclass(frozen=True)
class Chain:
    """``weights``: for each category one weight for every feature, then one for every earlier category; ``intercepts``: one each. None: nothing is toxic."""

    features: dict[str, int]
    weights: list[np.ndarray] | None
    intercepts: list[float]


def features_of(word: str) -> tuple[str, ...]:
    """``=word``, and ``^start`` for the starts of longer words."""
    return ("=" + word, *("^" + word[:n] for n in STARTS if len(word) >= n))


def word_counts(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; rows of the rarer class weigh as much as the other's, up to four times each."""
    n = max(len(y), 1)
    weight = np.where(y > 0, min(4.0, max(1.0, (n - y.sum()) / max(y.sum(), 1))), 1.0)
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
    size = 0.25 * float(np.linalg.norm((x1 * weight[:, None]).T @ x1 / n, 2)) + penalty
    w = ahead = np.zeros(x1.shape[1])
    for k in range(rounds):
        slope = x1.T @ (weight * (sigmoid(x1 @ ahead) - y)) / n + penalty * np.append(ahead[:-1], 0)
        new = ahead - slope / size
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w[:-1], float(w[-1])


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
    """One model a category on x and the out-of-fold probabilities of the categories before it."""
    weights, intercepts, seen = [], [], x
    for j in range(labels.shape[1]):
        w, b = fit_linear(seen, labels[:, j])
        weights.append(w)
        intercepts.append(b)
        held_out = np.zeros(len(x))
        for k in np.unique(folds):
            inside = folds != k
            wk, bk = fit_linear(seen[inside], labels[inside, j]) if inside.any() else (w, b)
            held_out[~inside] = sigmoid(seen[~inside] @ wk + bk)
        seen = np.concatenate([seen, held_out[:, None]], 1)
    return weights, intercepts


def probabilities(chain: Chain, x: np.ndarray) -> np.ndarray:
    """[rows, categories], each category from the features and the probabilities before it."""
    if chain.weights is None:
        return np.zeros((len(x), len(CATEGORIES)))
    for w, b in zip(chain.weights, chain.intercepts):
        x = np.concatenate([x, sigmoid(x @ w + b)[:, None]], 1)
    return x[:, -len(chain.weights) :]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train_docs: int = 5_000, most_features: int = 400, n_folds: int = 3) -> Chain:
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_train_docs)
    sample = one_row_each(docs, chosen, id_col, text_col).select(F.xxhash64("id", "text").alias("row"), "text", "y")

    def tally(batches: Iterable[pa.RecordBatch]):
        counts: dict[str, list[int]] = {}
        for b in slices(batches):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in {f for w in word_counts(text) for f in features_of(w)}:
                    counts.setdefault(f, [0, 0])[y > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], ["feature", "clean", "toxic"])

    sizes = {r["y"] > 0: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Chain({}, None, [])
    n0, n1 = sizes[False], sizes[True]
    table = sample.select("text", "y").mapInArrow(tally, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = table.where(F.col("clean") + F.col("toxic") >= LEAST_DOCS)
    odds = F.log((F.col("toxic") + 0.5) / (n1 - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (n0 - F.col("clean") + 0.5))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (n1 - F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5) + 1 / (n0 - F.col("clean") + 0.5))
    kept = table.withColumn("z", odds / spread).where("z >= 3").orderBy(F.desc("z"), "feature").limit(most_features).collect()
    features = {r["feature"]: i for i, r in enumerate(kept)}
    pure = {r["feature"] for r in kept if r["toxic"] >= PURITY * (r["toxic"] + r["clean"])}

    def rows(batches: Iterable[pa.RecordBatch]):
        for b in slices(batches):
            found, hits = [], []
            for text in b.column(1).to_pylist():
                counts, n = Counter(), 0
                for w, c in word_counts(text).items():
                    of = [f for f in features_of(w) if f in features]
                    for f in of:
                        counts[features[f]] += c
                    n += c * any(f in pure for f in of)
                found.append(sorted(counts.items()))
                hits.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[c for _, c in f] for f in found], pa.list_(pa.int64())), pa.array(hits, pa.int64()), b.column(2)],
                ["row", "feature", "count", "hits", "y"])

    data = sorted(sample.mapInArrow(rows, "row bigint, feature array<int>, count array<bigint>, hits bigint, y int").collect())
    if not data:
        return Chain({}, None, [])
    x = np.zeros((len(data), len(features)))
    for i, r in enumerate(data):
        x[i, r["feature"]] = np.log1p(r["count"])
    y = np.array([[r["hits"] > 0, r["hits"] >= REPEATED, r["y"] > 0] for r in data], np.float64)
    weights, intercepts = fit_chain(x, y, np.array([r["row"] % n_folds for r in data]))
    return Chain(features, weights, intercepts)


class Scorer:
    """Scores texts under a chain; words are looked up once."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.known = Cache(lambda w: tuple(chain.features[f] for f in features_of(w) if f in chain.features), 200_000)

    def __call__(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.chain.features)))
        for i, text in enumerate(texts):
            for w, c in word_counts(text).items():
                for f in self.known[w]:
                    x[i, f] += c
        return probabilities(self.chain, np.log1p(x))


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""
    made: list[Scorer] = []

    def keep(texts: list[str]) -> list[bool]:
        if chain.weights is None:
            return [True] * len(texts)
        made[:] = made or [Scorer(chain)]
        return (made[0](texts)[:, -1] < threshold).tolist()

    return where_text(docs, text_col, keep)


def judge(docs: DataFrame, chain: Chain, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, one probability for each category (``p_`` and its name), and ``is_toxic`` (the last one is at least ``threshold``)."""

    def run(batches: Iterable[pa.RecordBatch]):
        score = Scorer(chain)
        for b in slices(batches):
            p = score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, j]) for j in range(len(CATEGORIES))), pa.array((p[:, -1] >= threshold) & (chain.weights is not None))], [id_col, *(f"p_{c}" for c in CATEGORIES), "is_toxic"])

    schema = f"`{id_col}` {kind_of(docs, id_col)}, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", is_toxic boolean"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
