"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another: the model of a category sees the text's features and the probabilities
of all earlier categories. While training, these probabilities come from models that have not seen the row
(out-of-fold predictions); while scoring, from the models trained on all rows.

The labels table has one flag, so the chain's categories are derived from the texts it marks: two-means over their
features splits them into ``kind_a`` (the larger part) and ``kind_b``; ``toxic`` itself comes last and decides.
Features are words and four- and five-letter word beginnings that some toxic texts share; each counts by the
logarithm of its occurrences. For each fold they are chosen anew, the kinds are found anew and the models trained anew,
all from the rows outside it, with folds within these for the later models; so an out-of-fold probability owes nothing
to any label of its row's fold. Training runs in one task over a bounded sample of labelled texts;
scoring is a map.

Defined results: a null text is empty; empty texts get the models' bias and are kept unless that alone rejects them;
with labels of one kind only, or none, nothing is toxic; a null doc_id stays null; repeated rows each get their
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import labelled_sample, only, release, slices, texts

_WORD = re.compile(r"[^\W\d_]+")
CATEGORIES = ("kind_a", "kind_b", "toxic")


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled texts of each label; features need ``least`` toxic texts and are at most ``features``.

    ``memory`` bounds the words whose features a worker remembers.
    """

    sample: int = 3000
    least: int = 4
    features: int = 1000
    folds: int = 4
    rounds: int = 150
    rate: float = 0.1
    ridge: float = 1e-4
    threshold: float = 0.5
    memory: int = 100_000


def features_of(word: str) -> tuple[str, ...]:
    """The names of a word's features."""
    return (word, *(f"{word[:n]}-" for n in (4, 5) if len(word) > n))


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall(text.lower())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of a logistic model, the bias last, by accelerated gradient steps."""
    x1 = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w = np.zeros(x1.shape[1], np.float32)
    pull = np.full(x1.shape[1], s.ridge, np.float32)
    pull[-1] = 0
    step, moving = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, s.rounds + 1):
        g = ((_sigmoid(x1 @ w) - y) / max(1, len(y))).astype(np.float32) @ x1 + pull * w
        step, moving = 0.9 * step + 0.1 * g, 0.99 * moving + 0.01 * g * g
        w = w - s.rate * min(1.0, 2 * (1 - t / (s.rounds + 1))) * (step / (1 - 0.9**t)) / (np.sqrt(moving / (1 - 0.99**t)) + 1e-6)
    return w


@dataclass
class Chain:
    """Feature numbers and each category's weights: features, earlier categories, bias."""

    features: dict[str, int]
    weights: list[np.ndarray]
    settings: Settings
    _memory: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def matrix(self, docs: list[str]) -> np.ndarray:
        """Log-scaled feature counts, one row for each text."""
        out = np.zeros((len(docs), len(self.features)), np.float32)
        memory, known = self._memory, self.features
        if len(memory) > self.settings.memory:
            memory.clear()
        for k, text in enumerate(docs):
            hits: list[int] = []
            for w in words_of(text):
                got = memory.get(w)
                if got is None:
                    got = memory[w] = tuple(known[f] for f in features_of(w) if f in known)
                if got:
                    hits.extend(got)
            if hits:
                out[k] = np.bincount(hits, minlength=len(known))
        return np.log1p(out)

    def probabilities(self, docs: list[str]) -> np.ndarray:
        """One column for each category, predicted in turn."""
        x = self.matrix(docs)
        before = np.zeros((len(docs), 0))
        for w in self.weights:
            p = _sigmoid(x @ w[: x.shape[1]] + before @ w[x.shape[1] : -1] + w[-1])
            before = np.concatenate([before, p[:, None]], axis=1)
        return before


def chosen_features(owns: list[tuple[str, ...]], toxic: np.ndarray, rows: np.ndarray, s: Settings) -> list[str]:
    """The features that say most about ``toxic`` among the texts that ``rows`` marks; ``owns`` has each text's features."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for k in np.flatnonzero(rows).tolist():
        seen[int(toxic[k])].update(owns[k])
    n = [max(1, int((rows & (toxic == v)).sum())) for v in (False, True)]
    lift = {f: np.log((c + 0.5) / n[1]) - np.log((seen[0][f] + 0.5) / n[0]) for f, c in seen[1].items() if c >= s.least}
    return sorted((f for f, v in lift.items() if v > 1), key=lambda f: (-lift[f] * np.sqrt(seen[1][f]), f))[: s.features]


def two_kinds(x: np.ndarray) -> np.ndarray:
    """Which rows are of the second kind: two-means of unit vectors from the two rows that lie farthest apart."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    if len(unit) < 2:
        return np.zeros(len(unit), bool)
    one = int(np.argmin(unit @ unit.mean(axis=0)))
    centres = np.stack([unit[one], unit[int(np.argmin(unit @ unit[one]))]])
    for _ in range(10):
        second = (unit @ centres.T).argmax(axis=1) == 1
        for k, own in enumerate((~second, second)):
            if own.any():
                centres[k] = unit[own].mean(axis=0)
    return second if second.sum() <= len(second) / 2 else ~second


def kinds_of(x: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Which rows are of which kind, by the toxic ones' features alone."""
    second, which = two_kinds(x[toxic]), np.flatnonzero(toxic)
    out = {name: np.zeros(len(toxic), bool) for name in CATEGORIES[:-1]}
    for name, own in zip(CATEGORIES[:-1], (~second, second), strict=True):
        out[name][which[own]] = True
    return out


class Lesson:
    """Labelled texts and what can be learned from parts of them."""

    def __init__(self, docs: list[str], toxic: np.ndarray, s: Settings) -> None:
        self.docs, self.toxic, self.s = docs, toxic, s
        self.owns = [tuple({f for w in set(words_of(text)) for f in features_of(w)}) for text in docs]
        self.fold = np.arange(len(docs)) % s.folds
        self.inner = np.arange(len(docs)) // s.folds % s.folds

    def features(self, rows: np.ndarray) -> dict[str, int]:
        """The features chosen by the rows' labels."""
        return {f: k for k, f in enumerate(chosen_features(self.owns, self.toxic, rows, self.s))}

    def matrix(self, features: dict[str, int]) -> np.ndarray:
        """All texts' features."""
        part = Chain(features, [], self.s)
        return np.concatenate([part.matrix(self.docs[k : k + 512]) for k in range(0, len(self.docs), 512)])

    def out_of_fold(self) -> np.ndarray:
        """Each row's probabilities of the kinds from models that owe nothing to the labels of its fold.

        Features, kinds and models of a fold come from the other folds' rows. Among these a later model again sees earlier
        probabilities from models without the row: inner folds, which share the features and kinds.
        """
        unseen = np.zeros((len(self.docs), len(CATEGORIES) - 1), np.float32)
        for k in range(self.s.folds):
            learnt = self.fold != k
            own = self.matrix(self.features(learnt))
            kinds, before = kinds_of(own, self.toxic & learnt), np.zeros((len(own), 0), np.float32)
            for c, name in enumerate(CATEGORIES[:-1]):
                both, y = np.concatenate([own, before], axis=1), kinds[name].astype(np.float32)

                def predicted(by: np.ndarray, of: np.ndarray, both=both, y=y) -> np.ndarray:
                    w = logistic(both[by], y[by], self.s)
                    return _sigmoid(both[of] @ w[:-1] + w[-1]).astype(np.float32)

                p = np.zeros(len(own), np.float32)
                p[~learnt] = unseen[~learnt, c] = predicted(learnt, ~learnt)
                for j in range(self.s.folds if c < len(CATEGORIES) - 2 else 0):
                    own_part = learnt & (self.inner == j)
                    p[own_part] = predicted(learnt & (self.inner != j), own_part)
                before = np.concatenate([before, p[:, None]], axis=1)
        return unseen


def learn_chain(docs: list[str], toxic: np.ndarray, s: Settings) -> Chain:
    """Choose features and train the chain; the probabilities that later models see come from models without the row's fold."""
    lesson = Lesson(docs, toxic, s)
    chain = Chain(lesson.features(np.ones(len(docs), bool)), [], s)
    x, unseen = lesson.matrix(chain.features), lesson.out_of_fold()
    labels = kinds_of(x, toxic) | {CATEGORIES[-1]: toxic}
    for c, name in enumerate(CATEGORIES):
        w = logistic(np.concatenate([x, unseen[:, :c]], axis=1), labels[name].astype(np.float32), s)
        chain.weights.append(w.astype(np.float64))
    return chain


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Chain:
    """Learn from the texts (doc_id, text) that ``labels`` (doc_id, label) marks 0 or 1 (toxic); others are ignored."""
    some, counts = labelled_sample(docs, labels, settings.sample)
    nothing = Chain({}, [np.r_[np.zeros(k), -10.0] for k in range(len(CATEGORIES))], settings)
    if len(counts) < 2:
        return nothing

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        chain = learn_chain([t or "" for t in pdf["text"]], pdf["label"].to_numpy() == 1, settings)
        release()
        names = [list(chain.features)] + [[]] * (len(chain.weights) - 1)
        return pd.DataFrame({"k": range(len(chain.weights)), "features": names, "weights": chain.weights})

    found = some.groupBy(F.lit(1).alias("one")).applyInPandas(learn, "k int, features array<string>, weights array<double>").collect()
    if not found:  # no labelled id has a text
        return nothing
    out = sorted(found, key=lambda r: r["k"])
    return Chain({f: k for k, f in enumerate(out[0]["features"])}, [np.array(r["weights"]) for r in out], settings)


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """One row per document: doc_id, one probability per category, rejected (toxic beyond the threshold)."""
    held = docs.sparkSession.sparkContext.broadcast(chain)  # of fixed size: settings.features

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        chain = held.value
        for batch in slices(batches):
            p = np.concatenate([chain.probabilities(d) for d in _cut(texts(batch), 512)])
            own = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            columns = [own, *(pa.array(p[:, k], pa.float64()) for k in range(len(CATEGORIES))), pa.array(p[:, -1] >= chain.settings.threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *CATEGORIES, "rejected"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id long, {', '.join(f'{c} double' for c in CATEGORIES)}, rejected boolean")


def keep_clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't rejected; a map without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        chain = held.value
        for batch in slices(batches):
            p = np.concatenate([chain.probabilities(d)[:, -1] for d in _cut(texts(batch), 512)])
            yield batch.filter(pa.array(p < chain.settings.threshold))

    return docs.mapInArrow(work, docs.schema)


def _cut(docs: list[str], size: int) -> Iterator[list[str]]:
    return (docs[k : k + size] for k in range(0, len(docs), size))
