"""Language identification by nearest centroid.

A text becomes a vector of hashed byte n-grams (one to three bytes, lower case, everything but letters folded to a
space), weighted by log-scaled term frequency times inverse document frequency and scaled to length one. Each
language has several centroids, found by spherical k-means over a bounded sample of its texts; document frequencies
cover every learnable text. A text gets the language of the centroid with the largest cosine; it is rejected if its
distance exceeds what the language's own texts of that length show.

Defined results: a null text or one without a letter (Unicode category L) is ``und`` with score 0 and rejected; with nothing to learn
from every text is; ties between centroids go to the first language in sorted order; a null doc_id stays null;
repeated rows each get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import sampled, slices, texts

_OTHER = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Texts whose vectors are built at once.
_ROWS = 256


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the texts of a language from which its ``clusters`` centroids are learned."""

    buckets: int = 4096
    clusters: int = 4
    sample: int = 500
    rounds: int = 8
    quantile: float = 0.995
    slack: float = 0.10


def gram_counts(docs: list[str], buckets: int) -> np.ndarray:
    """Hashed n-gram counts, one row for each text."""
    raw = [b" " + _OTHER.sub(" ", t.lower()).encode() + b" " for t in docs]
    sizes = np.array([len(t) for t in raw], np.int64)
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    base = np.repeat(np.arange(len(raw), dtype=np.int64) * buckets, sizes)
    total = np.zeros(len(raw) * buckets, np.int64)
    code = np.zeros(len(b), np.uint32)
    for n in (1, 2, 3):
        code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
        if n > 1:
            inside = base[: len(code)] == base[n - 1 :]
        slot = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(8)
        slot = base[: len(code)] + slot % np.uint32(buckets)
        total += np.bincount(slot if n == 1 else slot[inside], minlength=len(total))
    return total.reshape(len(raw), buckets)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: log-scaled counts times ``idf``."""
    x = np.log1p(counts).astype(np.float32) * idf.astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def centroids_of(x: np.ndarray, clusters: int, rounds: int) -> np.ndarray:
    """Spherical k-means; the first centres are the text nearest the mean and then each time the farthest text."""
    centre = [x[int(np.argmax(x @ x.mean(axis=0)))]]
    while len(centre) < min(clusters, len(x)):
        centre.append(x[int(np.argmin((x @ np.stack(centre).T).max(axis=1)))])
    c = np.stack(centre)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for k in range(len(c)):
            if (own == k).any():
                m = x[own == k].mean(axis=0)
                c[k] = m / max(float(np.linalg.norm(m)), 1e-9)
    return c


def _length_class(n_chars: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n_chars + 1).astype(np.int64), 20)


@dataclass
class Model:
    """Centroids with their languages, and the accepted distance by language and length class."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray
    settings: Settings

    def nearest(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: the language's number (-1: none), the cosine, and whether the distance is accepted."""
        lang, score = np.full(len(docs), -1), np.zeros(len(docs))
        said = np.flatnonzero([bool(_LETTER.search(t)) for t in docs]) if self.languages else np.zeros(0, np.int64)
        for k in range(0, len(said), _ROWS):
            own = said[k : k + _ROWS]
            cos = vectors(gram_counts([docs[i] for i in own], self.settings.buckets), self.idf) @ self.centroids.T
            best = np.argmax(cos, axis=1)
            lang[own], score[own] = self.owner[best], np.clip(cos[np.arange(len(own)), best], 0, 1)
        size = _length_class(np.array([len(t) for t in docs], np.int64))
        near = (lang >= 0) & (1 - score <= self.radius[lang, size]) if self.languages else lang >= 0
        return lang, score, near


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from all rows with a text and a language (columns doc_id, text, lang)."""
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    buckets = settings.buckets

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(buckets, np.int64), 0
        for batch in slices(batches):
            docs = texts(batch)
            n += len(docs)
            for k in range(0, len(docs), _ROWS):
                total += (gram_counts(docs[k : k + _ROWS], buckets) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, buckets)), pa.array(np.r_[n, total])], names=["slot", "n"])

    # One row for each bucket reaches the driver.
    found = rows.select("text").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(buckets + 1, np.int64)
    seen[found["slot"].to_numpy(np.int64) + 1] = found["n"]
    idf = np.log((1 + seen[0]) / (1 + seen[1:])) + 1
    some, _ = sampled(rows, "lang", settings.sample)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"]).head(2 * settings.sample)
        docs = pdf["text"].tolist()
        x = np.concatenate([vectors(gram_counts(docs[k : k + _ROWS], buckets), idf) for k in range(0, len(docs), _ROWS)])
        c = centroids_of(x, settings.clusters, settings.rounds)
        far = 1 - (x @ c.T).max(axis=1)
        size = _length_class(np.array([len(t) for t in docs], np.int64))
        radius = np.full(21, np.nan)
        for k in np.unique(size):
            radius[k] = np.quantile(far[size == k], settings.quantile) + settings.slack
        radius = pd.Series(radius).bfill().ffill().to_numpy()
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "cluster": range(len(c)), "centroid": list(c), "radius": [radius] * len(c)})

    out = some.groupBy("lang").applyInPandas(learn, "lang string, cluster int, centroid array<float>, radius array<double>").toPandas()
    out = out.sort_values(["lang", "cluster"])
    languages = sorted(set(out["lang"]))
    if not languages:
        return Model([], idf, np.zeros((0, buckets), np.float32), np.zeros(0, np.int64), np.zeros((0, 21)), settings)
    return Model(
        languages,
        idf,
        np.stack([np.asarray(c, np.float32) for c in out["centroid"]]),
        np.array([languages.index(x) for x in out["lang"]]),
        np.stack([np.asarray(out[out["lang"] == x]["radius"].iloc[0]) for x in languages]),
        settings,
    )


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, nearest (language or ``und``), score (cosine), lang (``und`` if rejected)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # clusters x buckets x languages: no larger with more rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = [*model.languages, UNKNOWN]
        for batch in slices(batches):
            lang, score, near = model.nearest(texts(batch))
            nearest = [names[k] for k in lang]
            own = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            columns = [own, pa.array(nearest, pa.string()), pa.array(score, pa.float64()), pa.array([x if ok else UNKNOWN for x, ok in zip(nearest, near, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "nearest", "score", "lang"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, nearest string, score double, lang string")
