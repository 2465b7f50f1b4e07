"""A byte-level convolutional network that scores text quality, in numpy.

The whole text is read as bytes, in chunks of four blocks that overlap by one block. Learned filters six bytes wide
slide over every byte; a chunk keeps each filter's maximum; a small layer turns these into one figure for the chunk,
and the mean, largest and smallest chunk figure are combined into one probability. Training runs in one task over a
bounded sample of labelled texts; scoring is a map.

Defined results: null and empty texts are one chunk of padding and get the score that the network gives it; with no
labels of either kind (or no texts of theirs) to learn from every score is the share of label 1 (0.5 without labels); a null doc_id stays
null; repeated rows each get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import labelled_sample, raw_texts, slices

BLOCK, PER_CHUNK, STEP, WIDTH, CLASSES = 128, 4, 3, 6, 128
#: Bytes as the filters see them: ASCII as it is, of longer characters' bytes the high bits, in the control codes' places.
CLASS_OF = np.array([b if b < 128 else 1 + (b - 128) // 8 if b < 192 else 14 + (b - 192) // 4 for b in range(256)], np.int32)
_SPAN = 512  # blocks whose responses are held at once


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled texts of each label that are learned from."""

    sample: int = 1500
    filters: int = 16
    hidden: int = 16
    epochs: int = 10
    batch: int = 48
    rate: float = 0.01
    seed: int = 5


class Layout:
    """Texts padded into blocks, and which blocks make up which chunk."""

    def __init__(self, docs: list[bytes]) -> None:
        blocks = np.array([(len(t) + WIDTH + BLOCK - 1) // BLOCK for t in docs], np.int64)
        self.n_blocks = int(blocks.sum())
        self.data = np.zeros(self.n_blocks * BLOCK + BLOCK, np.uint8)
        first = np.cumsum(blocks) - blocks
        for t, at in zip(docs, (first * BLOCK).tolist(), strict=True):
            self.data[at : at + len(t)] = np.frombuffer(t, np.uint8)
        self.chunks = np.maximum(1, -(-(blocks - 1) // STEP))
        self.first_chunk = np.cumsum(self.chunks) - self.chunks
        doc = np.repeat(np.arange(len(docs)), self.chunks)
        start = first[doc] + STEP * (np.arange(len(doc)) - self.first_chunk[doc])
        self.members = np.minimum(start[:, None] + np.arange(PER_CHUNK), (first + blocks - 1)[doc][:, None])
        self.doc = doc


class Network:
    """The parameters by name, and what they compute."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = params

    @classmethod
    def fresh(cls, s: Settings) -> Network:
        """Random parameters from the settings' seed."""
        r = np.random.default_rng(s.seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            {
                "taps": normal(WIDTH, CLASSES, s.filters, scale=0.4),
                "shift": np.zeros(s.filters, np.float32),
                "mix": normal(s.filters, s.hidden, scale=0.3),
                "mix_shift": np.zeros(s.hidden, np.float32),
                "sum": normal(s.hidden, scale=0.3),
                "pool": np.array([1.0, 0.5, 0.5], np.float32),
                "bias": np.zeros(1, np.float32),
            }
        )

    def block_maxima(self, data: np.ndarray, n_blocks: int, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each block's largest response of every filter, and where it is."""
        taps = self.p["taps"]
        pairs = [(taps[k][:, None] + taps[k + 1][None]).reshape(CLASSES * CLASSES, -1) for k in range(0, WIDTH, 2)]
        cls = CLASS_OF[data]
        pair = cls[:-1] * CLASSES + cls[1:]
        out = np.empty((n_blocks, taps.shape[2]), np.float32)
        where = np.empty(out.shape, np.int64) if places else None
        for a in range(0, n_blocks, _SPAN):
            b = min(n_blocks, a + _SPAN)
            i, j = a * BLOCK, b * BLOCK
            z = pairs[0][pair[i:j]]
            z += pairs[1][pair[i + 2 : j + 2]]
            z += pairs[2][pair[i + 4 : j + 4]]
            z = z.reshape(b - a, BLOCK, -1)
            if places:
                own = z.argmax(axis=1)
                out[a:b] = np.take_along_axis(z, own[:, None], 1)[:, 0]
                where[a:b] = own + np.arange(i, j, BLOCK)[:, None]
            else:
                half = BLOCK
                while half > 1:
                    half //= 2
                    z = np.maximum(z[:, :half], z[:, half : 2 * half])
                out[a:b] = z[:, 0]
        return out, where

    def head(self, lay: Layout, blocks: np.ndarray) -> dict[str, np.ndarray]:
        """From block maxima to one logit for each text; keeps what the gradient needs."""
        p = self.p
        grouped = blocks[lay.members]
        pre = grouped.max(axis=1) + p["shift"]
        h = np.maximum(pre, 0)
        g_pre = h @ p["mix"] + p["mix_shift"]
        g = np.maximum(g_pre, 0)
        e = g @ p["sum"]
        mean = np.add.reduceat(e, lay.first_chunk) / lay.chunks
        most = np.maximum.reduceat(e, lay.first_chunk)
        least = np.minimum.reduceat(e, lay.first_chunk)
        pooled = np.stack([mean, most, least], axis=1)
        return {"grouped": grouped, "pre": pre, "h": h, "g_pre": g_pre, "g": g, "e": e, "pooled": pooled, "logit": pooled @ p["pool"] + p["bias"][0]}

    def score(self, docs: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        lay = Layout(docs)
        return _sigmoid(self.head(lay, self.block_maxima(lay.data, lay.n_blocks)[0])["logit"].astype(np.float64))

    def gradient(self, docs: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the weighted log loss."""
        p, lay = self.p, Layout(docs)
        blocks, where = self.block_maxima(lay.data, lay.n_blocks, places=True)
        s = self.head(lay, blocks)
        d = ((_sigmoid(s["logit"]) - labels) * weights / len(docs)).astype(np.float32)
        e, doc = s["e"], lay.doc
        share = p["pool"][0] / lay.chunks[doc]
        share = share + p["pool"][1] * (e == s["pooled"][doc, 1]) + p["pool"][2] * (e == s["pooled"][doc, 2])
        de = (d[doc] * share).astype(np.float32)
        dg = de[:, None] * p["sum"] * (s["g_pre"] > 0)
        dh = dg @ p["mix"].T * (s["pre"] > 0)
        block = np.take_along_axis(lay.members, s["grouped"].argmax(axis=1), 1)
        place = where[block, np.arange(dh.shape[1])]
        cls = CLASS_OF[lay.data]
        taps = np.zeros_like(p["taps"])
        filters = np.broadcast_to(np.arange(dh.shape[1]), dh.shape)
        for k in range(WIDTH):
            slot = cls[place + k].astype(np.int64) * dh.shape[1] + filters
            taps[k] = np.bincount(slot.ravel(), dh.ravel(), CLASSES * dh.shape[1]).reshape(CLASSES, -1)
        return {"taps": taps, "shift": dh.sum(axis=0), "mix": s["h"].T @ dg, "mix_shift": dg.sum(axis=0), "sum": s["g"].T @ de, "pool": s["pooled"].T @ d, "bias": d.sum(keepdims=True)}

    def train(self, docs: list[bytes], labels: np.ndarray, weights: np.ndarray, s: Settings) -> None:
        """Adam over shuffled batches."""
        r = np.random.default_rng(s.seed + 1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, total = 0, s.epochs * -(-len(docs) // s.batch)
        for _ in range(s.epochs):
            order = r.permutation(len(docs))
            for a in range(0, len(docs), s.batch):
                own = order[a : a + s.batch]
                step += 1
                rate = s.rate * min(1.0, 1.2 * (1 - step / (total + 1)) + 0.02)
                for k, g in self.gradient([docs[i] for i in own], labels[own], weights[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def dumped(self) -> bytes:
        """The parameters as bytes."""
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Network:
        """The network that ``dumped`` has written."""
        return cls(dict(np.load(io.BytesIO(data))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network:
    """Learn from the texts (doc_id, text) that ``labels`` (doc_id, label) marks 0 or 1; other labels are ignored."""
    some, counts = labelled_sample(docs, labels, settings.sample)
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    constant = Network.fresh(settings)
    constant.p["pool"][:] = 0
    constant.p["bias"][:] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
    if len(counts) < 2:
        return constant

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        labels = pdf["label"].to_numpy(np.float32)
        drawn = np.array([(labels == 0).mean(), (labels == 1).mean()])
        weights = (np.array([1 - share, share]) / np.maximum(drawn, 1e-9))[labels.astype(int)].astype(np.float32)
        weights = np.sqrt(weights)  # halfway between the drawn and the true shares
        net = Network.fresh(settings)
        net.train([(t or "").encode() for t in pdf["text"]], labels, weights, settings)
        return pd.DataFrame({"weights": [net.dumped()]})

    found = some.groupBy(F.lit(1).alias("one")).applyInPandas(learn, "weights binary").first()
    return Network.loaded(bytes(found["weights"])) if found else constant  # no labelled id may have a text


def score(docs: DataFrame, network: Network) -> DataFrame:
    """One row per document: doc_id, score."""
    weights = network.dumped()  # of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.loaded(weights)
        for batch in slices(batches):
            own = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([own, pa.array(net.score(raw_texts(batch)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")
