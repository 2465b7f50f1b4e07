"""Quality rules: word statistics and compression bands.

Each whole text is compressed with zstandard, once as a whole and once in fixed chunks. Repetitive text
compresses far better than prose, noise far worse, and how much is normal depends on the length: a band gives the
lowest and highest accepted ratio (bytes over compressed bytes) for texts up to a length, and the share of chunks
that may lie outside the chunk band. ``calibrated`` sets the bands from all texts labelled good: by half octaves of
the length, the outer quantiles of their ratios and some slack. Without such texts wide default bands hold.

Chunks cover the whole text: what is left after the full ones is a chunk too, judged by the band of its length; fewer
bytes than ``least_tail`` say too little and belong to the chunk before. A text shorter than a chunk is one.

Defined results: null and empty texts have no words, fail the base rules and aren't kept; ratio of an empty text
is 0; a null doc_id stays null; repeated rows each get their row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import filtered, numbered, raw_texts, sketch, slices

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long, verdict string"
)
_SYMBOLS = b"#*$%&|<>"
_NOT_SPACE = bytes(b for b in range(256) if b == 0x20 or 9 <= b <= 13)
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Lengths are counted by this many steps an octave, ratios by this many steps a factor of e.
_PLACES, _STEPS = 8, 512


@dataclass(frozen=True)
class Band:
    """Accepted compression ratios of texts with fewer than ``below`` bytes."""

    below: float
    lowest: float
    highest: float


@dataclass(frozen=True)
class Calibration:
    """How bands are learned: a band rests on the ``least`` texts nearest in length, or more."""

    least: int = 40
    quantile: float = 0.005
    slack: float = 0.03


@dataclass(frozen=True)
class Limits:
    """Bands for whole texts by length, one band for chunks, and the share of chunks that may leave it."""

    bands: tuple[Band, ...] = (
        Band(64, 0.50, 2.0),
        Band(128, 0.70, 2.5),
        Band(256, 0.90, 3.0),
        Band(1024, 1.20, 3.5),
        Band(4096, 1.35, 4.0),
        Band(16384, 1.40, 4.5),
        Band(float("inf"), 1.40, 5.0),
    )
    chunk_bytes: int = 4096
    chunk_lowest: float = 1.35
    chunk_highest: float = 5.0
    bad_chunk_share: float = 0.25
    least_tail: int = 64
    level: int = 3


def repeated_words(owner: np.ndarray, words: np.ndarray, n_docs: int, width: int = 5) -> np.ndarray:
    """For each text, its words inside ``width``-word windows that the text holds twice or more.

    ``words`` holds the words' numbers, text after text, and ``owner`` the text of each word.
    """
    n = len(words)
    counts = np.zeros(n_docs, np.int64)
    if n < width + 1:
        return counts
    key = owner[: n - width + 1].astype(np.int64)
    inside = owner[width - 1 :] == owner[: n - width + 1]
    where = np.flatnonzero(inside)
    key = key[where]
    for k in range(width):  # exact: each step renumbers the pairs (prefix so far, next word)
        key = key * (int(words.max()) + 1) + words[where + k]
        if k + 1 < width:
            key = pd.factorize(key)[0].astype(np.int64)
    codes, distinct = pd.factorize(key)
    twice = where[np.bincount(codes, minlength=len(distinct))[codes] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + width, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(owner[covered], minlength=n_docs)


def _duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.translate(None, _NOT_SPACE)]
    return len(lines) - len(set(lines))


def chunk_ends(size: int, limits: Limits) -> list[int]:
    """Where the chunks of a text of ``size`` bytes end."""
    ends = list(range(limits.chunk_bytes, size + 1, limits.chunk_bytes))
    rest = size - (ends[-1] if ends else 0)
    if ends and 0 < rest < limits.least_tail:
        ends[-1] = size
    elif rest:
        ends.append(size)
    return ends


def compression(limits: Limits) -> Callable[[bytes], float]:
    """A function from bytes to their compression ratio."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=limits.level, write_content_size=False, write_checksum=False)
    return lambda data: len(data) / len(packer.compress(data)) if data else 0.0


def outer_steps(steps: np.ndarray, counts: np.ndarray, c: Calibration) -> tuple[float, float]:
    """The lowest and highest accepted ratio by the counts of steps."""
    order = np.argsort(steps)
    upto = np.cumsum(counts[order])
    low, high = (steps[order][np.searchsorted(upto, q * (upto[-1] - 1), side="right")] for q in (c.quantile, 1 - c.quantile))
    return float(np.exp(low / _STEPS)) * (1 - c.slack), float(np.exp((high + 1) / _STEPS)) * (1 + c.slack)


def bands_of(places: np.ndarray, steps: np.ndarray, counts: np.ndarray, c: Calibration) -> tuple[Band, ...]:
    """Bands by half octaves from the counts of texts by length and ratio; each rests on the ``least`` texts nearest in length at least."""
    out = []
    for k in range(10, 42):  # from 32 bytes to 2 MiB, and beyond
        apart = np.abs((places + 0.5) / _PLACES - (k + 0.5) / 2)
        order = np.argsort(apart)
        enough = apart[order][min(np.searchsorted(np.cumsum(counts[order]), c.least), len(order) - 1)]
        own = apart <= max(0.5, enough)
        low, high = outer_steps(steps[own], counts[own], c)
        out.append(Band(2 ** ((k + 1) / 2) if k < 41 else float("inf"), low, high))
    return tuple(out)


def calibrated(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), c: Calibration = Calibration()) -> Limits:
    """Limits whose bands follow the texts that ``labels`` (doc_id, label) marks 1; ``limits`` itself if there are under ``least``.

    All such texts are measured where they lie, an id once; what reaches the driver are counts by length and ratio, whose
    number doesn't grow with the tables.
    """
    good = labels.filter("label = 1").select("doc_id").distinct()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = compression(limits)
        step = lambda data: int(np.floor(np.log(ratio(data)) * _STEPS))
        schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("step", pa.int64()), ("chunks", pa.list_(pa.int64()))])
        for batch in slices(batches):
            ids, rows = batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), []
            for key, t in zip(ids, raw_texts(batch), strict=True):
                words = t.split()
                if len(words) < 10 or 100 * int(repeated_words(np.zeros(len(words), np.int64), numbered(words)[0], 1)[0]) > 20 * len(words):
                    continue
                ends = [e for e in chunk_ends(len(t), limits) if e % limits.chunk_bytes == 0]
                rows.append({"doc_id": key, "size": len(t), "step": step(t), "chunks": [step(t[e - limits.chunk_bytes : e]) for e in ends]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    may = filtered(docs.select("doc_id", "text"), F.xxhash64("doc_id"), sketch(good.select(F.xxhash64("doc_id").alias("h")), "h"))[0]
    measured = may.select("doc_id", "text").mapInArrow(measure, "doc_id long, size long, step long, chunks array<long>")
    once = measured.join(good, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("size", "step", "chunks")).alias("r")).select("r.*")
    place = F.floor(F.log2("size") * _PLACES).cast("int")
    each = F.concat(F.array(F.struct(place.alias("place"), F.col("step").alias("step"))), F.transform("chunks", lambda x: F.struct(F.lit(-1).alias("place"), x.alias("step"))))
    found = once.select(F.explode(each).alias("e")).groupBy("e.place", "e.step").agg(F.count("*").alias("n")).toPandas()
    whole, chunks = found[found.place >= 0], found[found.place < 0]
    if whole.n.sum() < c.least:
        return limits
    bands = bands_of(whole.place.to_numpy(), whole.step.to_numpy(), whole.n.to_numpy(), c)
    if chunks.n.sum() < c.least:
        full = next(b for b in bands if limits.chunk_bytes < b.below)
        return replace(limits, bands=bands, chunk_lowest=full.lowest, chunk_highest=full.highest)
    low, high = outer_steps(chunks.step.to_numpy(), chunks.n.to_numpy(), c)
    return replace(limits, bands=bands, chunk_lowest=low, chunk_highest=high)


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Word statistics, compression figures and the verdict for every document; a map without a shuffle."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = compression(limits)

        def band_of(size: int) -> Band:
            return next(b for b in limits.bands if size < b.below)

        def chunk_band(size: int) -> tuple[float, float]:
            if size >= limits.chunk_bytes:
                return limits.chunk_lowest, limits.chunk_highest
            return band_of(size).lowest, band_of(size).highest

        schema = pa.schema(
            [("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
            + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()), ("verdict", pa.string())]
        )
        for batch in slices(batches):
            raw = raw_texts(batch)
            split = [t.split() for t in raw]
            n_words = np.array([len(w) for w in split], np.int64)
            owner = np.repeat(np.arange(len(raw)), n_words)
            words = numbered([w for ws in split for w in ws])[0]
            repeats = repeated_words(owner, words, len(raw)) if len(words) else np.zeros(len(raw), np.int64)
            letters = [len(t.translate(None, _NOT_SPACE + _CONTINUATION)) for t in raw]
            symbols = [len(t) - len(t.translate(None, _SYMBOLS)) for t in raw]
            lines = [_duplicate_lines(t) for t in raw]
            failed = (n_words < 10) | (100 * repeats > 20 * n_words)
            ratios, chunks, bad, said = [], [], [], []
            for t, no in zip(raw, failed, strict=True):
                whole = ratio(t)
                band = band_of(len(t))
                ends = chunk_ends(len(t), limits)
                sizes = [b - a for a, b in zip([0, *ends], ends)]
                parts = [ratio(t[b - n : b]) for n, b in zip(sizes, ends, strict=True)] if len(ends) > 1 or len(t) >= limits.chunk_bytes else [whole] * len(ends)
                off = sum(not lowest <= r <= highest for r, (lowest, highest) in zip(parts, map(chunk_band, sizes), strict=True))
                word = "base" if no else "incompressible" if whole < band.lowest else "repetitive" if whole > band.highest else "chunks" if off > limits.bad_chunk_share * max(1, len(parts)) else "kept"
                ratios.append(whole)
                chunks.append(len(parts))
                bad.append(off)
                said.append(word)
            kept = [x == "kept" for x in said]
            columns = [n_words, letters, symbols, lines, repeats, failed, kept, ratios, chunks, bad, said]
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, schema.field(k + 1).type) for k, c in enumerate(columns))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)
