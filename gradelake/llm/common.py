"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about this many UTF-8 bytes inside a task.
SLICE_BYTES = 2 << 20
#: What operators remember in a worker process, by operator: how to forget it.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembered(operator: str, forget: Callable[[], None]) -> None:
    """Register how to forget what ``operator`` remembers from task to task."""
    _REMEMBERED[operator] = forget


def only(operator: str) -> None:
    """Called where a task of ``operator`` starts: workers are used again, so what other operators remember is forgotten."""
    for other, forget in _REMEMBERED.items():
        if other != operator:
            forget()


def release() -> None:
    """Called where a task ends: memory that is free goes back to the system, as the worker stays."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table, narrowed to ``columns`` so that the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='gradelake-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local folder in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or _local_dir()).rstrip("/")


def files_for(spark: SparkSession, n_bytes: int) -> int:
    """How many files an intermediate of an input of ``n_bytes`` is worth: one for each 8 MiB, two for each core at least."""
    return int(max(2 * spark.sparkContext.defaultParallelism, n_bytes >> 23))


def written(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cuts lineage, survives lost executors.

    At most ``files`` files, where that is given: small tables over many partitions would cost more in files than in rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that ``written`` gave and nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def packed(sorted_tokens: np.ndarray) -> bytes:
    """Sorted 64-bit tokens as differences of six bytes, or of eight if one is too large."""
    steps = np.diff(sorted_tokens, prepend=np.uint64(0))
    wide = len(steps) > 1 and bool((steps[1:] >> np.uint64(48)).any())
    tail = steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 if wide else 6]
    return bytes([8 if wide else 6]) + steps[:1].astype("<u8").tobytes() + tail.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The tokens that ``packed`` gave."""
    width = data[0]
    tail = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((1 + len(tail), 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, :width] = tail
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


class Sketch:
    """A Bloom filter of fixed size over 64-bit hashes: says of any hash whether it may be among those put in."""

    BITS = 1 << 25

    def __init__(self, pages: dict[int, bytes]) -> None:
        self.bits = np.zeros(self.BITS // 8, np.uint8)
        for page, data in pages.items():
            self.bits[page * 4096 : page * 4096 + len(data)] = np.frombuffer(data, np.uint8)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each of the hashes may be among those put in."""
        u, out = hashes.view(np.uint64), np.ones(len(hashes), bool)
        for shift in (0, 30):
            at = ((u >> np.uint64(shift)) & np.uint64(self.BITS - 1)).astype(np.int64)
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def sketch(rows: DataFrame, column: str):
    """A broadcast Sketch of a column of 64-bit hashes: 4 MiB at any number of rows, gathered as bitmaps.

    Once it is full it lets everything through, and what follows works on all rows as it would without it.
    """
    at = [F.shiftrightunsigned(column, shift).bitwiseAND(F.lit(Sketch.BITS - 1)) + 1 for shift in (0, 30)]
    bit = rows.select(F.explode(F.array(*at)).alias("bit"))
    pages = bit.groupBy(F.bitmap_bucket_number("bit").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    return rows.sparkSession.sparkContext.broadcast(Sketch({r["page"] - 1: bytes(r["bits"]) for r in pages.collect()}))


def filtered(docs: DataFrame, hashes, held) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose hash the broadcast sketch may hold, and the others."""
    name = f"may_{uuid.uuid4().hex}"

    def side(inside: bool) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                may = held.value.may_hold(batch.column(batch.num_columns - 1).to_numpy())
                yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(may == inside))

        return docs.withColumn(name, hashes).mapInArrow(work, docs.schema)

    return side(True), side(False)


def crc32_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column as Python strings; null becomes the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The text column as UTF-8 bytes; null becomes the empty string."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def spread(values: np.ndarray, lengths: np.ndarray, which: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """The segments ``which`` of ``values``, one after another; segment k has ``lengths[k]`` values."""
    starts = np.cumsum(lengths) - lengths if starts is None else starts
    size = lengths[which]
    step = np.repeat(starts[which] - (np.cumsum(size) - size), size)
    return values[step + np.arange(int(size.sum()))]


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``values``; group k has ``counts[k]`` of them."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def numbered(words: list) -> tuple[np.ndarray, list]:
    """A number for each word, and the distinct words in the order of their numbers."""
    seen: dict = {}
    give = seen.setdefault
    return np.array([give(w, len(seen)) for w in words], np.int64), list(seen)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``; ``data`` has eight spare bytes at its end."""
    lengths = ends - starts
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    own = np.arange(len(starts))
    at = 0
    while len(own):
        left = np.minimum(lengths[own] - at, 8).astype(np.uint64)
        got = eight[starts[own] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        h = (out[own] ^ got) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        out[own] = h ^ (h >> np.uint64(29))
        at += 8
        own = own[lengths[own] > at]
    return out


class WordIds:
    """Token ids of words, remembered within a worker process by the words' hashes.

    ``encode_words`` takes distinct words and gives all their ids and how many each has. The memory is some tens of
    bytes a word and four bytes an id; it is emptied before it would hold more than ``limit`` words, and once it holds more
    than ``id_limit`` ids. Long words (a paragraph without spaces is one) add to it only until then.
    """

    def __init__(self, encode_words, limit: int = 1_500_000, id_limit: int = 8_000_000) -> None:
        self.encode_words, self.limit, self.id_limit = encode_words, limit, id_limit
        self._empty()

    def _empty(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.levels = [none, none]  # hashes in order with word numbers: the bulk, and what came since
        self.n_known = self.used = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), -1, np.int64)
        for keys, numbers in self.levels:
            if len(keys):
                at = np.searchsorted(keys, hashes)
                at[at == len(keys)] = 0
                same = keys[at] == hashes
                found[same] = numbers[at[same]]
        return found

    @staticmethod
    def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
        return array if used + more <= len(array) else np.concatenate([array[:used], np.zeros(max(used, more) + more, array.dtype)])

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, numbers = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(keys, kind="stable")
        return keys[order], numbers[order]

    def _learn(self, hashes: np.ndarray, words: list[str]) -> np.ndarray:
        ids, counts = self.encode_words(words)
        n, had = len(words), self.n_known
        self.flat = self._room(self.flat, self.used, len(ids))
        self.starts, self.lengths = self._room(self.starts, had, n), self._room(self.lengths, had, n)
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[had : had + n] = counts
        self.starts[had : had + n] = self.used + np.cumsum(counts) - counts
        self.used, self.n_known = self.used + len(ids), had + n
        numbers = np.arange(had, had + n)
        order = np.argsort(hashes)
        bulk, recent = self.levels
        recent = self._merged(recent, (hashes[order], numbers[order]))
        self.levels = [self._merged(bulk, recent), (recent[0][:0], recent[1][:0])] if len(recent[0]) > max(20_000, len(bulk[0]) // 8) else [bulk, recent]
        return numbers

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words ``data[start:end]``, one after another, and how many each text has.

        Text k has ``n_words[k]`` words; ``data`` is UTF-8 with eight spare bytes at its end.
        """
        codes, hashes = pd.factorize(word_hashes(data, starts, ends))
        number = self._find(hashes)
        if (number < 0).any():
            if self.n_known + int((number < 0).sum()) > self.limit or self.used > self.id_limit:
                self._empty()
                number[:] = -1
            first = np.zeros(len(hashes), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            fresh = np.flatnonzero(number < 0)
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist(), strict=True)]
            number[fresh] = self._learn(hashes[fresh], words)
        which = number[codes]
        return spread(self.flat, self.lengths, which, self.starts), segment_sums(self.lengths[which], n_words)


def sampled(rows: DataFrame, group: str, per_group: int) -> tuple[DataFrame, dict]:
    """About ``per_group`` rows at most of each value of ``group`` by a hash of doc_id, and all groups' row counts.

    Of rows with one doc_id the smallest is taken, so an id that is repeated any number of times is one row. The groups are few
    (labels, languages): their counts are on the driver. Null groups are left out.
    """
    counts = {r[0]: r[1] for r in rows.filter(F.col(group).isNotNull()).groupBy(group).count().collect()}
    if not counts:
        return rows.limit(0), counts
    rates = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_group / n))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    return once_an_id(rows.filter(draw < rates[F.col(group)])), counts


def once_an_id(rows: DataFrame) -> DataFrame:
    """The smallest row of each doc_id; taken in each task before anything is shuffled."""
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("one")).select(*(F.col(c) if c == "doc_id" else F.col("one")[c].alias(c) for c in rows.columns))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict]:
    """Texts of about ``per_label`` ids at most of each label (0 or 1) in ``labels`` (doc_id, label), and the labels' counts.

    Only the sampled ids are broadcast, about ``2 * per_label`` at any size of the tables; of an id's texts the smallest counts.
    """
    known = labels.filter(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    some, counts = sampled(known, "label", per_label)
    return once_an_id(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")), counts
