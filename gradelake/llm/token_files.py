"""Token ids in binary blocks: frequency ranks, byte-aligned variable length, control bytes apart from data.

Every text is encoded by the tokenizers library, distinct words once per worker. Ids are counted over the whole
corpus; the more frequent an id, the smaller its rank, and the fewer bytes it takes. Documents are range-partitioned
by doc_id and packed into blocks. Block layout, all little-endian::

    magic "TIB1" | u32 documents, ids, data bytes | i64 doc_ids | u8 null flags | u32 ids of each document
    | control bytes (2 bits an id: bytes - 1, four ids a byte) | data bytes of the ranks

Blocks lie in a binary column of a Parquet dataset in the shared folder, beside the table rank -> id, so Spark's
own committers write them and lost executors are no concern. A reader finds each id's place in a block by numpy
table lookup on the control bytes and a running sum.

Defined results: null and empty texts hold the end id only; null doc_ids come first; documents with the same doc_id
are ordered by their ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.llm.common import WordIds, only, raw_texts, remembered, shared_dir, slices, written

MAGIC = b"TIB1"
BLOCK_IDS = 1 << 20
_BLANK, _REST, _LETTER, _MARK = 0, 1, 2, 4
#: Words end at blanks, and between a letter and a mark (never an apostrophe): the tokenizer's own splitting ends one there.
_KIND = np.array(
    [_BLANK if b == 32 or 9 <= b <= 13 else _LETTER if chr(b).isalpha() and b < 128 else _MARK if 33 <= b < 127 and b != 39 and not chr(b).isdigit() else _REST for b in range(256)],
    np.uint8,
)

_codes = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
#: Of each control byte: the lengths of its four ids.
LENGTHS = (_codes + 1).astype(np.int64)


def default_vocabulary() -> str:
    """Where the public 49,408-word vocabulary lies."""
    return public_tokenizers.path("word_bpe_49k.json")


#: The splitting for which a text's words can be encoded apart. Any other tokenizer gets whole texts.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits_at_words(definition: dict) -> bool:
    """Whether a tokenizer's definition drops white space, ignores case and parts letters from marks."""
    steps = (definition.get("normalizer") or {}).get("normalizers") or []
    split = ((definition.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    blanks = [(x["pattern"], x["content"]) for x in steps if x["type"] == "Replace"] == [({"Regex": r"\s+"}, " ")]
    ours = split.get("pattern") == {"Regex": _SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
    return blanks and ours and [x["type"] for x in steps] == _NORMALIZERS and definition.get("post_processor") is None


class WordEncoder:
    """Encodes words with the tokenizers library; white space separates words and is dropped by the tokenizer.

    The tokenizer's added tokens are taken out of a text first, as they are written, like the library does it. A
    tokenizer that splits texts in another way gets them whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _splits_at_words(json.loads(self.tokenizer.to_str()))
        self.size = self.tokenizer.get_vocab_size()
        self.words = WordIds(self.encode_words)
        added = sorted((t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each word has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([x for xs in ids for x in xs], np.int32), np.array([len(x) for x in ids], np.int64)

    def encode(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8), one after another, and how many each text has."""
        if not self.by_words:
            return self.encode_words([t.decode() for t in docs])
        sizes = np.array([len(t) + 1 for t in docs], np.int64)
        joined = b"".join(t + b" " for t in docs)
        data = np.frombuffer(joined + bytes(8), np.uint8).copy()
        # The tokenizer ignores case: fold A-Z so that fewer words differ, but not under combining marks.
        data[:-1] += 32 * ((data[:-1] >= 65) & (data[:-1] <= 90) & (data[1:] < 128)).astype(np.uint8)
        kind = _KIND[data[:-8]]
        inside = kind != _BLANK
        turn = np.abs(np.diff(kind.astype(np.int8))) == _MARK - _LETTER
        turn &= inside[1:] & inside[:-1] & (kind[1:] != _REST) & (kind[:-1] != _REST)
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | turn
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | turn
        for m in self.added.finditer(joined) if self.added else ():  # an added token is a word of its own
            a, b = m.span()
            data[a:b] = np.frombuffer(m[0], np.uint8)
            opens[a:b] = closes[a:b] = False
            opens[a] = closes[b - 1] = True
            opens[b] = inside[b]
            closes[a - 1 : a] = inside[a - 1 : a]
        before = np.r_[0, np.cumsum(opens)]
        ends = np.cumsum(sizes)
        return self.words.ids(data, np.flatnonzero(opens), np.flatnonzero(closes) + 1, before[ends] - before[ends - sizes])


@lru_cache(maxsize=2)
def encoder_at(path: str) -> WordEncoder:
    """The tokenizer and its word memory, built once in each process."""
    return WordEncoder(path)


remembered("tokens", encoder_at.cache_clear)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ``ranks``."""
    ranks = ranks.astype(np.uint32)
    width = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = width - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    octets = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), octets[np.arange(4) < width[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ranks that ``pack`` has packed."""
    width = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(width) - width
    out = data[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(width > k)
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block_of(doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    """A block of documents with ``counts`` ids each."""
    control, data = pack(ranks)
    ids = np.array([x or 0 for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join([MAGIC, struct.pack("<3I", len(doc_ids), len(ranks), len(data)), ids.tobytes(), nulls.tobytes(), counts.astype("<u4").tobytes(), control, data])


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The doc_ids, id counts and ranks of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n_docs, n_ids, n_data = struct.unpack_from("<3I", block, 4)
    at = 16
    out = []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("u1", -(-n_ids // 4)), ("u1", n_data)):
        out.append(np.frombuffer(block, kind, n, at))
        at += out[-1].nbytes
    ids, nulls, counts, control, data = out
    return [None if no else x for x, no in zip(ids.tolist(), nulls.tolist(), strict=True)], counts.astype(np.int64), unpack(control, data, n_ids)


def tokenized(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id and all ids of each text with the end id, as little-endian unsigned integers of 2 bytes (4 if need be)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens")
        encoder = encoder_at(vocabulary)
        kind = "<u2" if max(encoder.size, end_id) < 1 << 16 else "<u4"
        for batch in slices(batches):
            ids, counts = encoder.encode(raw_texts(batch))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype(kind)
            data = ids.tobytes()
            ends = np.cumsum(counts + 1) * ids.itemsize
            blobs = pa.array([data[e - (c + 1) * ids.itemsize : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())
            own = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([own, blobs, pa.array([ids.itemsize] * len(counts), pa.int32())], names=["doc_id", "ids", "width"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ids binary, width int")


def id_counts(tokens: DataFrame, size: int) -> DataFrame:
    """How often each id occurs; one row for each id and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.bincount(np.frombuffer(ids, f"<u{width}"), minlength=size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["id", "n"])

    return tokens.select("ids", "width").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_ids(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, path: str | None = None) -> str:
    """Write all documents' ids in ascending doc_id order; returns the folder with ``blocks`` and ``ranks``."""
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    path = path or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    size = max(encoder_at(vocabulary).size, end_id + 1)
    tokens = written(tokenized(docs, vocabulary, end_id), "tokens")
    # At most as many rows as the vocabulary has words reach the driver.
    found = id_counts(tokens, size).orderBy(F.desc("n"), "id").toPandas()
    order = found["id"].to_numpy(np.int64)
    rank_of = np.zeros(size, np.uint32)
    rank_of[order] = np.arange(len(order))
    spark.createDataFrame([(k, int(x)) for k, x in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        own: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, own, held, n
            counts = np.array([len(x) for x in held], np.int64)
            row = {"part": part, "seq": seq, "start": start, "n_ids": n, "block": block_of(own, counts, rank_of[np.concatenate(held)])}
            seq, start, own, held, n = seq + 1, start + n, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary())]))

        for batch in batches:
            for doc, ids, width in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own.append(doc)
                held.append(np.frombuffer(ids, f"<u{width}"))
                n += len(held[-1])
                if n >= BLOCK_IDS:
                    yield flush()
        if own:
            yield flush()

    dealt = tokens.select("doc_id", "ids", "width").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    dealt.mapInArrow(blocks, "part int, seq int, start long, n_ids long, block binary").write.parquet(f"{path}/blocks", compression="none")
    return path


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), ids (little-endian u32)."""
    blocks = spark.read.schema("part int, seq int, start long, n_ids long, block binary").parquet(f"{path}/blocks")
    # One row for each partition that wrote blocks, so the broadcast is bounded by the number of partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ids_of = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, counts, ranks = read_block(block)
                data = ids_of[ranks].astype("<u4").tobytes()
                ends = np.cumsum(counts)
                begins = ends - counts
                blobs = [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(first + begins, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "start", "ids"])

    placed = blocks.join(F.broadcast(parts), "part").select((F.col("start") + F.col("base")).alias("first"), "block")
    return placed.mapInArrow(read, "doc_id long, start long, ids binary")
