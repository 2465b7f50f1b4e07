"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` consecutive words (a shorter item is one window). A window is the set
of its word shingles. Shingles are ordered by how often they occur in all documents; as a window must be contained
whole, the first shingle of that order, the rarest, is its necessary prefix, and only documents with that shingle
are candidates. A candidate's window start follows from the shingle's place in the window (positional bound) and
must leave room for the whole window within the text (length bound); then the words are compared one by one.

The side that is held by every task is the index of benchmark items. Its size is checked: items are dealt into
blocks of about ``block_bytes`` of text (an index takes some ten bytes for each, 40 MB at the
default, and its words up to thrice that in a worker), and each block is matched in a pass of its own; documents are never
shuffled for a single block, and only the hits are for several.

Defined results: a null text or item has no words; items without words have no windows; equal items are matched
once and all their ids are reported; a null item_id is reported as the empty string; repeated documents each get
their row; empty tables give no rows, and an empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import raw_texts, slices

_SCHEMA = "doc_id long, text_key long, n_words long, spans array<struct<begin:long,end:long>>, items array<string>"
#: A-Z become a-z; bytes that are neither letters, digits nor part of a longer character become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text: runs of ASCII letters, digits and all characters beyond ASCII, in lower case."""
    return text.translate(_FOLD).split()


def _keys(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Keys of the shingles of ``width`` words that start at ``at``; equal shingles have equal keys."""
    key = np.full(len(at), width, np.uint64)
    for k in range(width):
        key = (key ^ (ids[at + k].astype(np.uint64) + np.uint64(1))) * _MIX
        key ^= key >> np.uint64(29)
    return key


class Index:
    """The windows of a block of items, and where their shingles lie."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int) -> None:
        by_words: dict[tuple[bytes, ...], list[str]] = {}
        for item_id, text in items:
            if words := tuple(words_of(text)):
                by_words.setdefault(words, []).append(item_id)
        self.names = [sorted(v) for v in by_words.values()]
        self.vocabulary: dict[bytes, int] = {}
        give = self.vocabulary.setdefault
        lists = [np.array([give(w, len(self.vocabulary)) for w in words], np.int64) for words in by_words]
        self.flat = np.concatenate([*lists, np.zeros(0, np.int64)])
        sizes = np.array([len(x) for x in lists], np.int64)
        starts = np.cumsum(sizes) - sizes
        n_windows = np.maximum(sizes - window + 1, 1) if len(sizes) else sizes
        self.item = np.repeat(np.arange(len(lists), dtype=np.int32), n_windows)
        self.at = np.repeat(starts - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(n_windows.sum())
        self.length = np.repeat(np.minimum(sizes, window), n_windows).astype(np.int32)
        self.width = np.minimum(self.length, shingle)
        self.widths = [int(w) for w in np.unique(self.width)]
        # A shingle that several windows share is kept once: its key depends on its place among all words alone.
        owner = np.repeat(np.arange(len(sizes)), sizes)
        keys = [np.zeros(0, np.uint64)]
        for w in self.widths:
            inside = np.flatnonzero((owner[w - 1 :] == owner[: len(owner) - w + 1]) & (np.minimum(sizes, shingle)[owner[w - 1 :]] == w))
            keys.append(_keys(self.flat, inside, w))
        self.keys = np.unique(np.concatenate(keys))

    def seeker(self) -> Index:
        """What counting shingles in documents needs: words and keys without the windows."""
        out = copy.copy(self)
        out.flat = out.item = out.at = out.length = out.width = None
        return out

    def choose(self, counts: np.ndarray) -> None:
        """Keep of each window only its prefix: the rarest shingle by ``counts`` (ties: the smaller key)."""
        least = np.full(len(self.at), np.iinfo(np.int64).max)
        best, offset = np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), np.int32)
        for w in self.widths:
            own = np.flatnonzero(self.width == w)
            key = _keys(self.flat, np.arange(len(self.flat) - w + 1), w)
            n = counts[np.minimum(np.searchsorted(self.keys, key), len(counts) - 1)]
            for k in range(int(self.length[own].max()) - w + 1):
                fits = own[self.length[own] - w >= k]
                there = self.at[fits] + k
                rarer = (n[there] < least[fits]) | ((n[there] == least[fits]) & (key[there] < best[fits]))
                fits, there = fits[rarer], there[rarer]
                least[fits], best[fits], offset[fits] = n[there], key[there], k
        self.of_window = np.argsort(best, kind="stable")
        self.offset = offset[self.of_window]
        self.keys, self.key_first, self.key_n = np.unique(best[self.of_window], return_index=True, return_counts=True)

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words as numbers (-1: not in the benchmark), and how many each text has."""
        split = [words_of(t) for t in texts]
        find = self.vocabulary.get
        ids = np.array([find(w, -1) for ws in split for w in ws], np.int64)
        return ids, np.array([len(w) for w in split], np.int64)

    def found(self, ids: np.ndarray, n_words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the documents' shingles that the index knows, and the numbers of their keys."""
        owner = np.repeat(np.arange(len(n_words)), n_words)
        for width in self.widths:
            if len(ids) < width:
                continue
            bad = np.r_[0, np.cumsum(ids < 0)]
            n = len(ids) - width + 1
            at = np.flatnonzero((bad[width:] == bad[:n]) & (owner[width - 1 :] == owner[:n]))
            key = _keys(ids, at, width)
            no = np.searchsorted(self.keys, key)
            no[no == len(self.keys)] = 0
            same = self.keys[no] == key
            yield at[same], no[same]

    def matches(self, ids: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of windows: first word, number of words, item."""
        ends = np.cumsum(n_words)
        out = [np.zeros((3, 0), np.int64)]
        for place, no in self.found(ids, n_words):
            n = self.key_n[no]
            entry = np.repeat(self.key_first[no] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            window = self.of_window[entry]
            place = np.repeat(place, n)
            begin = place - self.offset[entry]
            doc = np.searchsorted(ends, place, side="right")
            fits = (begin >= ends[doc] - n_words[doc]) & (begin + self.length[window] <= ends[doc])
            begin, window = begin[fits], window[fits]
            for length in np.unique(self.length[window]):
                own = self.length[window] == length
                b, w = begin[own], window[own]
                step = np.arange(length)
                for cut in range(0, len(b), 1 << 17):
                    bb, ww = b[cut : cut + (1 << 17)], w[cut : cut + (1 << 17)]
                    same = (ids[bb[:, None] + step] == self.flat[self.at[ww][:, None] + step]).all(axis=1)
                    out.append(np.stack([bb[same], np.full(int(same.sum()), length), self.item[ww[same]]]))
        found = np.concatenate(out, axis=1)
        return found[0], found[1], found[2]


def _runs(begin: np.ndarray, length: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of the places covered."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate((begin + length)[order])
    opens = np.r_[True, begin[1:] > end[:-1]]
    closes = np.r_[opens[1:], True]
    return [{"begin": b, "end": e} for b, e in zip(begin[opens].tolist(), end[closes].tolist(), strict=True)]


def _count(docs: DataFrame, index: Index) -> np.ndarray:
    """How often each shingle of ``index`` occurs in all documents."""
    held = docs.sparkSession.sparkContext.broadcast(index.seeker())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        total = np.zeros(len(index.keys), np.int64)
        for batch in slices(batches):
            for _, no in index.found(*index.documents(raw_texts(batch))):
                total += np.bincount(no, minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["no", "n"])

    found = docs.select("text").mapInArrow(count, "no long, n long").groupBy("no").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(index.keys), np.int64)
    counts[found["no"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def _hits(docs: DataFrame, index: Index) -> DataFrame:
    """Every document with its hit spans (word numbers) and the items found in it."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in slices(batches):
            ids, n_words = index.documents(raw_texts(batch))
            begin, length, item = index.matches(ids, n_words)
            ends = np.cumsum(n_words)
            doc = np.searchsorted(ends, begin, side="right")
            spans: list[list] = [[] for _ in n_words]
            items: list[list] = [[] for _ in n_words]
            order = np.argsort(doc, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
                d = int(doc[own[0]])
                spans[d] = _runs(begin[own] - (ends[d] - n_words[d]), length[own])
                items[d] = sorted({x for k in np.unique(item[own]) for x in index.names[k]})
            own = [batch.column(batch.schema.get_field_index(k)).cast(pa.int64()) for k in ("doc_id", "text_key")]
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_words), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text_key", "n_words", "spans", "items"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(match, _SCHEMA)


def _merged(spans):
    """Maximal runs of spans that may overlap or touch."""
    kind = "array<struct<begin:bigint,end:bigint>>"

    def add(out, span):
        last = F.element_at(out, -1)
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        touches = (F.size(out) > 0) & (F.get(out, F.size(out) - 1)["end"] >= span["begin"])
        return F.when(touches, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans (hit words, begin inclusive, end exclusive), items."""
    return _found(docs, benchmark, window, shingle, block_bytes).drop("text_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, without a word inside a benchmark window."""
    hit = _found(docs, benchmark, window, shingle, block_bytes).filter("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit_id"]) & (F.xxhash64(docs["text"]) == hit["hit_key"]), "left_anti")


def _found(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, block_bytes: int) -> DataFrame:
    rows = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n_blocks)))
    hits = []
    for block in range(n_blocks):
        # About block_bytes of items at a time; never more than that of the benchmark is on the driver.
        own = items.filter(F.col("block") == block).select("item_id", "text").collect()
        index = Index([(r["item_id"], bytes(r["text"])) for r in own], window, shingle)
        index.choose(_count(rows, index))
        hits.append(_hits(rows, index))
    out = hits[0]
    if n_blocks > 1:  # equal rows of one document have equal hits, so merging by id and text loses and adds nothing
        key = ["doc_id", "text_key"]
        n_words = out.select(*key, "n_words")
        found = hits[0]
        for more in hits[1:]:
            found = found.unionByName(more)
        found = found.filter(F.size("items") > 0).groupBy(*key).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.text_key").eqNullSafe(F.col("b.text_key"))
        empty = F.array().cast("array<struct<begin:bigint,end:bigint>>")
        out = n_words.alias("a").join(found.alias("b"), same, "left").select(
            "a.doc_id", "a.text_key", "n_words", _merged(F.coalesce("spans", empty)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), "spans", "items")
