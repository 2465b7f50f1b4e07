"""Exact Jaccard similarity join of documents on word shingles, in the metric space of Jaccard distance.

Documents with equal shingle sets are one point (128-bit keys). r is the radius within which points link.

1. *Pivots*: of a bounded sample of the texts, those that have others around them, thinned until they are more than 2r
   apart, are broadcast. Every point gets its exact distance to every pivot with which it shares a shingle.
2. *Voronoi regions*: a point within 2r of a pivot is at home in the region of its nearest one. Points within r of a
   pivot are its core; they are linked with it, and through it with each other, so pairs of them need no look.
3. *Windows*: by the triangle inequality, a point p that links with one at home in a pivot's region lies within 3r of
   the pivot and no more than 2r farther from it than from its own nearest pivot. Such points visit the region.
4. *The rest*: points farther than 2r from every pivot. Among themselves they are mutually at distances near 1, where
   windows of 2r would copy everything everywhere; they are the region of one more pivot, the empty set.
5. *Recursion*: two points of a region that link, and aren't both of its core, differ from its pivot in a common
   shingle (else the pivot lies between them, within r of both). So a region is cut by a necessary prefix of each
   point's differences from its pivot, the rarest first. Small parts are joined directly. Large ones with one pivot are
   one part where that has fewer pairs; they are cut by set size, and if still large get a pivot of their own, and so on. A part that stops shrinking is cut into blocks by a
   hash, and each pair of blocks is joined directly as a part of its own; where such parts of a region have so many points
   in common that all of the region's are fewer pairs, its points are one part.

Rarity is the number of points of the region that have a difference, counted exactly; of the rest, whose differences
from the empty set are their whole sets, over a fixed lower part of the hash range that is wide enough for the
prefixes (shingles above it come last). Chunks of points send each distinct difference once to the range of the hash
space that counts it and get its level (the logarithm of the count) back, so a shingle that a third of all points hold
costs one number a chunk. Differences of one point alone go no further.

What is asked for is components, so after each step points get the label of the component that the links found so far
put them in, and parts or pairs within one component need no look.

Every pair that is brought together passes size, position and bucket-count bounds and is verified on whole shingle sets.

Defined results: a null or empty text, or one without words, has 0 shingles and is a component by itself; repeated
rows are one point, so they share a component; documents with a null doc_id take part and get their component's smallest
doc_id (null if it has none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import discard, files_for, filtered, only, packed, raw_texts, release, sketch, slices, spread, unpacked, word_hashes, written
from gradelake.llm.graph import components

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SIGN = np.uint64(1 << 63)


@dataclass(frozen=True)
class Settings:
    """Points link from a Jaccard similarity of ``percent`` / 100; the other figures only steer the work.

    Of ``sample`` texts (all of a smaller table) of ``pivot_bytes`` at most, up to ``pivots`` become pivots of the first
    regions; ``direct`` is the largest part of a region
    joined without a pivot, ``rounds`` how often large parts get new pivots, as long as that halves the pairs in them
    and a point's part holds more than ``crowd`` points on average; what is left of them is then joined directly, block by
    block of about ``block`` points. ``chunk`` is the number of shingles that a chunk of points holds.
    """

    width: int = 5
    percent: int = 80
    pivots: int = 2048
    sample: int = 16384
    pivot_bytes: int = 8192
    direct: int = 16
    rounds: int = 5
    crowd: int = 64
    block: int = 1024
    chunk: int = 1_000_000

    @property
    def low(self) -> int:
        """Shingles below this are counted: twice the share that a prefix takes, so that the common ones can be left for last."""
        return min((1 << 63) - 1, -(1 << 63) + (2 * (100 - self.percent) << 64) // 100)


def shingle_sets(docs: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    docs = [t.translate(_FOLD) for t in docs]
    data = np.frombuffer(b" ".join(docs) + b" " + bytes(8), np.uint8)
    kind = data[:-8]
    inside = ~((kind == 32) | ((kind >= 9) & (kind <= 13)))
    turn = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    stops = np.cumsum([len(t) + 1 for t in docs])
    upto = np.searchsorted(starts, stops)
    hashes = word_hashes(data, starts, ends)
    key = np.full(max(0, len(hashes) - width + 1), width, np.uint64)
    for k in range(width):
        key = (key ^ hashes[k : k + len(key)]) * _MIX
        key ^= key >> np.uint64(31)
    out, at = [], 0
    for end in upto.tolist():
        n = end - at
        if n >= width:
            out.append(np.unique(key[at : end - width + 1].view(np.int64)))
        elif n:
            short = int.from_bytes(hashlib.blake2b(hashes[at:end].tobytes(), digest_size=8).digest(), "little", signed=True)
            out.append(np.array([short], np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at = end
    return out


def key_of(tokens: np.ndarray) -> bytes:
    """The point's key: a 128-bit hash of its whole set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _within(tokens: np.ndarray, others: np.ndarray) -> np.ndarray:
    if not len(others):
        return np.zeros(len(tokens), bool)
    at = np.searchsorted(others, tokens)
    at[at == len(others)] = 0
    return others[at] == tokens


def buckets(tokens: np.ndarray) -> np.ndarray:
    """How many shingles begin with which bits. Counts of two sets differ in sum by no more than the sets do."""
    bits = int(np.clip(np.ceil(np.log2(max(1, len(tokens)) / 1.5)), 5, 12))
    return np.bincount((tokens.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).clip(max=255).astype(np.uint8)


def outline(tokens: np.ndarray) -> np.ndarray:
    """Counts as in ``buckets``, always 64 of them."""
    return np.bincount((tokens.view(np.uint64) >> np.uint64(58)).astype(np.int64), minlength=64).clip(max=1 << 14).astype(np.int16)


class Pivots:
    """Sampled sets more than 2r apart, and an index from shingles to the pivots that hold them."""

    def __init__(self, sets: list[np.ndarray], s: Settings) -> None:
        self.percent = s.percent
        self._index(sets)
        self._index([sets[k] for k in self.apart()[0]])
        self.keys = [key_of(t) for t in self.sets]

    def apart(self) -> tuple[list[int], list[int]]:
        """Sets more than 2r apart, the first of those that lie close together, and how many others lie around each."""
        q, stay, around, near = 100 - self.percent, [], [], np.zeros(len(self.sets), bool)
        for k, own in enumerate(self.sets):
            if near[k] or not len(own):
                continue
            _, other, both = self.common([own])
            close = other[100 * both >= (100 - 2 * q) * (len(own) + self.sizes[other] - both)]
            stay.append(k)
            around.append(int((~near[close]).sum()) - 1)
            near[close] = True
        return stay, around

    def _index(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.sizes = np.array([len(t) for t in sets], np.int64)
        token = np.concatenate([*sets, np.zeros(0, np.int64)])
        order = np.argsort(token, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order].astype(np.int32)
        self.tokens, self.starts, self.counts = np.unique(token[order], return_index=True, return_counts=True)

    def common(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair of a set and a pivot that have something in common: set, pivot, number of common shingles."""
        none = np.zeros(0, np.int64)
        token = np.concatenate([*docs, none])
        if not len(token) or not len(self.tokens):
            return none, none, none
        at = np.searchsorted(self.tokens, token)
        at[at == len(self.tokens)] = 0
        hit = np.flatnonzero(self.tokens[at] == token)
        at = at[hit]
        doc = np.repeat(np.arange(len(docs)), [len(t) for t in docs])[hit]
        pairs = np.repeat(doc, self.counts[at]) * len(self.sets) + spread(self.owners, self.counts, at, self.starts)
        pairs, both = np.unique(pairs, return_counts=True)
        return pairs // len(self.sets), pairs % len(self.sets), both

    def regions(self, docs: list[np.ndarray]) -> tuple[np.ndarray, dict[int, list[dict]]]:
        """Which sets are at home in a pivot's region, and for each set the regions that it lives in or visits."""
        q = 100 - self.percent
        doc, pivot, both = self.common(docs)
        sizes = np.array([len(t) for t in docs], np.int64)
        union = sizes[doc] + self.sizes[pivot] - both
        some = 100 * both >= (100 - 3 * q) * union
        doc, pivot, both, union = doc[some], pivot[some], both[some], union[some]
        home, out = np.zeros(len(docs), bool), {}
        for d in np.unique(doc).tolist():
            own = np.arange(*np.searchsorted(doc, [d, d + 1]))
            like = both[own] / union[own]
            first = own[np.lexsort((pivot[own], -like))[0]]
            home[d] = 100 * both[first] >= (100 - 2 * q) * union[first]
            window = own[like >= like.max() - 2 * q / 100 - 1e-9]
            out[d] = [{"pivot": int(pivot[k]), "lives": bool(home[d] and k == first), **differences(docs[d], self.sets[pivot[k]], self.percent)} for k in window.tolist()]
        return home, out


def differences(u: np.ndarray, v: np.ndarray, percent: int) -> dict:
    """Whether set u is of the ``core`` around pivot v, which shingles only one of them has, and how many of these
    (``take``) are a necessary prefix in whatever order is the same for all sets.

    A point beyond the core shares at least ``apart - most`` of its differences with a point that it links with, a core
    point more than percent / (100 + percent) of its own with a point beyond the core.
    """
    p, q = percent, 100 - percent
    shared = _within(u, v)
    both, n = int(shared.sum()), len(u)
    apart, union = n + len(v) - 2 * both, n + len(v) - both
    core = 100 * both >= p * union
    least = max(1, p * apart // (100 + p) if core else apart - int(q * (n + n * 100 / p) / (100 + p)))
    return {"core": core, "apart": apart, "take": apart - least + 1, "tokens": np.concatenate([u[~shared], v[~_within(v, u)]])}


def sampled_pivots(docs: DataFrame, n_docs: int, s: Settings) -> Pivots:
    """At most ``settings.pivots`` texts that have others within 2r in a bounded sample chosen by hash, the largest groups first.

    One task looks the sample over by an eighth of its shingles; the few texts that come back are the pivots.
    """
    rate = min(1.0, s.sample / max(1, n_docs))
    draw = F.xxhash64("text", F.lit(31))
    some = docs.filter((F.octet_length("text") <= s.pivot_bytes) & (F.pmod(draw, F.lit(1 << 30)) < int(rate * (1 << 30))))
    some = some.groupBy(draw.alias("draw")).agg(F.first("text").alias("text"))

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("draw").slice(0, 2 * s.sample)
        texts, parts = table.column("text").cast(pa.binary()).to_pylist(), []
        for k in range(0, len(texts), 512):
            parts += [t[(t & 7) == 0].copy() for t in shingle_sets(texts[k : k + 512], s.width)]
        index = Pivots.__new__(Pivots)
        index.percent = s.percent
        index._index(parts)
        stay, around = index.apart()
        best = sorted(((n, k) for k, n in zip(stay, around, strict=True) if n > 0), key=lambda x: (-x[0], x[1]))[: s.pivots]
        return pa.table({"text": pa.array([texts[k] for _, k in best], pa.binary()).cast(pa.string())})

    found = some.groupBy(F.lit(1).alias("one")).applyInArrow(choose, "text string").collect()
    return Pivots(shingle_sets([r["text"].encode() for r in found], s.width), s)


class Chunk:
    """The differences of some points of a task: sent once each, and where each point's are among them.

    An entry is a point in a region: origin 0 is the rest, k + 1 the region of pivot k.
    """

    def __init__(self, s: Settings, n_ranges: int) -> None:
        self.span = s.low + (1 << 63)
        self.bounds = np.array([self.span * k // n_ranges for k in range(1, n_ranges)], np.uint64)
        self.seen: set[bytes] = set()
        self.keys: list[bytes] = []
        self.facts: list[tuple[int, int, int, int, int, int]] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, key: bytes, n: int, origin: int, own: bool, apart: int, take: int, tokens: np.ndarray) -> None:
        """Add a point's differences; those from a pivot get hashes of their own, within the counted part of the range."""
        if origin:
            mixed = (tokens.view(np.uint64) ^ np.uint64(origin * 0x9E3779B97F4A7C15 % (1 << 64))) * _MIX
            tokens = np.sort(((mixed ^ (mixed >> np.uint64(31))) * _MIX % np.uint64(self.span) ^ _SIGN).view(np.int64))
        self.keys.append(key)
        self.facts.append((n, origin, int(own), apart, take, len(tokens)))
        self.tokens.append(tokens)
        self.size += len(tokens)

    def rows(self) -> list[dict]:
        """One row for each range that has differences, and one that says which points have them."""
        name = int.from_bytes(os.urandom(8), "little", signed=True)
        token, place, n = np.unique(np.concatenate(self.tokens), return_inverse=True, return_counts=True)
        token = token.view(np.uint64) ^ _SIGN
        cuts = np.r_[0, np.searchsorted(token, self.bounds), len(token)].tolist()
        n = n.clip(max=255).astype(np.uint8)
        out = [{"kind": 1, "chunk": name, "range": k, "a": packed(token[a:b]), "b": n[a:b].tobytes()} for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        facts = np.array(self.facts, np.uint32)
        return [*out, {"kind": 2, "chunk": name, "a": b"".join(self.keys), "b": facts.tobytes(), "c": place.astype(np.uint32).tobytes()}]


_SCANNED = pa.schema(
    [("kind", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("n_low", pa.int64()), ("cores", pa.list_(pa.int32()))]
    + [("extra", pa.list_(pa.int64())), ("buckets", pa.binary()), ("chunk", pa.int64()), ("range", pa.int32()), *((c, pa.binary()) for c in "abc")]
)
_SCANNED_SQL = (
    "kind int, doc_id long, text_key long, key binary, n long, n_low long, cores array<int>, extra array<long>, buckets binary, chunk long, range int, a binary, b binary, c binary"
)


def _scan(docs: DataFrame, held, n_ranges: int, s: Settings) -> DataFrame:
    """Kind 0: each document's point and the cores it is in. Kinds 1 and 2: the points' differences, by chunks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("regions")
        pivots, chunk = held.value, Chunk(s, n_ranges)
        for batch in slices(batches):
            sets = shingle_sets(raw_texts(batch), s.width)
            home, near = pivots.regions(sets)
            ids, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text_key"))
            rows = []
            for k, tokens in enumerate(sets):
                n, key, regions = len(tokens), key_of(tokens), near.get(k, [])
                row = {"kind": 0, "doc_id": ids[k], "text_key": texts[k], "key": key, "n": n, "n_low": 0, "buckets": buckets(tokens).tobytes()}
                row["cores"] = [r["pivot"] for r in regions if r["core"]]
                fresh = key not in chunk.seen
                chunk.seen.add(key)
                if n and not home[k]:
                    row["n_low"] = n_low = int(np.searchsorted(tokens, s.low))
                    take = n - -(-s.percent * n // 100) + 1
                    row["extra"] = tokens[n_low : max(n_low, take)].tolist()
                    if n_low and fresh:
                        chunk.add(key, n, 0, True, n, take, tokens[:n_low])
                for r in regions if fresh else []:
                    if r["apart"]:
                        chunk.add(key, n, r["pivot"] + 1, r["lives"], r["apart"], r["take"], r["tokens"])
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, _SCANNED)
            if chunk.size >= s.chunk:
                for row in chunk.rows():
                    yield pa.RecordBatch.from_pylist([row], _SCANNED)
                chunk = Chunk(s, n_ranges)
        if chunk.size:
            for row in chunk.rows():
                yield pa.RecordBatch.from_pylist([row], _SCANNED)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return docs.mapInArrow(work, _SCANNED_SQL)


def levels(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The logarithm, rounded down, of each token's summed counts."""
    order = np.argsort(tokens, kind="stable")
    new = np.r_[True, tokens[order][1:] != tokens[order][:-1]][: len(order)]
    total = np.add.reduceat(counts[order], np.flatnonzero(new)) if len(order) else counts
    out = np.zeros(len(order), np.uint8)
    out[order] = np.floor(np.log2(total)).astype(np.uint8)[np.cumsum(new) - 1]
    return out


def _entries(scanned: DataFrame, s: Settings) -> DataFrame:
    """A row for each difference of a point's prefix in each of its regions, rarest first, that other points may have."""

    def count(table: pa.Table) -> pa.Table:
        tokens = [unpacked(x) for x in table.column("a").to_pylist()]
        cuts = np.cumsum([len(t) for t in tokens])[:-1]
        tokens = np.concatenate(tokens)
        level = levels(tokens, np.frombuffer(b"".join(table.column("b").to_pylist()), np.uint8).astype(np.int64))
        shared = [(t[v > 0] ^ _SIGN).tobytes() for t, v in zip(np.split(tokens, cuts), np.split(level, cuts), strict=True)]
        columns = [table.column("chunk"), table.column("range"), pa.array([v.tobytes() for v in np.split(level, cuts)], pa.binary()), pa.array(shared, pa.binary())]
        release()
        return pa.table(columns, names=["chunk", "range", "levels", "tokens"])

    counted = scanned.filter("kind = 1").select("chunk", "range", "a", "b").groupBy("range").applyInArrow(count, "chunk long, range int, levels binary, tokens binary")

    def arrange(points: pa.Table, counted: pa.Table) -> pa.Table:
        counted = counted.sort_by("range")
        level = np.frombuffer(b"".join(counted.column("levels").to_pylist()), np.uint8)
        token = np.zeros(len(level), np.int64)
        token[level > 0] = np.frombuffer(b"".join(counted.column("tokens").to_pylist()), np.int64)
        keys, facts, place = (points.column(c)[0].as_py() for c in "abc")
        n, origin, own, apart, take, lows = np.frombuffer(facts, np.uint32).astype(np.int64).reshape(-1, 6).T
        place = np.frombuffer(place, np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(n)), lows)
        at = np.flatnonzero(level[place] > 0)
        at = at[np.lexsort((place[at], level[place[at]], owner[at]))]
        many = np.bincount(owner[at], minlength=len(n))
        pos = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lows - many, many)
        who = owner[at]
        ok = pos < take[who]
        who, at = who[ok], at[ok]
        key = pa.Array.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(keys)]).cast(pa.binary()).take(pa.array(who))
        central = np.where(origin > 0, -apart / np.maximum(n, 1), many / np.maximum(lows, 1))[who]  # near the pivot; or with much that is common
        columns = {"token": token[place[at]], "n": n[who], "pos": pos[ok], "central": central, "own": own[who] > 0, "origin": origin[who], "apart": apart[who]}
        release()
        return pa.table({"key": key, **{k: pa.array(v) for k, v in columns.items()}})

    points = scanned.filter("kind = 2").select("chunk", "a", "b", "c")
    shape = "key binary, token long, n long, pos long, central double, own boolean, origin long, apart long"
    within = points.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(arrange, shape)
    beyond = scanned.filter("kind = 0 and size(extra) > 0").select("key", "n", "n_low", F.posexplode("extra").alias("pos", "token"))
    fixed = {"own": F.lit(True), "origin": F.lit(0).cast("long"), "apart": F.col("n"), "central": F.lit(0.0)}
    return within.unionByName(beyond.select("key", "token", "n", (F.col("pos") + F.col("n_low")).alias("pos")).withColumns(fixed))


def _bounded(pairs: DataFrame, points: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose bucket counts leave them a chance to link."""
    p, q = s.percent, 100 - s.percent

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, m, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                u, v = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
                size = min(len(u), len(v))
                apart = int(np.abs(u.reshape(size, -1).sum(axis=1) - v.reshape(size, -1).sum(axis=1)).sum())
                keep.append((100 + p) * apart <= q * (m + n))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    may = filtered(points.select("key", "buckets", "n"), F.xxhash64("key"), sketch(wanted.select(F.xxhash64("key").alias("h")), "h"))[0]
    side = may.join(wanted, "key", "left_semi").dropDuplicates(["key"])
    one = side.select(F.col("key").alias("a"), F.col("buckets").alias("x"), F.col("n").alias("m"))
    two = side.select(F.col("key").alias("b"), F.col("buckets").alias("y"), "n")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", "m", "n").mapInArrow(near, "a binary, b binary")


def _sets(docs: DataFrame, points: DataFrame, keys: DataFrame, s: Settings, files: int) -> DataFrame:
    """The whole shingle sets of the points ``keys``, made again from the texts that a sketch of fixed size lets through."""
    held = sketch(points.join(keys, "key", "left_semi").select("text_key"), "text_key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of this task; emptied when it grows, as copies only cost time
        for batch in slices(batches):
            batch = batch.filter(pa.array(held.value.may_hold(batch.column(1).to_numpy())))
            sets = {key_of(t): t for t in shingle_sets(raw_texts(batch), s.width)} if batch.num_rows else {}
            sets = {k: t.tobytes() for k, t in sets.items() if k not in seen}
            seen.update(sets)
            if len(seen) > 200_000:
                seen.clear()
            counts = [outline(np.frombuffer(t, np.int64)) for t in sets.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.array(list(sets.values()), pa.binary()), pa.array(counts, pa.list_(pa.int16()))], names=["key", "tokens", "outline"])

    made = docs.select("text", F.xxhash64("text").alias("text_key")).mapInArrow(work, "key binary, tokens binary, outline array<smallint>")
    return written(made.join(keys, "key", "left_semi").dropDuplicates(["key"]), "sets", files)


def _linked(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = int(_within(u, v).sum())
                keep.append(100 * both >= s.percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary")


def _about_pivots(stars: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Per point and pivot: whether it is ``core``, the number of its differences and their prefix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [differences(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64), s.percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            sizes = [len(x.as_buffer()) // 8 for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array([f["core"] for f in found], pa.bool_()), pa.array([f["apart"] for f in found], pa.int64())]
            prefix = pa.array([f["tokens"][: f["take"]] for f in found], pa.list_(pa.int64()))  # the point's own come first, as few have them
            yield pa.RecordBatch.from_arrays([*columns, prefix], names=["key", "pivot", "n", "core", "apart", "prefix"])

    one = sets.select("key", F.col("tokens").alias("x"))
    two = sets.select(F.col("key").alias("pivot"), F.col("tokens").alias("y"))
    joined = stars.join(one, "key").join(two, "pivot").select("key", "pivot", "x", "y")
    return joined.mapInArrow(work, "key binary, pivot binary, n long, core boolean, apart long, prefix array<long>")


_MEMBER = ("key", "label", "n", "central", "own", "home", "origin", "apart", "pos")


def _direct_pairs(members: DataFrame, s: Settings) -> DataFrame:
    """Pairs of points of one part (token) that aren't known to be in one component, one at least living in the region
    and one in the size level, whose first common shingle this can be.

    From that shingle on (at ``pos`` of a point's ``apart`` shingles in order), both points must have room for as many
    common ones as a link needs: half of what the two have together, less what the radius allows them to differ by. Where
    the members have outlines, these must leave them a chance too.
    """
    rest = (F.col("apart") - F.col("pos")).alias("rest")
    drawn = ["outline"] if "outline" in members.columns else []
    blocks = ["block", "itself"] if "block" in members.columns else []
    side = lambda k: members.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("key", "label", "n", "own", "home", "apart", *drawn, *blocks)), rest.alias(f"rest_{k}"))
    p, q = s.percent, 100 - s.percent
    look = (F.col("label_a") != F.col("label_b")) & (F.col("home_a") | F.col("home_b")) & (F.col("own_a") | F.col("own_b"))
    room = 2 * (100 + p) * F.least("rest_a", "rest_b") >= (100 + p) * (F.col("apart_a") + F.col("apart_b")) - q * (F.col("n_a") + F.col("n_b"))
    alike = 100 * F.least("n_a", "n_b") >= s.percent * F.greatest("n_a", "n_b")
    look &= (F.col("key_a") < F.col("key_b")) & room & alike
    if "block" in members.columns:  # two of one block meet where it meets itself
        look &= (F.col("block_a") != F.col("block_b")) | F.col("itself_a")
    if drawn:
        differ = F.aggregate(F.zip_with("outline_a", "outline_b", lambda x, y: F.abs(x - y).cast("int")), F.lit(0), lambda n, d: n + d)
        look &= (100 + p) * differ <= q * (F.col("n_a") + F.col("n_b"))
    return side("a").join(side("b"), "token").filter(look).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def _merged(parts: DataFrame, *by: str) -> DataFrame:
    """Parts (with their ``size``) that are equal ``by`` these columns, the region's origin first, become one part of all their points where that holds no more pairs.

    A point has the first of its places and all its rights, so no pair of the parts is passed over.
    """
    points = parts.groupBy(*by, "key").agg(*(F.min(c).alias(c) for c in ("label", "n", "apart", "pos")), *(F.bool_or(c).alias(c) for c in ("own", "home")), F.max("central").alias("central"), F.sum("size").alias("met"))
    merge = points.groupBy(*by).agg(F.count("*").alias("size"), F.sum("met").alias("pairs")).filter(F.col("size") * F.col("size") <= F.col("pairs")).select(*by, "size")
    whole = points.join(merge, [*by]).withColumn("token", F.xxhash64(F.lit("points"), *by))
    apart = parts.join(merge.select(*by), [*by], "left_anti")
    return apart.select("token", *_MEMBER, "size").unionByName(whole.select("token", *_MEMBER, "size"))


def _in_blocks(parts: DataFrame, s: Settings) -> DataFrame:
    """Parts (with their ``size``) cut into blocks of about ``s.block`` points, a part for each pair of blocks of one."""
    n = F.ceil(F.col("size") / s.block).cast("int")
    rows = parts.withColumn("block", F.pmod(F.xxhash64("key"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumn("itself", F.col("block") == F.col("other"))
    return rows.withColumn("token", F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other"))).drop("other")


def _labelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with each key's component by the links found so far."""
    if roots is None:
        return rows.withColumn("label", F.col("key"))
    return rows.drop("label").join(roots.select(F.col("node").alias("key"), F.col("root").alias("label")), "key", "left").withColumn("label", F.coalesce("label", "key"))


def _regions(entries: DataFrame) -> DataFrame:
    """``entries`` (token and the columns of _MEMBER) with their part's size and pivot.

    Parts that hold no pair to look at are left out. Of parts of one region with the same points (equal sums of
    64-bit hashes) the one whose shingle comes first stays: a family's shingles mostly lie in the same documents.
    """
    best = F.struct(F.col("central").alias("share"), F.col("key").alias("key"))
    tokens = entries.groupBy("token").agg(
        F.count("*").alias("size"),
        F.max(best)["key"].alias("pivot"),
        (F.min("label") == F.max("label")).alias("inside"),
        (F.bool_or("home") & F.bool_or("own")).alias("lived"),
        F.first("origin").alias("origin"),
        F.sum("pos").alias("place"),
        F.sum(F.xxhash64("key", "own", "home").cast("decimal(20)")).alias("points"),
    )
    same = ["origin", "points", "size", "pivot"]
    tokens = tokens.filter("size > 1 and lived and not inside").groupBy(*same).agg(F.min_by("token", F.struct("place", "token")).alias("token"))
    return entries.select("token", *_MEMBER).join(tokens.drop("origin", "points"), "token")


def _by_size(large: DataFrame, s: Settings) -> DataFrame:
    """Parts cut by set size: a point is at home at its own level and visits the next, as links reach no further."""
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / s.percent)) * (1 + 1e-9)))
    both = large.withColumn("home", F.explode(F.array(F.lit(True), F.lit(False))))
    return _regions(both.withColumn("token", F.xxhash64("token", level + F.when(F.col("home"), 0).otherwise(1))))


def jaccard_components(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to)."""
    return _placed(docs, settings)[0].select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is their component's smallest, one of each id and component.

    Rows with a null doc_id stay, one of each component that has no other id. Rows without words are components by
    themselves and all stay. Only what goes is shuffled with the texts.
    """
    placed, files = _placed(docs, settings)
    placed = written(placed, "placed", files)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))

    def is_row(of: DataFrame):
        return left["doc_id"].eqNullSafe(of["row_id"]) & F.xxhash64(left["text"]).eqNullSafe(of["row_key"])

    gone = placed.filter(~stays).select(F.col("doc_id").alias("row_id"), F.col("text_key").alias("row_key")).distinct()
    row = F.xxhash64(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))
    here, elsewhere = filtered(docs, row, sketch(gone.select(F.xxhash64("row_id", "row_key").alias("row")), "row"))
    left = here.join(gone, here["doc_id"].eqNullSafe(gone["row_id"]) & F.xxhash64(here["text"]).eqNullSafe(gone["row_key"]), "left_anti").unionByName(elsewhere)
    # Several rows of one id may be kept in different components: only those of the same one are repetitions.
    kept = placed.filter(stays & (F.col("n") > 0))
    twice = kept.groupBy("doc_id", "root").count().filter("count > 1")
    if not twice.limit(1).count():
        return left
    roots = twice.select(F.col("doc_id").alias("twice_id"), F.col("root").alias("twice_root"))
    same = kept["doc_id"].eqNullSafe(roots["twice_id"]) & (kept["root"] == roots["twice_root"])
    again = written(kept.join(roots, same, "left_semi").select(F.col("doc_id").alias("row_id"), F.col("text_key").alias("row_key"), "root").distinct(), "twice", files)
    root = f"root_{uuid.uuid4().hex}"
    again = again.withColumnRenamed("root", root)
    rows = left.join(again, is_row(again)).select(*(left[c] for c in docs.columns), root)
    return left.join(again, is_row(again), "left_anti").unionByName(rows.dropDuplicates(["doc_id", root]).drop(root))


def _placed(docs: DataFrame, s: Settings) -> tuple[DataFrame, int]:
    """doc_id, a hash of the text, set size, component's root (null without words) and component of every document; and how many files a table of them is worth."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    n_docs, n_bytes = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    pivots = sampled_pivots(docs, n_docs, s)
    held = spark.sparkContext.broadcast(pivots)  # at most settings.pivots sets of settings.pivot_bytes bytes of text
    files = files_for(spark, n_bytes or 0)
    scanned = written(_scan(docs, held, int(min(1 << 17, max(8, (n_bytes or 0) >> 24))), s), "scanned")
    held.destroy()
    points = scanned.filter("kind = 0").select("doc_id", "text_key", "key", "n", "buckets")
    entries = written(_entries(scanned, s).dropDuplicates(["token", "key"]).withColumn("home", F.lit(True)), "entries", files)
    near = scanned.filter("kind = 0 and size(cores) > 0").select(F.col("key").alias("a"), F.explode("cores").alias("pivot"))
    core_of = spark.createDataFrame([(k, bytearray(key)) for k, key in enumerate(pivots.keys)], "pivot int, b binary")
    links = written(near.join(F.broadcast(core_of), "pivot").select("a", "b").distinct(), "links", files)
    roots, fresh = components(links, files), []
    is_large = F.col("size") > s.direct
    used, sets = [entries], None

    def known() -> DataFrame:
        """Components by all links so far: what was known before is a tree of each component, so a link is followed once."""
        nonlocal roots, fresh
        if fresh:
            trees = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots, fresh = components(reduce(DataFrame.unionByName, fresh, trees), files), []
        return roots

    def parted(rows: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame] | None:
        """Parts that are joined directly, and large ones, cut by size; None where the large ones hold more than ``most`` before they are cut.

        Large parts of a region that have one pivot mostly have the same points, and are one part.
        """
        regions = written(_regions(_labelled(rows, known())), "regions", files)
        whole = written(_merged(regions.filter(is_large), "origin", "pivot"), "regions-of-points", files)
        used.extend([regions, whole])
        if most is not None and (whole.agg(F.sum("size")).first()[0] or 0) > most:
            return None
        cut = written(_by_size(whole, s), "regions-by-size", files)
        used.append(cut)
        return regions.filter(~is_large).unionByName(cut.filter(~is_large)), cut.filter(is_large)

    def joined(members: DataFrame, also: DataFrame | None = None) -> DataFrame:
        """The links among the members of small parts; the first call gathers the sets that these and ``also`` need."""
        nonlocal sets
        pairs = written(_direct_pairs(members, s).distinct(), "pairs", files)
        pairs_left = written(_bounded(pairs, points, s), "near-pairs", files)
        if sets is None:
            wanted = pairs_left.select(F.col("a").alias("key")).unionByName(pairs_left.select(F.col("b").alias("key"))).unionByName(also.select("key")).distinct()
            sets = _sets(docs, points, wanted, s, files)
        used.extend([pairs, pairs_left])
        return written(_linked(pairs_left, sets, s), "links", files)

    small, large = parted(entries)
    fresh.append(joined(small, large))
    work, rows = large.agg(F.sum("size"), F.count("*")).first()  # twice the pairs in the large parts, their points
    for _ in range(s.rounds):
        if not rows or work <= s.crowd * rows:
            break
        stars = large.filter("key <> pivot").select("key", "pivot").distinct()
        about = written(_about_pivots(stars, sets, s), "about", files)
        used.append(about)
        fresh.append(about.filter("core").select(F.col("key").alias("a"), F.col("pivot").alias("b")))
        differ = about.select("key", F.xxhash64("pivot").alias("origin"), "n", "apart", F.posexplode("prefix").alias("pos", "shingle"))
        differ = differ.withColumns({"token": F.xxhash64("origin", "shingle"), "own": F.lit(True), "home": F.lit(True), "central": -F.col("apart") / F.col("n"), "pos": F.col("pos").cast("long")})
        found = parted(differ, work)
        if found is None:  # new pivots no longer help
            break
        small, larger = found
        left, points_left = larger.agg(F.sum("size"), F.count("*")).first()
        if left and 2 * left > work:  # nor here
            break
        fresh.append(joined(small))
        large, work, rows = larger, left, points_left
    if rows:  # at most settings.crowd points in a part on average, or parts that new pivots don't shrink: pairs of different components only
        parts = _regions(_labelled(large.select("token", *_MEMBER), known()))
        parts = written(parts, "parts", files)
        used.append(parts)
        fresh.append(joined(_in_blocks(_merged(parts, "origin"), s).join(sets.select("key", "outline"), "key")))
    classes = points.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"))
    classes = written(classes.join(known().select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key")), "classes", files)
    smallest = written(classes.groupBy("root").agg(F.min("first").alias("component_id")), "smallest", files)
    placed_classes = written(classes.join(smallest, "root").select("key", "root", "component_id"), "placed-classes", files)
    discard(*used, sets, classes, smallest)
    placed = points.join(placed_classes, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return placed.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("root")).alias("root"), component), files
