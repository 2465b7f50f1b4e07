"""Removal of long byte strings that occur twice or more, by range-partitioned sparse suffixes.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too. Only suffixes that can matter
are sorted:

1. *Anchors*: the position of the smallest 16-byte hash among each ``length // 2 + 1`` neighbouring positions. A
   string of ``length`` bytes holds an anchor and the ``length // 2`` bytes from it on, so a repeated string has a
   repeated anchor suffix.
2. *Candidates*: positions whose first smallest hash is a repeated anchor.

Both kinds are treated alike. A suffix's tokens are its first eight bytes as they are, and 64-bit fingerprints of
the bytes that count: ``length // 2`` for an anchor, ``length`` for a candidate (and 32 bits of another one of its second
half). Suffixes are in the order of their text by the first token, and of fingerprints within it. Splitters sampled as
pairs of tokens range-partition the suffixes, so that a common beginning is dealt over several ranges; each bucket
sorts its suffixes by multikey quicksort (``multikey_order``), and equal neighbours are repeats. Splitters are compared
with both leading tokens, so equal suffixes never lie on both sides of a boundary: comparing a bucket's last suffix
with the next one's first can't find a repeat, and isn't done. Documents are dealt into blocks by a hash of their text;
a block sends each of its distinct suffixes once, so a passage that a third of all documents hold is sent at most once
a block, and gets back a bit for each. Equal texts of one task are recognised before anything is shuffled.

With ``n_words``, that many consecutive words that start elsewhere too are repeats as well, whatever their bytes: the
same two steps run over each text's words, as 64-bit hashes, in place of its bytes. Words end at white space.

Defined results: null and empty texts, and texts shorter than ``length`` (and of fewer than ``n_words`` words), lose nothing; other equal
texts lose all, in each document; matches never cross documents; strings are judged on the input; a null doc_id stays
null; repeated rows each get their row; an empty table gives no rows. Equality of strings is equality of
their first eight bytes and of 96 bits of fingerprints; the other bytes aren't compared.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import files_for, only, raw_texts, release, remembered, shared_dir, slices, word_hashes, written

SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_SPAN_SQL = "array<struct<begin:bigint,end:bigint>>"
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 16
#: An anchor of words is chosen by the hash of so many.
_WORD_GRAM = 4
#: Suffixes that are sorted without parting them first.
_SMALL = 1 << 16
#: Anchors from which splitters are taken.
_SAMPLED = 1 << 15
#: Ranges of suffixes, whose splitters every task has, and buckets of blocks: more input makes them larger, not more of them.
MOST_RANGES, MOST_BUCKETS = 1 << 17, 1 << 16


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


remembered("suffixes", _powers.cache_clear)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)


class Prints:
    """Fingerprints of any run of ``values`` in constant time."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = _powers(1 << int(len(values)).bit_length())
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of the ``length`` values from each start on."""
        return _mixed((self.sums[starts + length] - self.sums[starts]) * self.down[starts])

    def first(self, n: int, length: int) -> np.ndarray:
        """Fingerprints at the starts 0 to n - 1."""
        return _mixed((self.sums[length : n + length] - self.sums[:n]) * self.down[:n])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the smallest of ``width`` keys (32 bits; ties: the first)."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keys)] = (keys << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64)
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Piece:
    """Some texts' possible starts (or a part of a long text's), with their anchors.

    Texts are bytes, or arrays of their words' hashes; places and ``length`` count the one or the other.
    """

    def __init__(self, docs: list, spans: list[tuple[int, int, int]], length: int) -> None:
        self.length, half = length, length // 2
        parts = [docs[d][a : b + length - 1] for d, a, b in spans]
        in_bytes = isinstance(parts[0], bytes)
        if in_bytes:
            self.text = b"".join([*parts, bytes(7)])
            data = _byte_values()[np.frombuffer(self.text, np.uint8)[:-7]]
            self.leads = np.ndarray(len(data), ">u8", self.text, strides=(1,))
        else:
            self.leads = data = np.concatenate(parts)
        gram = _GRAM if in_bytes else _WORD_GRAM
        sizes = np.array([b - a + length - 1 for _, a, b in spans], np.int64)
        first = np.cumsum(sizes) - sizes
        n_starts = sizes - (length - 1)
        self.starts = np.repeat(first - (np.cumsum(n_starts) - n_starts), n_starts) + np.arange(n_starts.sum())
        self.doc = np.repeat([d for d, _, _ in spans], n_starts)
        self.place = self.starts + np.repeat(np.array([a for _, a, _ in spans], np.int64) - first, n_starts)
        self.prints = Prints(data)
        grams = self.prints.first(len(data) - gram + 1, gram) >> np.uint64(32)
        self.anchor_of = sliding_argmin(grams, half + 1)[self.starts]
        flag = np.zeros(len(data) + 1, bool)
        flag[self.anchor_of] = True
        self.anchors = np.flatnonzero(flag)
        self.tokens = [self.leads[self.anchors].astype(np.uint64), self.prints.at(self.anchors, half)]

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Which starts have a repeated anchor."""
        flag = np.zeros(int(self.anchors[-1]) + 1, bool)
        flag[self.anchors[repeated]] = True
        return flag[self.anchor_of]


def pieces(docs: list, length: int) -> Iterator[Piece]:
    """The texts' starts in pieces of bounded size; long texts are cut, with the overlap that whole strings need."""
    spans: list[tuple[int, int, int]] = []
    n = 0
    for d, text in enumerate(docs):
        starts = len(text) - length + 1
        for a in range(0, starts, _PIECE):
            b = min(starts, a + _PIECE)
            if spans and n + b - a > _PIECE:
                yield Piece(docs, spans, length)
                spans, n = [], 0
            spans.append((d, a, b))
            n += b - a + length
    if spans:
        yield Piece(docs, spans, length)


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of suffixes by their tokens, by multikey quicksort.

    A run of suffixes is parted around a sampled median of one token into smaller, equal and larger ones; the equal
    ones go on with the next token. Runs of up to ``_SMALL`` suffixes are sorted outright.
    """
    order = np.arange(len(tokens[0]))
    runs = [(0, len(order), 0)]
    while runs:
        a, b, depth = runs.pop()
        own = order[a:b]
        if b - a < 2 or depth == len(tokens):
            continue
        if b - a <= _SMALL:
            order[a:b] = own[_small_order([t[own] for t in tokens[depth:]])]
            continue
        key = tokens[depth][own]
        pivot = np.partition(key[:: (b - a) // 255], 128)[128]
        less, same, more = own[key < pivot], own[key == pivot], own[key > pivot]
        order[a:b] = np.concatenate([less, same, more])
        runs += [(a, a + len(less), depth), (a + len(less), b - len(more), depth + 1), (b - len(more), b, depth)]
    return order


def _small_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Order by one token, then each run of ties by the next."""
    order = np.argsort(tokens[0], kind="stable")
    for depth in range(1, len(tokens)):
        same = np.ones(len(order), bool)
        for t in tokens[:depth]:
            s = t[order]
            same[1:] &= s[1:] == s[:-1]
        if not len(order) or not same[1:].any():
            break
        same[0] = False
        tied = same.copy()
        tied[:-1] |= same[1:]
        run = np.cumsum(~same)[tied]
        own = order[tied]
        order[tied] = own[np.lexsort((tokens[depth][own], run))]
    return order


def repeats(tokens: list[np.ndarray]) -> np.ndarray:
    """Which suffixes have a neighbour with the same tokens once sorted."""
    order = multikey_order(tokens)
    same = np.ones(max(0, len(order) - 1), bool)
    for t in tokens:
        s = t[order]
        same &= s[1:] == s[:-1]
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _planes(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as the bytes of their differences, most significant bytes first: these are mostly alike."""
    steps = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel()
    return np.cumsum(steps.astype(np.uint64), dtype=np.uint64)


def ranges_of(tokens: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """Where each range begins among sorted suffixes, and where the last one ends; ``splitters`` are ascending pairs of leading tokens.

    A suffix equal to a splitter lies before it.
    """
    n, m = len(tokens[0]), len(splitters)
    lead, print_ = np.r_[tokens[0], splitters[:, 0]], np.r_[tokens[1], splitters[:, 1]]
    order = np.lexsort((np.arange(n + m) >= n, print_, lead))
    before = np.flatnonzero(order >= n) - np.arange(m)
    return np.r_[0, before, n]


class Suffixes:
    """A block's distinct suffixes in order, and where each of its own suffixes is among them."""

    def __init__(self, tokens: list[np.ndarray]) -> None:
        order = multikey_order(tokens)
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = False
            for t in tokens:
                s = t[order]
                new[1:] |= s[1:] != s[:-1]
        number = np.cumsum(new) - 1
        self.number = np.empty(len(order), np.int64)
        self.number[order] = number
        self.tokens = [t[order][new] for t in tokens]
        self.twice = np.bincount(number, minlength=int(new.sum())) > 1

    def rows(self, block: int, splitters: np.ndarray) -> pa.Table:
        """One row for each range of the splitters that has suffixes."""
        cuts = ranges_of(self.tokens, splitters)
        there = np.flatnonzero(np.diff(cuts))
        part = lambda t, kind: [t[cuts[r] : cuts[r + 1]].astype(kind).tobytes() for r in there]
        lead = [_planes(self.tokens[0][cuts[r] : cuts[r + 1]]) for r in there]
        more = part(self.tokens[2], "<u4") if len(self.tokens) > 2 else [b""] * len(there)
        columns = [pa.array(there, pa.int32()), pa.array([block] * len(there), pa.int32()), pa.array(lead, pa.binary()), pa.array(part(self.tokens[1], "<u8"), pa.binary()), pa.array(more, pa.binary())]
        return pa.table(columns, names=["range", "block", "lead", "print", "more"])

    def repeated(self, bits: dict[int, bytes], splitters: np.ndarray) -> np.ndarray:
        """Of each suffix of the block, whether it is repeated in the block or, by the ranges' bits, in another."""
        out = self.twice.copy()
        cuts = ranges_of(self.tokens, splitters)
        for r, data in bits.items():
            n = cuts[r + 1] - cuts[r]
            out[cuts[r] : cuts[r + 1]] |= np.unpackbits(np.frombuffer(data, np.uint8), count=int(n)).astype(bool)
        return out[self.number]


def _judge(suffixes: DataFrame) -> DataFrame:
    """Sort each range's suffixes and give back, for each block, a bit per suffix: repeated in another block or not."""

    def sort(table):
        leads = [_from_planes(x) for x in table.column("lead").to_pylist()]
        sizes = np.array([len(x) for x in leads], np.int64)
        tokens = [np.concatenate(leads), np.frombuffer(b"".join(table.column("print").to_pylist()), "<u8")]
        more = b"".join(table.column("more").to_pylist())
        if more:
            tokens.append(np.frombuffer(more, "<u4"))
        bits = np.split(repeats(tokens), np.cumsum(sizes)[:-1])
        release()
        return pa.table({"block": table.column("block"), "range": table.column("range"), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})

    return suffixes.groupBy("range").applyInArrow(sort, "block int, range int, bits binary")


def _bits_of(table: pa.Table, stage: int) -> dict[int, bytes]:
    rows = zip(table.column("stage").to_pylist(), table.column("range").to_pylist(), table.column("bits").to_pylist(), strict=True)
    return {r: b for s, r, b in rows if s == stage}


def _block_docs(table: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """The block's rows ordered by their hash, the distinct texts, and the text of each row."""
    table = table.sort_by("print")
    prints = table.column("print").to_pylist()
    numbers: dict[bytes, int] = {}
    which = np.array([numbers.setdefault(p, len(numbers)) for p in prints], np.int64)
    first = np.r_[True, which[1:] != which[:-1]] if len(which) else np.zeros(0, bool)
    return table, table.filter(pa.array(first)).column("text").cast(pa.binary()).to_pylist(), which


def _candidate_suffixes(parts: list[Piece], length: int, repeated: np.ndarray) -> tuple[Suffixes, np.ndarray, np.ndarray]:
    """The candidates' suffixes with their texts and places; ``repeated`` says which anchors are."""
    none, half = np.zeros(0, np.int64), length // 2
    doc, place, lead, whole, more, done = [none], [none], [none.astype(np.uint64)], [none.astype(np.uint64)], [none.astype(np.uint32)], 0
    for p in parts:
        ok = p.candidates(repeated[done : done + len(p.anchors)])
        done += len(p.anchors)
        if ok.any():
            starts = p.starts[ok]
            doc.append(p.doc[ok])
            place.append(p.place[ok])
            lead.append(p.leads[starts].astype(np.uint64))
            whole.append(p.prints.at(starts, length))
            more.append((p.prints.at(starts + half, length - half) >> np.uint64(32)).astype(np.uint32))
    return Suffixes([np.concatenate(lead), np.concatenate(whole), np.concatenate(more)]), np.concatenate(doc), np.concatenate(place)


def _anchor_suffixes(parts: list[Piece]) -> Suffixes:
    return Suffixes([np.concatenate([*(p.tokens[k] for p in parts), np.zeros(0, np.uint64)]) for k in (0, 1)])


def words_of(docs: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Each text's words: their hashes, and where they begin and end in the text."""
    sizes = np.array([len(t) + 1 for t in docs], np.int64)
    data = np.frombuffer(b"".join(t + b" " for t in docs) + bytes(8), np.uint8)
    inside = ~((data[:-8] == 32) | ((data[:-8] >= 9) & (data[:-8] <= 13)))
    turn = np.diff(inside.astype(np.int8), prepend=0)
    begins, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    first = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(begins, first[1:])
    parts = [np.split(x, cuts) if docs else [] for x in (word_hashes(data, begins, ends), begins, ends)]
    return parts[0], [x - f for x, f in zip(parts[1], first, strict=True)], [x - f for x, f in zip(parts[2], first, strict=True)]


def _units(docs: list[bytes], in_words: bool) -> list:
    return words_of(docs)[0] if in_words else docs


def spans_of(begins: np.ndarray, ends: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of bytes covered by the strings from ``begins`` (ascending) to ``ends``."""
    reach = np.maximum.accumulate(ends)
    opens = np.r_[True, begins[1:] > reach[:-1]]
    closes = np.r_[opens[1:], True]
    return [{"begin": a, "end": b} for a, b in zip(begins[opens].tolist(), reach[closes].tolist(), strict=True)]


def widened(text: bytes, spans: list[dict[str, int]]) -> list[dict[str, int]]:
    """The spans widened to whole UTF-8 characters, and merged where they meet."""
    out: list[dict[str, int]] = []
    for s in spans:
        begin, end = s["begin"], s["end"]
        while begin > 0 and text[begin] & 0xC0 == 0x80:
            begin -= 1
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        if out and begin <= out[-1]["end"]:
            out[-1]["end"] = end
        else:
            out.append({"begin": begin, "end": end})
    return out


def _kept(text: bytes, spans: list[dict[str, int]]) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["begin"]])
        at = s["end"]
    return b"".join([*out, text[at:]])


def _splitters(docs: DataFrame, length: int, ranges: int, in_words: bool, total: int) -> np.ndarray:
    """Pairs of leading tokens that deal suffixes evenly, from some anchors of a hash-chosen fiftieth of the texts.

    Only the evenness of the ranges depends on them. About ``_SAMPLED`` anchors reach the driver at most, whatever the
    input; more ranges than that are set evenly between two of them.
    """
    every = np.uint64(max(1, total // 50 // 100 // _SAMPLED))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [p.tokens for p in pieces(_units(raw_texts(batch), in_words), length)]
            lead, print_ = (np.concatenate([*(t[k] for t in own), np.zeros(0, np.uint64)]) for k in (0, 1))
            some = print_ % every == 0
            yield pa.RecordBatch.from_arrays([pa.array(lead[some].view(np.int64)), pa.array(print_[some].view(np.int64))], names=["lead", "print"])

    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(50)) == 0).select("text").mapInArrow(work, "lead long, print long")
    found = some.limit(4 * _SAMPLED).toArrow()
    lead, print_ = (found.column(c).to_numpy().view(np.uint64) for c in ("lead", "print"))
    order = np.lexsort((print_, lead))
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    known = np.stack([np.r_[np.uint64(0), lead[order], most], np.r_[np.uint64(0), print_[order], most]], axis=1)
    at = np.arange(1, ranges) / ranges * (len(known) - 1)
    low, share = known[at.astype(np.int64)], at % 1
    gap = known[at.astype(np.int64) + 1] - low
    between = np.stack([low[:, 0] + (gap[:, 0] * share).astype(np.uint64), low[:, 1] + np.where(gap[:, 0] == 0, gap[:, 1] * share, 0).astype(np.uint64)], axis=1)
    return between[np.lexsort((between[:, 1], between[:, 0]))]


def _repeat_bits(docs: DataFrame, blocks: DataFrame, length: int, ranges: int, in_words: bool, total: int) -> tuple[DataFrame, np.ndarray]:
    """For each block and range, which anchors (stage 1; words: 4) and candidates (2; 5) are repeated, and the splitters."""
    splitters, stage = _splitters(docs, length, ranges, in_words, total), 4 if in_words else 1

    def anchors(key, table):
        only("suffixes")
        out = _anchor_suffixes(list(pieces(_units(_block_docs(table)[1], in_words), length))).rows(key[0].as_py(), splitters)
        release()
        return out

    files = files_for(docs.sparkSession, total)
    shape = "range int, block int, lead binary, print binary, more binary"
    narrow = blocks.select("block", "print", "text")
    one = written(_judge(narrow.groupBy("block").applyInArrow(anchors, shape)).withColumn("stage", F.lit(stage)), "anchor-bits", files)

    def windows(key, table, bits):
        only("suffixes")
        parts = list(pieces(_units(_block_docs(table)[1], in_words), length))
        told = _anchor_suffixes(parts).repeated(_bits_of(bits, stage), splitters)
        out = _candidate_suffixes(parts, length, told)[0].rows(key[0].as_py(), splitters)
        release()
        return out

    two = written(_judge(narrow.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(windows, shape)).withColumn("stage", F.lit(stage + 1)), "window-bits", files)
    return one.unionByName(two), splitters


def _repeated_strings(docs: list, length: int, bits: pa.Table, stage: int, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The repeated strings' texts and places."""
    parts = list(pieces(docs, length))
    found, doc, place = _candidate_suffixes(parts, length, _anchor_suffixes(parts).repeated(_bits_of(bits, stage), splitters))
    gone = found.repeated(_bits_of(bits, stage + 1), splitters)
    return doc[gone], place[gone]


def remove_repeats(docs: DataFrame, length: int = 400, carry: tuple[str, ...] = (), whole_characters: bool = False, n_words: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed bytes), kept (the remaining bytes), and ``carry`` columns.

    Strings of ``length`` bytes that occur twice go, and runs of ``n_words`` words where that is given.
    With ``whole_characters``, spans are widened to whole characters, so that what is kept is text again. The result
    reads a bucketed table of its own until ``drop_blocks``.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", *carry)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A block sends a row to each range it has suffixes for, so both follow the bytes, not the number of partitions.
    n_blocks = int(max(64, total >> 21))
    n_ranges = int(min(MOST_RANGES, max(32, total >> 23)))
    n_buckets = int(min(MOST_BUCKETS, max(parts, total >> 24, 1)))
    extra = [f for f in docs.schema.fields if f.name in carry]
    carried = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)

    def counts(text: bytes) -> bool:
        return len(text) >= length or (n_words is not None and len(text) >= 2 * n_words - 1 and len(text.split()) >= n_words)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        n_again = 0
        for batch in slices(batches):
            raw = raw_texts(batch)
            prints = [hashlib.blake2b(t, digest_size=16).digest() if counts(t) else None for t in raw]
            home = [None if p is None else int.from_bytes(p[:8], "little") % n_blocks for p in prints]
            block, own = list(home), batch.column(batch.schema.get_field_index("text")).to_pylist()
            for k, p in enumerate(prints):
                if p is not None and p in seen:
                    n_again += 1
                    block[k], own[k] = -1 - n_again % (1 << 20), None
                seen.add(p)
            columns = [own if n == "text" else batch.column(n) for n in batch.schema.names]
            columns = [pa.array(c, pa.string()) if isinstance(c, list) else c for c in columns]
            columns += [pa.array(prints, pa.binary()), pa.array(block, pa.int32()), pa.array(home, pa.int32()), pa.array([len(t) for t in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "print", "block", "home", "n_bytes"])

    dealt = docs.mapInArrow(deal, f"doc_id long, text string{carried}, print binary, block int, home int, n_bytes long")
    # The first of a task's equal texts goes to its block. The others leave their text behind and are spread over
    # negative blocks: which they are depends on the tasks, so it is written once and never worked out again.
    name = f"repeat_blocks_{uuid.uuid4().hex}"
    rows = dealt.filter("block is not null")
    # The files lie in the shared folder, wherever the warehouse is.
    place = _place(spark, name)
    rows.repartition(n_buckets, "block").write.bucketBy(n_buckets, "block").sortBy("block").option("compression", "zstd").option("path", place).saveAsTable(name)
    again = spark.table(name).filter("block < 0")
    blocks = spark.table(name).filter("block >= 0").drop("home", "n_bytes")
    bits, splitters = _repeat_bits(docs, blocks, length, n_ranges, False, total)
    if n_words is not None:
        more, word_splitters = _repeat_bits(docs, blocks, n_words, n_ranges, True, total // 6)
        bits = bits.unionByName(more)
    # Texts of which a task holds several, told to their blocks: at most one row for each text and task.
    told = again.select(F.col("home").alias("block"), F.lit(0).alias("range"), F.col("print").alias("bits"), F.lit(3).alias("stage")).distinct()
    bits = bits.unionByName(told)

    def cut(key, table, bits):
        table, docs, which = _block_docs(table)
        doc, begin = _repeated_strings(docs, length, bits, 1, splitters)
        end = begin + length
        if n_words is not None:
            hashes, opens, closes = words_of(docs)
            at, place = _repeated_strings(hashes, n_words, bits, 4, word_splitters)
            first = np.cumsum([0, *(len(x) for x in hashes)])[at] + place
            doc, begin = np.r_[doc, at], np.r_[begin, np.concatenate(opens)[first]]
            end = np.r_[end, np.concatenate(closes)[first + n_words - 1]]
        spans: list[list[dict[str, int]]] = [[] for _ in docs]
        order = np.lexsort((begin, doc))
        doc, begin, end = doc[order], begin[order], end[order]
        for d in np.unique(doc).tolist():
            own = slice(*np.searchsorted(doc, [d, d + 1]))
            spans[d] = spans_of(begin[own], end[own])
        told = {b for s, b in zip(bits.column("stage").to_pylist(), bits.column("bits").to_pylist(), strict=True) if s == 3}
        rows_of = np.bincount(which, minlength=len(docs))
        for p, d in zip(table.column("print").to_pylist(), which.tolist(), strict=True):
            if rows_of[d] > 1 or p in told:
                spans[d] = [{"begin": 0, "end": len(docs[d])}]
        if whole_characters:
            spans = [widened(t, s) for t, s in zip(docs, spans, strict=True)]
        kept = [_kept(t, s) for t, s in zip(docs, spans, strict=True)]
        out = {"doc_id": table.column("doc_id"), "n_bytes": pa.array([len(docs[d]) for d in which], pa.int64())}
        out |= {"spans": pa.array([spans[d] for d in which], SPAN), "kept": pa.array([kept[d] for d in which], pa.binary())}
        release()
        return pa.table(out | {c: table.column(c) for c in carry})

    result = f"doc_id long, n_bytes long, spans {_SPAN_SQL}, kept binary{carried}"
    cutted = blocks.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(cut, result)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end"))).cast(_SPAN_SQL)
    none, empty = F.array().cast(_SPAN_SQL), F.lit("").cast("binary")
    copies = again.select("doc_id", "n_bytes", whole.alias("spans"), empty.alias("kept"), *carry)
    short = dealt.filter("block is null").select("doc_id", "n_bytes", none.alias("spans"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"), *carry)
    out = cutted.unionByName(copies).unionByName(short)
    out.blocks_table = name
    return out


def _place(spark: SparkSession, table: str) -> str:
    return f"{shared_dir(spark)}/{table}"


def drop_blocks(result: DataFrame) -> None:
    """Drop the table that a result of ``remove_repeats`` reads, and its files, once the result is stored elsewhere."""
    spark = result.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {result.blocks_table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(_place(spark, result.blocks_table))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
