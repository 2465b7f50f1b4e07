"""Phrase collocation mining: frequent phrases of each language, scored against their parts, inside-longer ones dropped.

A first pass puts the n-grams of every text into count-min sketches, one a task, whose pages are merged by adding up; a
merged cell never holds less than the count of any n-gram in it. All that leaves it is one bit a cell, whether it reached
the least count. A second pass counts exactly those n-grams all of whose cells, and all of whose parts' cells, reached it:
words and phrases as they are, summed in the task, then by (language, phrase). So nothing frequent is lost, whatever the
sketch holds; a sketch that the input has filled lets more through, and the second pass then sums more.

Bounds: a sketch has ROWS x CELLS counters of one byte (they stop at the least count), 64 MiB in a task of the first pass and
8 MiB of bits in a broadcast, at any size of the input. Texts are read in pieces of about SLICE_BYTES bytes; a longer
text is cut where a phrase can't go on, and if there is no such place at a space, with the words before it as context. A
page of the sketch is merged as a stream, a common phrase is summed in each task before it is shuffled, phrases are summed
one of BUCKETS shares at a time, and the best of a language are chosen in parts before they are ranked.

Defined results: a null text is empty; a null language is ``und``, one with a language of that name; an empty table gives an
empty result; equal rows count as often as they stand there. Scores are whole numbers, worked out in 38 digits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.common import only, release, spread, word_hashes, written

ROWS, CELLS, PAGE = 2, 1 << 25, 1 << 16
SLICE_BYTES = 4 << 20
#: Distinct phrases that a task keeps before it hands them on.
HELD_PHRASES = 1 << 19
#: Shares of the phrases; one share at a time is summed in a task.
BUCKETS = 2048
UNKNOWN = "und"
_END, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_END[list(b".,;:!?\n\x0b\x0c\r")] = True
_SPACE[list(b" \t")] = True
_ENDS = [bytes([x]) for x in b".,;:!?\n\x0b\x0c\r"]
_AT_END, _AT_SPACE = re.compile(rb"[.,;:!?\n\x0b\x0c\r]"), re.compile(rb"[ \t]")


@dataclass(frozen=True)
class Settings:
    """Phrases of 2 to ``longest`` words with ``least`` occurrences; ``inside`` per cent of them in a longer one drop it."""

    longest: int = 4
    least: int = 30
    inside: int = 80
    scale: int = 2_000_000


@dataclass
class Words:
    """The words of a slice: distinct ones, and for each occurrence its number, piece, language and whether it is context."""

    distinct: pa.Array
    number: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    fresh: np.ndarray

    def valid(self, size: int) -> np.ndarray:
        """Where an n-gram of ``size`` words starts that lies in one piece and doesn't end among the context."""
        last = len(self.number) - size + 1
        return np.flatnonzero((self.piece[:last] == self.piece[size - 1 :]) & self.fresh[size - 1 :]) if last > 0 else np.zeros(0, np.int64)


def pieces(batches: Iterator[pa.RecordBatch], context: int) -> Iterator[tuple[list[str], list[bytes], list[int]]]:
    """Lists of (language, text, bytes of context at its start) of about SLICE_BYTES; longer texts are cut."""
    langs, held, before, n = [], [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            at, own, text = 0, 0, text or b""
            while at < len(text):
                end, kept = at + SLICE_BYTES, 0
                if end >= len(text):
                    end = len(text)
                elif found := _AT_END.search(text, end, end + SLICE_BYTES):
                    end = found.end()
                elif found := _AT_SPACE.search(text, end):
                    end = found.end()
                    begin = 1 + max(at - own - 1, *(text.rfind(x, at - own, end) for x in _ENDS))
                    rest = text[begin:end].rsplit(None, context)
                    kept = end - begin - (len(rest[0]) if len(rest) > context else 0) if context else 0
                else:
                    end = len(text)
                langs.append(UNKNOWN if lang is None else lang)
                held.append(text[at - own : end])
                before.append(own)
                n, at, own = n + end - at, end, kept
                if n >= SLICE_BYTES:
                    yield langs, held, before
                    langs, held, before, n = [], [], [], 0
    if held:
        yield langs, held, before


def words_of(langs: list[str], held: list[bytes], before: list[int], known: dict[str, int]) -> tuple[Words, np.ndarray]:
    """The words of pieces of text, and a hash of each distinct one; ``known`` gives each language a number."""
    data = np.frombuffer(b"\n".join(held).lower() + b"\n" + bytes(8), np.uint8)
    size = len(data) - 8
    ends = _END[data[:size]]
    inside = np.zeros(size + 2, np.int8)
    inside[1:-1] = ~(ends | _SPACE[data[:size]])
    edge = np.diff(inside)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.cumsum([0] + [len(x) + 1 for x in held])
    text = np.searchsorted(first, starts, side="right") - 1
    lengths = stops - starts
    letters = spread(data, lengths, np.arange(len(lengths)), starts)
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    spelt = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))).dictionary_encode()
    number = spelt.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lang = np.array([known.setdefault(x, len(known)) for x in langs], np.int64)[text] if len(text) else np.zeros(0, np.int64)
    fresh = starts - first[text] >= np.array(before, np.int64)[text] if len(text) else np.zeros(0, bool)
    piece = np.cumsum(ends)[starts] if len(text) else np.zeros(0, np.int64)
    at = np.zeros(len(spelt.dictionary), np.int64)
    at[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return Words(spelt.dictionary, number, piece, lang, fresh), word_hashes(data, starts[at], stops[at])


def gram_hashes(words: Words, hashes: np.ndarray, known: dict[str, int], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size from 1: where n-grams of that size start, and a 64-bit hash of each with its language."""
    own = hashes[words.number]
    names = [f".{x}" for x in known]
    data = np.frombuffer("\n".join(names).encode() + bytes(8), np.uint8)
    ends = np.cumsum([len(x.encode()) + 1 for x in names]) - 1
    by_lang = word_hashes(data, np.r_[0, ends[:-1] + 1], ends) if names else np.zeros(0, np.uint64)
    so_far = by_lang[words.lang]
    for size in range(1, longest + 1):
        last = max(0, len(own) - size + 1)
        so_far = (so_far[:last] ^ own[size - 1 :][:last]) * np.uint64(0xFF51AFD7ED558CCD)
        so_far ^= so_far >> np.uint64(32)
        so_far = so_far * np.uint64(0xC4CEB9FE1A85EC53)
        so_far ^= so_far >> np.uint64(29)
        at = words.valid(size)
        yield at, so_far[at]


def cells(hashes: np.ndarray, row: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    return ((hashes >> np.uint64(32 * row)) & np.uint64(CELLS - 1)).astype(np.uint32)


def sketched(docs: DataFrame, settings: Settings) -> DataFrame:
    """(page, counters): the pages of every task's sketch that aren't empty, compressed."""
    longest, least = settings.longest, settings.least

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("phrases")
        counters, known = np.zeros((ROWS, CELLS), np.uint8), {}
        for langs, held, before in pieces(batches, longest - 1):
            words, hashes = words_of(langs, held, before, known)
            grams = np.concatenate([h for _, h in gram_hashes(words, hashes, known, longest)])
            for row in range(ROWS):
                at = np.sort(cells(grams, row))
                new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
                n = np.diff(np.r_[new, len(at)])
                counters[row, at[new]] = np.minimum(counters[row, at[new]] + n, least)
        pack = zstandard.ZstdCompressor(level=1)
        pages = counters.reshape(-1, PAGE)
        for k in np.flatnonzero(pages.any(axis=1)).tolist():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([pack.compress(pages[k].tobytes())], pa.binary())], names=["page", "counters"])
        release()

    if not 0 < least < 256:
        raise ValueError("the least count must be from 1 to 255: a counter is one byte")
    return docs.select("lang", "text").mapInArrow(work, "page int, counters binary")


def merged(pages: DataFrame, least: int) -> dict[int, bytes]:
    """By page, one bit a cell: whether the tasks' counters add up to ``least``. Pages are merged as they come."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for page, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(unpack.decompress(data), np.uint8)
                held = total.get(page)
                total[page] = more if held is None else np.minimum(held.astype(np.uint16) + more, least).astype(np.uint8)
        for page, held in total.items():
            if (reached := held >= least).any():
                yield pa.record_batch([pa.array([page], pa.int32()), pa.array([np.packbits(reached).tobytes()], pa.binary())], names=["page", "bits"])
        release()

    return {r.page: bytes(r.bits) for r in pages.repartition("page").mapInArrow(work, "page int, bits binary").toLocalIterator()}


def survivors(docs: DataFrame, reached: dict[int, bytes], settings: Settings, least: int = 1) -> DataFrame:
    """(lang, phrase, f) of the n-grams whose cells all reached the least count; the empty phrase counts all words.

    A task sums what it has read and hands it on in blocks, a block for each of BUCKETS shares of the phrases; a share is
    then summed on its own, blocks of one share after another, and what has ``least`` occurrences goes on.
    """
    sent, longest = docs.sparkSession.sparkContext.broadcast(reached), settings.longest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("phrases")
        bits, known, held, n = np.zeros((ROWS * CELLS // PAGE, PAGE // 8), np.uint8), {}, [], 0
        for page, data in sent.value.items():
            bits[page] = np.frombuffer(data, np.uint8)
        bits = bits.reshape(ROWS, -1)

        def summed() -> pa.Table:
            return _summed(pa.concat_tables(held), ["share", "lang", "phrase"])

        def handed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.sort_by("share")
            share = table.column("share").to_numpy()
            names = pa.array(list(known), pa.string()).take(table.column("lang").combine_chunks())
            rows = pa.table({"lang": names, "phrase": table.column("phrase"), "f": table.column("f")})
            edges = [*np.flatnonzero(np.r_[True, share[1:] != share[:-1]]).tolist(), len(share)]
            for part in range(0, len(edges) - 1, 64):
                own = edges[part : part + 65]
                blocks = [_packed(rows.slice(a, z - a)) for a, z in pairwise(own)]
                yield pa.record_batch([pa.array(share[own[:-1]], pa.int32()), pa.array(blocks, pa.binary())], names=["share", "block"])

        for langs, texts, before in pieces(batches, longest - 1):
            words, hashes = words_of(langs, texts, before, known)
            found = exact(words, list(gram_hashes(words, hashes, known, longest)), bits)
            held.append(found)
            n += found.num_rows
            if n >= 2 * HELD_PHRASES:
                held = [summed()]
                n = held[0].num_rows
                if n >= HELD_PHRASES:
                    yield from handed(held[0])
                    held, n = [], 0
        if held:
            yield from handed(summed())
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, n = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                total = _summed(pa.concat_tables(held), ["lang", "phrase"])
                yield from total.filter((pc.field("f") >= least) | (pc.field("phrase") == "")).to_batches(1 << 16)

        for batch in batches:
            for share, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if share != own:
                    yield from done()
                    own, held, n = share, [], 0
                held.append(pa.ipc.open_stream(block).read_all())
                n += held[-1].num_rows
                if n >= 2 * max(HELD_PHRASES, held[0].num_rows):
                    held = [_summed(pa.concat_tables(held), ["lang", "phrase"])]
                    n = held[0].num_rows
        yield from done()
        release()

    blocks = docs.select("lang", "text").mapInArrow(work, "share int, block binary")
    return blocks.repartition("share").sortWithinPartitions("share").mapInArrow(merge, "lang string, phrase string, f long")


def _summed(table: pa.Table, keys: list[str]) -> pa.Table:
    return table.combine_chunks().group_by(keys).aggregate([("f", "sum")]).rename_columns([*keys, "f"])


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def exact(words: Words, grams: list[tuple[np.ndarray, np.ndarray]], bits: np.ndarray) -> pa.Table:
    """(share, lang, phrase, f) of a slice's n-grams that may be frequent. They are told apart by their words, not by hashes."""
    total = len(words.number)
    n_words = np.bincount(words.lang[words.fresh])
    there = np.flatnonzero(n_words)
    out = [pa.table({"share": np.zeros(len(there), np.int64), "lang": there, "phrase": pa.array([""] * len(there), pa.string()), "f": n_words[there]})]
    code, may = words.lang, np.ones(total + 1, bool)
    for size, (at, hashes) in enumerate(grams, 1):
        # Both parts one word shorter must be frequent too.
        likely = np.flatnonzero(may[at] & may[at + 1]) if size > 1 else np.arange(len(at))
        for row in range(ROWS):
            cell = cells(hashes[likely], row)
            likely = likely[(bits[row, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)]
        at, hashes = at[likely], hashes[likely]
        key = code[at] * (len(words.distinct) + 1) + words.number[at + size - 1]
        _, first, number, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        parts = [words.distinct.take(pa.array(words.number[at[first] + k])) for k in range(size)]
        phrase = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
        share = (hashes[first] >> np.uint64(40)).astype(np.int64) % BUCKETS
        out.append(pa.table({"share": share, "lang": words.lang[at[first]], "phrase": phrase, "f": n}))
        # Context words have no n-gram of their own here; what starts among them has been judged before its last word came.
        may = np.zeros(total + 1, bool)
        may[at] = True
        code = np.zeros(total, np.int64)
        code[at] = number
        if size < len(grams):
            may, code = _with_context(words, may, code, size)
    return pa.concat_tables(out)


def _with_context(words: Words, may: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Let n-grams that end among the context through, each with a code of its own words: they may go on in fresh words."""
    last = len(words.number) - size + 1
    if last <= 0 or words.fresh.all():
        return may, code
    at = np.flatnonzero((words.piece[:last] == words.piece[size - 1 :]) & ~words.fresh[size - 1 :])
    codes: dict[tuple, int] = {}
    top = int(code.max(initial=0)) + 1
    for k in at.tolist():
        own = (int(words.lang[k]), *words.number[k : k + size].tolist())
        code[k] = top + codes.setdefault(own, len(codes))
        may[k] = True
    return may, code


def counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """(lang, phrase, f): exact numbers of all n-grams with ``least`` occurrences, and of all words under the empty phrase."""
    reached = merged(sketched(docs, settings), settings.least)
    return survivors(docs, reached, settings, settings.least)


def scored(found: DataFrame, settings: Settings) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the phrases in ``found``, by their lowest-scoring cut."""
    phrases = found.withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 1)
    cuts = range(1, settings.longest)
    sides = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.array_join(part, " ").alias("part")) for k in cuts for side, part in (("l", F.slice("words", 1, k)), ("r", F.slice("words", k + 1, settings.longest)))]
    wanted = phrases.select("lang", "phrase", F.size("words").alias("size"), F.col("f").alias("a"), F.explode(F.array(*sides)).alias("cut")).filter("cut.k < size")
    wanted = wanted.select("lang", "phrase", "size", "a", "cut.*")
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("n_part"))
    seen = {f"{side}{k}": F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("n_part"))) for k in cuts for side in "lr"}
    every = wanted.join(parts, ["lang", "part"]).groupBy("lang", "phrase", "size", "a").agg(*(x.alias(c) for c, x in seen.items()))

    def cut(k: int):
        score = F.expr(f"cast({settings.scale} as decimal(18,0)) * cast(a as decimal(19,0)) div (cast(l{k} as decimal(19,0)) + cast(r{k} as decimal(19,0)))")
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    lowest = F.array_min(F.array_compact(F.array(*(cut(k) for k in cuts))))
    return every.withColumn("cut", lowest).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def outermost(phrases: DataFrame, settings: Settings) -> DataFrame:
    """``phrases`` without those that stand inside a longer one ``inside`` per cent of the time or more."""
    words = F.split("phrase", " ")
    spans = [(at, n) for n in range(2, settings.longest) for at in range(1, settings.longest - n + 2)]
    subs = [F.struct(F.lit(at + n - 1).alias("last"), F.lit(n).alias("n"), F.array_join(F.slice(words, at, n), " ").alias("part")) for at, n in spans]
    if not subs:
        return phrases
    inner = phrases.select("lang", F.col("a").alias("longer"), "size", F.explode(F.array(*subs)).alias("sub")).filter("sub.last <= size and sub.n < size")
    most = inner.groupBy(F.col("lang").alias("of_lang"), F.col("sub.part").alias("part")).agg(F.max("longer").alias("longer"))
    kept = phrases.join(most, (F.col("lang") == F.col("of_lang")) & (F.col("phrase") == F.col("part")), "left")
    wide = "decimal(19,0)"
    dropped = F.col("longer").cast(wide) * 100 >= F.col("a").cast(wide) * settings.inside
    return kept.filter(~F.coalesce(dropped, F.lit(False))).drop("of_lang", "part", "longer")


def best(phrases: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` phrases with their rank; first the best of each of many parts of a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    n_parts = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = phrases.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(n_parts)))
    some = dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).drop("share", "place")


def collocations(docs: DataFrame, top: int = 2000, settings: Settings | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text): each language's ``top`` phrases; n is its number of words."""
    settings = settings or Settings()
    found = written(counts(docs, settings), "phrases")
    phrases = best(outermost(written(scored(found, settings), "scored"), settings), top)
    n_words = found.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return phrases.join(n_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
