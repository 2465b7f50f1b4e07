"""Spelling variant grouping: every frequent word, the words one edit away from it, and the form it is a variant of.

The words' table is cut into shards by range of (length, word); each shard is a compact trie, kept as its sorted words with
the length of what each shares with the one before. Shards are broadcast in groups of bounded size. A task takes its own
words shard by shard and walks each word's distance-one Levenshtein automaton through the trie depth-first: along the word
until a node branches off or an edge differs, then, after one insertion, deletion or replacement, only exactly. A neighbour
is reached once, by the edit at its first difference. What a task finds for a word in a shard is one row (how many, and the
best), reduced over shards by the word. A shard whose words are all longer or shorter by more than one accepts nothing and
isn't walked.

Bounds: a shard holds at most SHARD_WORDS words and about SHARD_CHARS characters (one word at least), a broadcast about
GROUP_BYTES bytes of shards, whatever the number of words; more words are more shards and more broadcasts. Texts are
counted in pieces of about SLICE_BYTES bytes, cut where no letter stands, so a long text is no burden.

Defined results: a null text has no words; a null id is the empty string in the damage rule; an empty table gives an empty
result; rows with equal ids are texts like any others.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import SLICE_BYTES, discard, only, release, spread, written

SHARD_WORDS, SHARD_CHARS, GROUP_BYTES = 1 << 18, 1 << 22, 32 << 20
#: Distinct words that a task keeps before it hands them on.
HELD_WORDS = 1 << 19
#: Bytes of letters: a-z, and C3 with the byte after it (U+00C0 to U+00FF).
_ASCII = np.zeros(256, bool)
_ASCII[ord("a") : ord("z") + 1] = True
_LEAD = 0xC3
_CUT = re.compile(rb"[^A-Za-z\x80-\xc3]")
#: crc32 is shifted over words of at most this many bytes by table, over longer ones one by one.
_TABLED = 40


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """For each length and each byte of a crc32: what it becomes once that many bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> 1), step >> 1).astype(np.uint32)
    out = np.zeros((_TABLED + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(_TABLED):
        out[n + 1] = (out[n] >> 8) ^ step[out[n] & 255]
    return out


def following_crc(before: np.ndarray, after: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of strings put together: of those before (their crc32) and those after (their crc32 and lengths)."""
    table, out = _shifts(), after.copy()
    for k in range(4):
        out ^= table[lengths, k, (before >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Lists of about SLICE_BYTES bytes of (id, text); long texts are cut where no letter stands."""
    keys: list[bytes] = []
    held: list[bytes] = []
    n = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            at, text = 0, text or b""
            while at < len(text):
                end = at + SLICE_BYTES
                end = found.start() if end < len(text) and (found := _CUT.search(text, end)) else len(text)
                keys.append((key or "").encode())
                held.append(text[at:end])
                n, at = n + end - at, end
                if n >= SLICE_BYTES:
                    yield keys, held
                    keys, held, n = [], [], 0
    if held:
        yield keys, held


def damaged(word: str, h: int) -> str:
    """``word`` without the code point that ``h`` picks."""
    return word[: h % len(word)] + word[h % len(word) + 1 :]


def counted(keys: list[bytes], held: list[bytes], min_length: int, every: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of the pieces and their numbers; ``every``: see ``word_counts``."""
    data = np.frombuffer(b"\n".join(held).lower(), np.uint8)
    lead = data == _LEAD
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _ASCII[data] | lead
    inside[2:-1] |= lead[:-1]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    leads = np.r_[0, np.cumsum(lead)]
    points = ends - starts - (leads[ends] - leads[starts])
    long = np.flatnonzero(points >= min_length)
    starts, sizes = starts[long], (ends - starts)[long]
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    letters = spread(data, sizes, np.arange(len(sizes)), starts)
    words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))).dictionary_encode()
    number = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not every or not len(number):
        return words.dictionary, np.bincount(number, minlength=len(words.dictionary))
    first = np.cumsum([0] + [len(x) + 1 for x in held])[:-1]
    text = np.searchsorted(first, starts, side="right") - 1
    before = np.array([zlib.crc32(k + b":") for k in keys], np.uint32)[text]
    spelt = words.dictionary.to_pylist()
    own = np.array([zlib.crc32(w.encode()) for w in spelt], np.uint32)[number]
    h = following_crc(before, own, np.minimum(sizes, _TABLED))
    for k in np.flatnonzero(sizes > _TABLED).tolist():
        h[k] = zlib.crc32(spelt[number[k]].encode(), int(before[k]))
    hit = h % np.uint32(every) == 0
    changed = [x for k in np.flatnonzero(hit).tolist() if len(x := damaged(spelt[number[k]], int(h[k]))) >= min_length]
    n = np.r_[np.bincount(number[~hit], minlength=len(spelt)), np.ones(len(changed), np.int64)]
    there = np.flatnonzero(n)
    return pa.concat_arrays([words.dictionary, pa.array(changed, pa.string())]).take(pa.array(there)), n[there]


def word_counts(docs: DataFrame, min_length: int = 6, every: int = 0) -> DataFrame:
    """(word, n) of the lower-cased (A-Z only) runs of letters in (doc_id, text), of ``min_length`` code points at least.

    Where ``every`` is given, a run whose crc32 of ``<doc_id>:<run>`` it divides loses the code point that crc32 picks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("spelling")
        held, n = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).combine_chunks().group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for keys, texts in pieces(batches):
            words, numbers = counted(keys, texts, min_length, every)
            held.append(pa.table({"word": words, "n": pa.array(numbers, pa.int64())}))
            n += len(words)
            if n >= 2 * HELD_WORDS:
                held = [summed()]
                n = held[0].num_rows
                if n >= HELD_WORDS:
                    yield from held[0].to_batches(1 << 16)
                    held, n = [], 0
        if held:
            yield from summed().to_batches(1 << 16)
        release()

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def shared_lengths(words: list[str]) -> list[int]:
    """How many code points each word shares with the one before it."""
    out, before = [], ""
    for word in words:
        k, most = 0, min(len(word), len(before))
        while k < most and word[k] == before[k]:
            k += 1
        out.append(k)
        before = word
    return out


class Trie:
    """A compact trie of words in order: a node is [depth, a word below it, children by first letter, own word or -1]."""

    def __init__(self, words: list[str], shared: list[int], n: list[int]) -> None:
        self.words, self.n = words, n
        self.root: list = [0, 0, {}, -1]
        stack = [self.root]
        for k, word in enumerate(words):
            self._close(stack, shared[k])
            if word:
                stack.append([len(word), k, None, k])
            else:
                self.root[3] = k
        self._close(stack, 0)

    def _close(self, stack: list[list], depth: int) -> None:
        """Hang nodes deeper than ``depth`` below their parents, with a new node at ``depth`` where there is none."""
        while stack[-1][0] > depth:
            node = stack.pop()
            if stack[-1][0] < depth:
                stack.append([depth, node[1], None, -1])
            up = stack[-1]
            if up[2] is None:
                up[2] = {}
            up[2][self.words[node[1]][up[0]]] = node

    def _ends(self, node: list, depth: int, word: str, at: int) -> int:
        """The word that is reached when ``word[at:]`` is read exactly from ``depth`` on the edge to ``node``; -1: none."""
        while True:
            size = node[0] - depth
            if word[at : at + size] != self.words[node[1]][depth : node[0]]:
                return -1
            at += size
            if at == len(word):
                return node[3]
            if not node[2] or (below := node[2].get(word[at])) is None:
                return -1
            depth, node = node[0], below

    def near(self, word: str) -> list[int]:
        """The words exactly one edit from ``word``."""
        out, node, at, size, ends = [], self.root, 0, len(word), self._ends
        while True:
            _, _, below, own = node
            if own >= 0 and at == size - 1:  # the last letter is deleted
                out.append(own)
            here, after = word[at : at + 1], word[at + 1 : at + 2]
            for letter, kid in below.items() if below else ():
                if letter == here:
                    continue
                if here:
                    out.append(ends(kid, at + 1, word, at + 1))  # replaced
                    if letter == after:
                        out.append(ends(kid, at, word, at + 1))  # deleted
                out.append(ends(kid, at + 1, word, at))  # inserted
            if not below or not here or here not in below:
                break
            kid = below[here]
            edge, end = self.words[kid[1]], kid[0]
            if word[at:end] == edge[at:end]:
                node, at = kid, end
                continue
            at += 1
            while at < size and word[at] == edge[at]:
                at += 1
            if at < size:
                out += [ends(kid, at + 1, word, at + 1), ends(kid, at, word, at + 1)]
            out.append(ends(kid, at + 1, word, at))
            break
        return [k for k in out if k >= 0]


def packed_trie(words: list[str], n: list[int]) -> bytes:
    """Words in order, front-coded, with their numbers."""
    shared = shared_lengths(words)
    tails = pa.array([w[k:] for w, k in zip(words, shared, strict=True)], pa.large_string())
    batch = pa.record_batch([pa.array(shared, pa.int32()), tails, pa.array(n, pa.int64())], names=["shared", "tail", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked_trie(data: bytes) -> Trie:
    """The trie that ``packed_trie`` gave."""
    batch = pa.ipc.open_stream(data).read_next_batch()
    shared, words, before = batch.column(0).to_pylist(), [], ""
    for k, tail in zip(shared, batch.column(1).to_pylist(), strict=True):
        before = before[:k] + tail
        words.append(before)
    return Trie(words, shared, batch.column(2).to_pylist())


def shards(words: DataFrame) -> DataFrame:
    """(shortest, longest, trie) of (word, n) cut by range of (length, word)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[str] = []
        n: list[int] = []
        chars = 0

        def cut() -> pa.RecordBatch:
            order = sorted(range(len(own)), key=own.__getitem__)
            sizes = [len(w) for w in own]
            row = [[min(sizes)], [max(sizes)], [packed_trie([own[k] for k in order], [n[k] for k in order])]]
            return pa.record_batch([pa.array(x, kind) for x, kind in zip(row, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shortest", "longest", "trie"])

        for batch in batches:
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own and (len(own) >= SHARD_WORDS or chars + len(word) > SHARD_CHARS):
                    yield cut()
                    own, n, chars = [], [], 0
                own.append(word)
                n.append(count)
                chars += len(word)
        if own:
            yield cut()

    in_order = words.repartitionByRange(F.length("word"), "word").sortWithinPartitions(F.length("word"), "word")
    return in_order.select("word", "n").mapInArrow(work, "shortest long, longest long, trie binary")


FOUND = "word string, n long, n_near long, best struct<less: long, form: string>"


def _searched(words: DataFrame, group) -> DataFrame:
    """What the broadcast shards hold near each of the words: one row for a word and shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("spelling")
        mine = [word for batch in batches for word in batch.column(0).to_pylist()]
        sizes = [len(w) for w in mine]
        for shortest, longest, data in group.value:
            which = [k for k, size in enumerate(sizes) if shortest - 1 <= size <= longest + 1]
            if not which:
                continue
            trie, rows = unpacked_trie(data), []
            for k in which:
                if found := trie.near(mine[k]):
                    best = min((-trie.n[x], trie.words[x]) for x in found)
                    rows.append((mine[k], len(found), {"less": best[0], "form": best[1]}))
            if rows:
                word, n_near, best = zip(*rows, strict=True)
                kind = pa.struct([("less", pa.int64()), ("form", pa.string())])
                yield pa.record_batch([pa.array(word), pa.nulls(len(rows), pa.int64()), pa.array(n_near, pa.int64()), pa.array(best, kind)], names=["word", "n", "n_near", "best"])
        release()

    return words.select("word", "n").mapInArrow(work, FOUND)


def grouped(shards_of: DataFrame) -> Iterator[list[tuple[int, int, bytes]]]:
    """The shards in groups of about GROUP_BYTES; the driver holds one group at a time."""
    group: list[tuple[int, int, bytes]] = []
    for row in shards_of.orderBy("shortest", "longest").toLocalIterator():
        if group and sum(len(x[2]) for x in group) + len(row.trie) > GROUP_BYTES:
            yield group
            group = []
        group.append((row.shortest, row.longest, bytes(row.trie)))
    if group:
        yield group


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near_n, near) of (word, n): the number of words one edit away, the most frequent and its n."""
    spark = words.sparkSession
    dealt = written(words.select("word", "n"), "words")
    # A task's words lie together, so that few shards have words of their lengths; it has about as many as a shard at most.
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-dealt.count() // SHARD_WORDS))
    mine, tries = dealt.repartitionByRange(tasks, F.length("word"), "word"), written(shards(dealt), "tries")
    found = []
    for group in grouped(tries):
        sent = spark.sparkContext.broadcast(group)
        found.append(written(_searched(mine, sent), "near"))
        sent.unpersist()
    discard(tries)
    rows = dealt.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less: long, form: string>").alias("best"))
    for part in found:
        rows = rows.unionByName(part)
    best = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return best.select("word", "n", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.form").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, twice as far each round. A form has more than its word."""
    step, moved = written(forms.select("word", F.col("form").alias("at")), "forms"), True
    while moved:
        on = step.select(F.col("word").alias("at"), F.col("at").alias("next"))
        after = written(step.join(on, "at", "left").select("word", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved")), "forms")
        moved = bool(after.filter("moved").limit(1).count())
        discard(step)
        step = after
    return step.select("word", F.col("at").alias("root"))


def spelling_groups(words: DataFrame, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n): a form is the most frequent neighbour if it has ``factor`` times n."""
    near = neighbours(words)
    known = written(near.withColumn("is_variant", F.coalesce(F.col("near_n") >= factor * F.col("n"), F.lit(False))), "known")
    variants = known.filter("is_variant").select("word", F.col("near").alias("form"))
    out = known.join(roots(variants), "word", "left")
    form, form_n = (F.when(F.col("is_variant"), F.col(c)) for c in ("near", "near_n"))
    return out.select("word", form.alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", form_n.alias("form_n"))
