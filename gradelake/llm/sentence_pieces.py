"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct words of a slice lie in flat numpy symbol arrays. Each round finds, word by word, the best-ranked
mergeable pair (a segmented minimum), merges its leftmost non-overlapping occurrences in all words at once and
compacts the arrays; words without a mergeable pair leave. Symbols outside the vocabulary become byte pieces.
Decoding gathers the pieces' bytes through a table.

Merging all occurrences at once equals merging one by one unless the merged piece opens a better pair; for the few
pieces where that can happen only the leftmost occurrence merges in a round.

Defined results: null and empty texts have no ids and decode to the empty text; a null doc_id stays null; repeated
rows each get their row; an empty table gives no rows; other columns are ignored. Words are cut only where no piece
can span, so texts of any length give the library's ids.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from gradelake.llm.common import WordIds, only, raw_texts, remembered, segment_sums, slices, spread

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
_FAR = np.int32(2**31 - 1)
codecs.register_error("piece_byte", lambda e: ("�", e.start + 1))


def default_model() -> str:
    """Where the public 32,000-piece model lies."""
    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Lookup tables of a BPE model with byte pieces, a dummy prefix and no other normalisation."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = sp.vocab_size()
        pieces = [sp.id_to_piece(k) for k in range(size)]
        special = [sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) for k in range(size)]
        normal = {p: k for k, p in enumerate(pieces) if not special[k]}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece holds a space after another character; words can't be cut at spaces")
        symbols = dict(normal)
        for ch in sorted({c for p in normal for c in p}):
            symbols.setdefault(ch, size + len(symbols) - len(normal))
        self.stride = size + len(symbols) - len(normal) + 1
        self.of_char = np.full(0x110000, self.stride - 1, np.int32)  # the last number: a character no piece holds
        for s, k in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k
        scores = np.array([sp.get_score(k) for k in range(size)])
        order = np.unique(-scores, return_inverse=True)[1]
        pairs = {}
        for p, k in normal.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.stride + b] = (order[k], k)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [_FAR], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], np.int32)
        best = np.full(self.stride, _FAR, np.int32)  # of each symbol, the best rank of a pair that holds it
        np.minimum.at(best, self.keys // self.stride, self.ranks[:-1])
        np.minimum.at(best, self.keys % self.stride, self.ranks[:-1])
        self.one_by_one = np.zeros(size, bool)
        self.one_by_one[list(normal.values())] = [best[k] <= order[k] for k in normal.values()]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        value = {int(k): b for b, k in enumerate(self.byte_ids)}
        surface = [
            bytes([value[k]]) if k in value else b"" if sp.is_control(k) else " ⁇ ".encode() if sp.is_unknown(k) else p.replace(SPACE, " ").encode()
            for k, p in enumerate(pieces)
        ]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.opens_with_space = np.array([p.startswith(SPACE) and not special[k] for k, p in enumerate(pieces)])
        self.words = WordIds(self.encode_words)
        self.silent = np.array([sp.is_control(k) for k in range(size)])

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair of symbols; a rank of _FAR where no piece joins them."""
        key = left.astype(np.int64) * self.stride + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != key] = len(self.keys)
        return self.ranks[at], self.merged[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each word has; spaces stand for themselves."""
        words = [w.replace(" ", SPACE) for w in words]
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.of_char[chars]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        char = chars.copy()
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbol), _FAR, np.int32)
        into = np.zeros(len(symbol), np.int32)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        rank[same], into[same] = self.pair(symbol[same], symbol[same + 1])
        while len(symbol):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[first, len(owner)])
            least = np.minimum.reduceat(rank, first)
            over = np.repeat(least == _FAR, size)
            if over.any():
                done.append((owner[over], symbol[over], char[over]))
                stay = ~over
                owner, symbol, char, rank, into = owner[stay], symbol[stay], char[stay], rank[stay], into[stay]
                live = least != _FAR
                size, least = size[live], least[live]
                if not len(symbol):
                    break
            hit = rank == np.repeat(least, size)
            at = np.flatnonzero(hit)
            opens = np.r_[True, np.diff(at) > 1]  # of a run of overlapping pairs every second one merges
            run = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            single = self.one_by_one[into[at]]
            if single.any():
                lead = np.r_[True, owner[at][1:] != owner[at][:-1]]
                at = at[lead | ~single]
            symbol[at] = into[at]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            new = (np.cumsum(stay) - 1)[at]
            owner, symbol, char, rank, into = owner[stay], symbol[stay], char[stay], rank[stay], into[stay]
            again = np.unique(np.r_[new, new[new > 0] - 1])
            rank[again] = _FAR
            again = again[again + 1 < len(owner)]
            again = again[owner[again] == owner[again + 1]]
            rank[again], into[again] = self.pair(symbol[again], symbol[again + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        owner, symbol, char = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return self._with_bytes(owner[order], symbol[order], char[order], len(words))

    def _with_bytes(self, owner, symbol, char, n_words) -> tuple[np.ndarray, np.ndarray]:
        odd = symbol >= self.size
        if not odd.any():
            return symbol, np.bincount(owner, minlength=n_words)
        c = char[odd]
        width = np.ones(len(symbol), np.int64)
        width[odd] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        ids = np.repeat(symbol, width)
        spots = np.repeat(odd, width)
        ids[spots] = self.byte_ids[np.frombuffer("".join(map(chr, c.tolist())).encode(), np.uint8)]
        return ids, np.bincount(np.repeat(owner, width), minlength=n_words)

    def encode(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8), one after another, and how many each text has."""
        docs = [b" " + t.replace(_SPACE_BYTES, b" ") if t else b"" for t in docs]
        sizes = np.array([len(t) for t in docs], np.int64)
        data = np.frombuffer(b"".join(docs) + bytes(8), np.uint8)
        n = len(data) - 8
        space = data[:n] == 32
        opens = space.copy()  # a word is a run of spaces and what follows; each text opens one
        opens[1:] &= ~space[:-1]
        opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(opens)
        before = np.r_[0, np.cumsum(opens)]
        ends = np.cumsum(sizes)
        return self.words.ids(data, starts, np.r_[starts[1:], n][: len(starts)], before[ends] - before[ends - sizes])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ``ids``, of which each text has as many as ``counts`` says."""
        ids = np.asarray(ids, np.int64)
        data = spread(self.surface, self.surface_len, ids, self.surface_at)
        ends = np.cumsum(segment_sums(self.surface_len[ids], counts))
        stops = np.cumsum(counts)
        out, whole, begin = [], data.tobytes(), 0
        for k, end in enumerate(ends.tolist()):
            part, own = whole[begin:end], ids[stops[k] - counts[k] : stops[k]]
            said = np.flatnonzero(~self.silent[own[:8]])
            at = int(said[0]) if len(said) else int(np.argmin(np.r_[self.silent[own], False]))
            if at < len(own) and self.opens_with_space[own[at]]:
                part = part[1:]
            out.append(part.decode("utf-8", "piece_byte"))
            begin = end
        return out


@lru_cache(maxsize=2)
def model_at(path: str) -> PieceModel:
    """The model's tables, built once in each process."""
    return PieceModel(path)


remembered("pieces", model_at.cache_clear)


def encode_and_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids array<int>, decoded string; a map without a shuffle."""
    path = model or default_model()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pieces")
        tables = model_at(path)
        for batch in slices(batches):
            ids, counts = tables.encode(raw_texts(batch))
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            decoded = pa.array(tables.decode(ids, counts), pa.string())
            own = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([own, lists, decoded], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>, decoded string")
