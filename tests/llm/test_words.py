"""Spelling groups, the mix of sources and collocations against brute force, on awkward inputs."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradelake.llm import collocations, mixture, spelling

ODD = [None, "", " ", "é" * 9, "É" * 9, "ab" * 3000, "Straßen STRASSEN straßen", "x÷y×zzz", "\x00ábcdefg\x00", "a.b.c.d", "漢字éclairs漢"]


def damaged_counts(rows, every):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return n


def edits(word, alphabet):
    for k in range(len(word) + 1):
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            yield from (word[:k] + c + word[k + 1 :] for c in alphabet if c != word[k])
        yield from (word[:k] + c + word[k:] for c in alphabet)


def brute_groups(n, factor=5):
    alphabet, out = set("".join(n)), {}
    for word in n:
        near = {x for x in edits(word, alphabet) if x in n}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[word] = (best if best is not None and n[best] >= factor * n[word] else None, len(near))
    rows = set()
    for word, (form, n_near) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        rows.add((word, form, root, n[word], n_near, n[form] if form else None))
    return rows


def random_words(n, letters="abé", sizes=(1, 9)):
    return ["".join(random.choice(letters) for _ in range(random.randint(*sizes))) for _ in range(n)]


def test_word_counts(spark):
    random.seed(11)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "lettres perdues")] * 2
    rows += [(k, " ".join(random_words(400, "abcdeéß", (4, 50)))) for k in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "form")})
    got = {r.word: r.n for r in spelling.word_counts(docs, 6, 7).collect()}
    assert got == damaged_counts(rows, 7)
    plain = {r.word: r.n for r in spelling.word_counts(docs, 6).collect()}
    assert plain == damaged_counts(rows, 1 << 40)
    assert spelling.word_counts(docs.limit(0)).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE_BYTES", 50)
    random.seed(12)
    rows = [("1", " ".join(random_words(300, "abé漢", (1, 80)))), ("2", "z" * 500), ("3", None), ("4", "漢é" * 200)]
    batch = pa.record_batch([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    n, parts = Counter(), 0
    for keys, held in spelling.pieces(iter([batch])):
        words, numbers = spelling.counted(keys, held, 6, 7)
        n.update(dict(zip(words.to_pylist(), numbers.tolist(), strict=True)))
        parts += 1
    assert n == damaged_counts(rows, 7) and parts > 50


def test_trie_finds_all_neighbours():
    random.seed(13)
    words = sorted({*random_words(3000, "abc", (1, 8)), "", "a" * 3000, "a" * 3001, "b" + "a" * 3000})
    trie = spelling.unpacked_trie(spelling.packed_trie(words, list(range(len(words)))))
    known = set(words)
    for word in [*random_words(500, "abcd", (0, 9)), *random.sample(words, 300), "a" * 2999, "a" * 3001]:
        found = [trie.words[k] for k in trie.near(word)]
        assert len(found) == len(set(found))
        if len(word) < 100:
            assert set(found) == {x for x in edits(word, "abcd") if x in known} - {word}
    assert {trie.words[k] for k in trie.near("a" * 3001)} == {"a" * 3000, "b" + "a" * 3000}


@pytest.mark.parametrize("shard", [7, 1 << 18])
def test_groups_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling, "GROUP_BYTES", 1 << 12 if shard < 100 else 1 << 20)
    random.seed(14)
    n = {w: random.choice([5, 6, 25, 30, 150, 151, 800, 5000]) for w in {*random_words(250, "abé", (1, 7)), "a", "ß" * 40, "ß" * 41}}
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3).withColumn("root", F.lit("x"))
    assert {tuple(r) for r in spelling.spelling_groups(words).collect()} == brute_groups(n)


def test_groups_of_nothing(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_groups(none).collect() == []


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(40)] + [("v", "w39")], "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(forms).collect()} == {*((f"w{k}", "w40") for k in range(40)), ("v", "w40")}


def wanted_targets(words, share=Fraction(3, 2)):
    """Sources' targets, shared out again and again."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, total = set(), share * sum(words.values())
    while True:
        rest = [s for s in words if s not in full]
        left = total - sum(2 * words[s] for s in full)
        target = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = {s for s in rest if target[s] > 2 * words[s]}
        if not above:
            return {s: float(target.get(s, 2 * words[s])) for s in words}
        full |= above


def mix_rows(seed=15):
    random.seed(seed)
    names = [None, "", "a", "Z", "é", "zz", "hot"]
    rows = [(k, random.choice([*names, "hot", "hot", "hot"]), random.randint(0, 3) * random.randint(0, 400)) for k in range(3000)]
    return rows + [(None, "hot", 7)] * 40 + [(5, None, 11)] * 30 + [(9001, "empty", 0), (9002, "empty", 0), (9003, "one", 5)]


def test_mix_meets_targets(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)
    docs = docs.withColumns({c: F.lit("x") for c in ("row", "part", "before", "expected", "its_source", "of_size", "target", "copies", "words", "weight")})
    mix = mixture.mixed(docs)
    got = mix.collect()
    assert sorted(map(str, ((r.doc_id, r.source, r["size"]) for r in got))) == sorted(map(str, rows))
    words, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        words[r.source] += r["size"]
        taken[r.source] += r.copies * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
        assert 0 <= r.copies <= 2
    target = wanted_targets(dict(words))
    for r in got:
        assert r.source_size == words[r.source] and r.target == pytest.approx(target[r.source])
    for s in words:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    key = lambda rows: sorted(str((r.doc_id, r.source, r["size"], r.copies)) for r in rows)
    assert key(mixture.mixed(docs.repartition(3)).collect()) == key(got)
    assert key(mixture.mixed(docs, seed=1).collect()) != key(got)
    copies = mixture.emitted(mix).groupBy("source").agg(F.sum("size").alias("n")).collect()
    assert {r.source: r.n for r in copies} == {s: n for s, n in taken.items() if n or any(r.source == s and r.copies for r in got)}


@pytest.mark.parametrize("rows", [[], [(1, "a", 0)], [(1, None, 3)], [(1, "a", 10), (2, "b", 1), (3, "c", 1)]])
def test_small_mixes(spark, rows):
    got = mixture.mixed(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert len(got) == len(rows)
    if rows:
        target = wanted_targets({r[1]: r[2] for r in rows}) if any(r[2] for r in rows) else {r[1]: 0 for r in rows}
        assert all(r.target == pytest.approx(target[r.source]) for r in got)


def test_sums_before_hot_groups(spark):
    rows = spark.range(0, 5000, 1, 7).select(F.lit(1).alias("v"), F.when(F.col("id") % 3 > 0, "hot").alias("g"))
    got = mixture.sums_before(rows, "g", F.col("v").cast("long"), [F.col("v")], "n").groupBy("g").agg(F.sort_array(F.collect_list("n")).alias("n")).collect()
    assert all(list(r.n) == list(range(len(r.n))) for r in got) and sum(len(r.n) for r in got) == 5000


def brute_collocations(rows, top, least, inside):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                for k in range(len(w) - size + 1):
                    f[lang][tuple(w[k : k + size])] += 1
    out = set()
    for lang, own in f.items():
        some = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in some.items():
            score, _, x, y = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= inside * a and any(q[k : k + len(p)] == p for k in range(len(q))) for q, b in some.items()):
                scored.append((-score, -a, " ".join(p).encode(), x, y))
        for rank, (score, a, p, x, y) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, x, y, n[lang], -score))
    return out


def phrase_rows(n=150):
    random.seed(16)
    words = ["new", "york", "city", "a", "É", "é", "B", "b", "<x>", "漢"]
    text = lambda: "".join(random.choice(words) + random.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", ",", " "]) for _ in range(random.randint(0, 80)))
    rows = [(random.choice(["en", "en", "en", "de", None, "und", ""]), text()) for _ in range(n)]
    return rows + [("en", "new york city hall " * 60), ("en", None), ("xx", "..."), ("en", "a"), ("de", "same words here now. " * 40)] + [("de", "Same words, here")] * 5


@pytest.mark.parametrize(("least", "top"), [(3, 5000), (12, 20)])
def test_collocations_equal_brute_force(spark, least, top):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({c: F.lit(1) for c in ("phrase", "f", "page", "rank", "n")})
    got = collocations.collocations(docs, top, collocations.Settings(least=least)).collect()
    assert {tuple(r) for r in got} == brute_collocations(rows, top, least, 80)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([(None, None), ("en", "a b c")], "lang string, text string")
    assert collocations.collocations(docs).collect() == [] and collocations.collocations(docs.limit(0)).collect() == []


def test_a_full_sketch_loses_nothing(spark):
    docs = spark.createDataFrame(phrase_rows(), "lang string, text string")
    settings = collocations.Settings(least=3)
    full = {k: b"\xff" * (collocations.PAGE // 8) for k in range(collocations.ROWS * collocations.CELLS // collocations.PAGE)}
    everything = collocations.survivors(docs, full, settings).filter("f >= 3 or phrase = ''")
    assert {tuple(r) for r in everything.collect()} == {tuple(r) for r in collocations.counts(docs, settings).collect()}


def test_sketch_never_undercounts_and_filters(spark):
    rows = [("en", " ".join(f"w{random.randint(0, 10**6)}" for _ in range(500)) + " twice told tale") for _ in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    settings = collocations.Settings()
    found = {r.phrase: r.f for r in collocations.survivors(docs, collocations.merged(collocations.sketched(docs, settings), 30), settings).collect()}
    assert found["twice told tale"] == 40 and len(found) < 20


@pytest.mark.parametrize("limit", [40, 300, 1 << 20])
def test_phrases_over_cuts(monkeypatch, limit):
    monkeypatch.setattr(collocations, "SLICE_BYTES", limit)
    rows = phrase_rows(30) + [("fr", "x y z " * 300), ("fr", "q" * 500 + " r s t u " + "v" * 300)]
    batch = pa.record_batch([pa.array([x for x, _ in rows]), pa.array([x for _, x in rows])], names=["lang", "text"])
    bits, known, n = np.full((collocations.ROWS, collocations.CELLS // 8), 255, np.uint8), {}, Counter()
    for langs, held, before in collocations.pieces(iter([batch]), 3):
        words, hashes = collocations.words_of(langs, held, before, known)
        found = collocations.exact(words, list(collocations.gram_hashes(words, hashes, known, 4)), bits)
        names = list(known)
        for lang, phrase, f in zip(*(found.column(c).to_pylist() for c in ("lang", "phrase", "f")), strict=True):
            n[names[lang], phrase] += f
    want = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").replace("É", "\0").lower().replace("\0", "É")):
            w = re.findall(r"[^ \t]+", piece)
            want["und" if lang is None else lang, ""] += len(w)
            for size in range(1, 5):
                for k in range(len(w) - size + 1):
                    want["und" if lang is None else lang, " ".join(w[k : k + size])] += 1
    assert n == +want


def test_counters_stop_at_the_least_count():
    hashes = np.arange(100, dtype=np.uint64)
    assert all(a != b for a, b in pairwise(collocations.cells(hashes, 0).tolist()))
    with pytest.raises(ValueError, match="one byte"):
        collocations.sketched(None, collocations.Settings(least=300))
