"""The pipeline's stages against brute force on their own inputs, and whole."""

import re
import zlib

import corpus_pipeline as pipeline
import numpy as np
from gradelake.llm import jaccard_join, queries, sentence_pieces, toxicity

from .test_operators import brute_repeats, words_of


def brute_passages(texts, n):
    seen, places = {}, []
    for t in texts:
        own = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", t)]
        places.append(own)
        words = [t[a:b] for a, b in own]
        for k in range(len(words) - n + 1):
            seen[tuple(words[k : k + n])] = seen.get(tuple(words[k : k + n]), 0) + 1
    for t, own in zip(texts, places, strict=True):
        cut, words = np.zeros(len(t), bool), [t[a:b] for a, b in own]
        for k in range(len(words) - n + 1):
            if seen[tuple(words[k : k + n])] > 1:
                cut[own[k][0] : own[k + n - 1][1]] = True
        yield cut


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.toPandas(), docs.toPandas())
        assert name == pipeline.STAGES[-1][0] or docs.columns == columns

    before, after = seen["toxicity"]
    verdict = toxicity.classify(spark.createDataFrame(before[["doc_id", "text"]]), queries.fitted_toxicity(spark, small)).toPandas()
    assert set(after.doc_id) == set(verdict[~verdict.rejected].doc_id)

    before, after = seen["ngram_jaccard_join"]
    sets = [set(s.tolist()) for s in jaccard_join.shingle_sets([t.encode() for t in before.text], 5)]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(int(before.doc_id[k]))
    assert sorted(after.doc_id) == sorted(min(g) for g in groups.values())

    before, after = seen["suffix_array_dedup"]
    raw = [t.encode() for t in before.text]
    kept = dict(zip(after.doc_id, after.text, strict=True))
    for d, t, by_bytes, by_words in zip(before.doc_id, raw, brute_repeats(raw, 400), brute_passages(raw, 51), strict=True):
        gone = by_bytes | by_words
        for k in range(len(t)):  # whole characters go
            if t[k] & 0xC0 == 0x80 and gone[k - 1]:
                gone[k] = True
        for k in range(len(t) - 1, 0, -1):
            if t[k] & 0xC0 == 0x80 and gone[k]:
                gone[k - 1] = True
        assert kept[d].split() == np.frombuffer(t, np.uint8)[~gone].tobytes().decode().split()
    assert (after.n_chars == after.text.str.len()).all()

    before, after = seen["benchmark_decontamination"]
    windows = set()
    for text in spark.read.parquet(f"{small}/benchmark.parquet").toPandas().text:
        w = words_of(text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = [d for d, t in zip(before.doc_id, before.text, strict=True) for w in [words_of(t)] if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))]
    assert sorted(after.doc_id) == sorted(clean)

    before, after = seen["sentencepiece"]
    model = sentence_pieces.model_at(sentence_pieces.default_model())
    order = before.set_index("doc_id").loc[after.doc_id]
    ids, counts = model.encode([t.encode() for t in order.text])
    assert after.n_tokens.tolist() == counts.tolist()
    assert np.concatenate(after.ids.tolist()).tolist() == ids.tolist()
    assert pipeline.run(spark, small).count() == len(after)


def test_passages_of_over_50_words_go(spark, small):
    def said(doc, n, width):
        return [f"{hash_of(doc, k):0{width}d}" for k in range(n)]

    def hash_of(doc, k):
        return zlib.crc32(f"{doc} {k}".encode()) % 10**4

    rows, want = [], []
    for k, n in enumerate([50, 51, 52, 55, 58, 62]):
        passage = said(f"passage {k}", n, 4)
        for side, blank in ((0, " "), (1, "\n")):  # where lines end doesn't matter
            one, two = said(f"{k} {side} before", 30 + side, 4), said(f"{k} {side} after", 20, 4)
            rows.append((2 * k + side, " ".join(one) + " " + blank.join(passage) + " " + " ".join(two)))
            want.append(one + (passage if n == 50 else []) + two)
    alone = " ".join(said("whole", 51, 4))
    rows += [(20, alone), (21, alone), (22, "x" * 500 + " a"), (23, "x" * 500 + " b"), (24, alone.rsplit(" ", 1)[0])]
    want += [[], [], ["a"], ["b"], alone.split()[:-1]]
    assert max(len(t) for k, t in rows if k < 12) < 900 and 5 * 62 < 400
    got = pipeline.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), small).orderBy("doc_id").collect()
    assert [r.text.split() for r in got] == want


def test_empty_and_odd_tables(spark, small):
    docs = spark.createDataFrame([(1, None, None), (2, "", None), (None, "a b c", "q")], "doc_id long, text string, block string")
    for rows in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, rows, small)
            assert out.columns == docs.columns, name
            assert out.count() == rows.count()
