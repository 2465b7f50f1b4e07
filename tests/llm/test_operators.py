"""The training-data operators against brute force, libraries and held-out labels, on awkward inputs."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradelake.llm import chat_format, common, decontaminate, jaccard_join, language_id, quality_model, quality_rules, queries, sentence_pieces, suffix_dedup, token_files, toxicity
from gradelake.llm.common import spread

AWKWARD = ["", None, " ", "a", "a b", "A  b", "1234 !!", "é" * 300, "word " * 3000, "x" * 2000, "same text here to see", "same text here to see", "\x00nul", "▁▁ x", "\n\n"]


def frame(spark, texts, extra=""):
    rows = [(None if k == 3 else k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("block", "print", "key", "token", "kept", "spans", "score", "label", "lang")}) if extra else df


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_pieces_equal_the_library(spark, small):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    random.seed(4)
    alphabet = "abcdefgh ABCé▁ \n\t.,!漢😀0189"
    texts = [t or "" for t in AWKWARD] + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(500)]
    texts += ["".join(random.choice("ab") for _ in range(50)) for _ in range(300)] + [" " * k for k in range(20)]
    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    model = sentence_pieces.model_at(sentence_pieces.default_model())
    ids, counts = model.encode([t.encode() for t in texts + docs])
    want = sp.encode(texts + docs)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == want
    assert model.decode(ids, counts) == sp.decode(want)


def test_piece_query(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    got = sentence_pieces.encode_and_decode(frame(spark, AWKWARD, "clashes")).collect()
    assert sorted(tuple(r.ids) for r in got) == sorted(tuple(sp.encode(t or "")) for t in AWKWARD)


def test_token_files_read_back(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    tk = Tokenizer.from_file(token_files.default_vocabulary())
    texts = [*AWKWARD, "It's DON'T can't I'LL", "A's.b='c", "İ̸ é.", "x y\x1cz"]
    path = token_files.write_token_ids(frame(spark, texts, "clashes"))
    got = token_files.read_token_ids(spark, path).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    order = sorted(range(len(texts)), key=lambda k: -1 if k == 3 else k)
    want = [[*tk.encode(texts[k] or "", add_special_tokens=False).ids, 1] for k in order]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want
    assert [r.start for r in got] == (np.cumsum([len(x) for x in want]) - [len(x) for x in want]).tolist()
    assert token_files.read_token_ids(spark, token_files.write_token_ids(frame(spark, AWKWARD).limit(0))).count() == 0


def test_added_tokens_in_texts():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_files.default_vocabulary())
    texts = []
    for s in ("<|endoftext|>", "<|startoftext|>"):
        texts += [s, f"a {s} b", f"A{s}B", f"{s}{s}x", f"é{s}\u0301", f"<|{s}|>", s.upper(), s.title(), f"{s.upper()}{s}", s[:-1], f"A\u0130{s}'s"]
    ids, counts = token_files.encoder_at(token_files.default_vocabulary()).encode([t.encode() for t in texts])
    ends = np.cumsum(counts)
    got = [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]
    want = [tk.encode(t, add_special_tokens=False).ids for t in texts]
    assert [t for t, x, y in zip(texts, got, want, strict=True) if x != y] == []


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_packing_round_trip(n):
    ranks = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) >> np.arange(n, dtype=np.uint32) % 31
    control, data = token_files.pack(ranks)
    assert (token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


def brute_repeats(texts, length):
    seen = {}
    for t in texts:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] = seen.get(t[s : s + length], 0) + 1
    for t in texts:
        cut = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                cut[s : s + length] = True
        yield cut


def test_repeats_equal_brute_force(spark, monkeypatch):
    random.seed(1)
    words = "alpha beta gamma delta été ñandú omega sigma tau pi rho 漢字".split()
    passages = [" ".join(random.choice(words) for _ in range(30)) for _ in range(5)]
    texts = []
    for _ in range(80):
        t = " ".join(random.choice(words) + str(random.randint(0, 99)) for _ in range(random.randint(0, 60)))
        for _ in range(random.randint(0, 2)):
            a, cut = random.randint(0, 60), random.randint(0, len(t))
            t = t[:cut] + random.choice(passages)[a : a + random.randint(10, 200)] + t[cut:]
        texts.append(t)
    texts += [*texts[:6], *AWKWARD]
    monkeypatch.setattr(suffix_dedup, "_PIECE", 700)  # long texts are cut into pieces
    got = suffix_dedup.remove_repeats(frame(spark, texts, "clashes"), 40)
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    got = sorted(tuple(r) for r in got.select("n_bytes", n, F.size("spans"), F.sha2("kept", 256)).collect())
    raw = [(t or "").encode() for t in texts]
    want = sorted((len(t), int(c.sum()), int((np.diff(np.r_[0, c.astype(int)]) == 1).sum()), sha(np.frombuffer(t, np.uint8)[~c].tobytes())) for t, c in zip(raw, brute_repeats(raw, 40), strict=True))
    assert got == want
    whole = suffix_dedup.remove_repeats(frame(spark, texts), 40, whole_characters=True).select("kept").collect()
    assert all(bytes(r.kept).decode() is not None for r in whole)
    assert suffix_dedup.remove_repeats(frame(spark, AWKWARD).limit(0)).count() == 0


def test_multikey_order():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 20, 400, dtype=np.uint64), r.integers(0, 5, 400, dtype=np.uint64)
    order = suffix_dedup.multikey_order([a, b])
    assert [(a[k], b[k]) for k in order] == sorted(zip(a, b, strict=True))
    assert suffix_dedup.repeats([a, b]).tolist() == [list(zip(a, b, strict=True)).count(x) > 1 for x in zip(a, b, strict=True)]


def test_suffixes_differ_in_any_token(spark):
    none = np.zeros((0, 2), np.uint64)
    same = [np.full(1, 9 << 40, np.uint64), np.full(1, 5 << 40, np.uint64), np.full(1, 7, np.uint32)]
    for k in range(3):
        blocks = [suffix_dedup.Suffixes([t + t.dtype.type(low if k == j else 0) for j, t in enumerate(same)]).rows(b, none) for b, low in enumerate([1, 2, 1])]
        rows = spark.createDataFrame([tuple(x.values()) for t in blocks for x in t.to_pylist()], "range int, block int, lead binary, print binary, more binary")
        assert {r.block: r.bits[0] >> 7 for r in suffix_dedup._judge(rows).collect()} == {0: 1, 1: 0, 2: 1}
    text = bytes(range(100)) * 2
    parts = list(suffix_dedup.pieces([text], 40))
    found = suffix_dedup._candidate_suffixes(parts, 40, suffix_dedup._anchor_suffixes(parts).repeated({}, none))[0]
    leads = found.tokens[0].tolist()
    assert leads == sorted(leads) and set(leads) <= {int.from_bytes(text[k : k + 8], "big") for k in range(100)} and (found.tokens[2] > 0).any()


def test_ranges_part_no_equal_suffixes():
    r = np.random.default_rng(7)
    lead, print_ = r.integers(0, 9, 500, dtype=np.uint64), r.integers(0, 50, 500, dtype=np.uint64)
    own = suffix_dedup.Suffixes([lead, print_])
    splitters = np.array(sorted({(int(a), int(b)) for a, b in zip(r.integers(0, 9, 12), r.integers(0, 50, 12), strict=True)}), np.uint64)
    cuts = suffix_dedup.ranges_of(own.tokens, splitters)
    pairs = list(zip(own.tokens[0].tolist(), own.tokens[1].tolist(), strict=True))
    assert pairs == sorted(set(pairs)) and cuts[-1] == len(pairs)
    for k, s in enumerate(splitters.tolist()):
        assert all(p <= tuple(s) for p in pairs[: cuts[k + 1]]) and all(p > tuple(s) for p in pairs[cuts[k + 1] :])
    values = np.sort(r.integers(0, 1 << 63, 300, dtype=np.uint64))
    assert (suffix_dedup._from_planes(suffix_dedup._planes(values)) == values).all()


def test_repeats_of_a_task_are_settled_once(spark, tmp_path):
    random.seed(8)
    text = " ".join(str(random.random()) for _ in range(60))
    for k in range(6):
        spark.createDataFrame([(k, text if k < 4 else f"short {k}")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes") if spark.conf.get(k, None)}
    got = []
    try:
        for first, later in ((1 << 10, 1 << 27), (1 << 27, 1 << 10)):  # how files make tasks changes between the jobs
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            spark.conf.set("spark.sql.files.minPartitionNum", 1)
            spark.conf.set("spark.sql.files.maxPartitionBytes", first)
            left = suffix_dedup.remove_repeats(spark.read.parquet(f"{tmp_path}/docs"))
            spark.conf.set("spark.sql.files.maxPartitionBytes", later)
            got.append(sorted((r.doc_id, bytes(r.kept)) for r in left.collect()))
    finally:
        for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes"):
            spark.conf.set(k, held[k]) if k in held else spark.conf.unset(k)
    want = [(k, b"" if k < 4 else f"short {k}".encode()) for k in range(6)]
    assert got == [want, want]


def words_of(text):
    out, word = [], ""
    for ch in (text or "").translate({c: c + 32 for c in range(65, 91)}) + " ":
        if ch.isascii() and not (ch.isdigit() or "a" <= ch <= "z"):
            out, word = (out + [word], "") if word else (out, "")
        else:
            word += ch
    return out


def test_decontamination_equals_brute_force(spark):
    random.seed(2)
    pool = [f"w{k}" for k in range(12)] + ["É", "été"]
    items = [" ".join(random.choice(pool) for _ in range(random.choice([0, 1, 3, 9, 10, 14]))) for _ in range(12)] + [None, "W1, w2!"]
    texts = [" ".join(random.choice(pool + ["zz"]) for _ in range(random.randint(0, 40))) + " " + (random.choice(items) or "") + "." for _ in range(60)] + AWKWARD
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    lists = [words_of(t) for t in items]
    want = []
    for t in texts:
        words, hit, found = words_of(t), set(), set()
        for item, own in enumerate(lists):
            n = min(10, len(own))
            for a in range(len(own) - n + 1 if own else 0):
                for s in range(len(words) - n + 1):
                    if words[s : s + n] == own[a : a + n]:
                        hit.update(range(s, s + n))
                        found.add(str(item))
        want.append((len(words), len(hit), tuple(sorted(found))))
    for size in (1 << 20, 60):  # one block of items, and several
        got = decontaminate.decontaminate(frame(spark, texts, "clashes"), bench, block_bytes=size).collect()
        assert sorted((r.n_words, r.n_hit, tuple(r["items"])) for r in got) == sorted(want)
    left = decontaminate.drop_contaminated(frame(spark, texts, "clashes"), bench)
    assert left.count() == sum(n == 0 for _, n, _ in want)
    assert decontaminate.decontaminate(frame(spark, AWKWARD), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_jaccard_components_equal_sql(spark):
    import duckdb

    random.seed(3)
    base = [" ".join(random.choice("abcdefghij") + random.choice("klmnop") for _ in range(60)) for _ in range(3)]
    texts = []
    for k in range(150):
        w = base[k % 3].split()
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = random.choice(["x", "y", f"q{random.randint(0, 40)}"])
        texts.append(" ".join(w))
    texts += ["", None, "a", "a b", "A  b", "a b c", "a b c d", " \n"]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    want = sorted(duckdb.sql(queries._OP6_SQL).fetchall())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for direct, rounds, pivots, chunk in ((64, 5, 2048, 1_000_000), (3, 2, 4, 300), (3, 5, 0, 1_000_000)):
        got = jaccard_join.jaccard_components(df, jaccard_join.Settings(width=4, percent=85, direct=direct, rounds=rounds, pivots=pivots, chunk=chunk))
        assert sorted(map(tuple, got.collect())) == want


def test_jaccard_keeps_one_of_each(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(5, long), (2, long), (2, long), (9, f"{long} tail"), (7, "quite another text with enough words in it"), (None, long), (1, ""), (3, None)]
    left = jaccard_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gone_id": F.lit(1), "key": F.lit(2)}))
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 7]
    assert jaccard_join.keep_one_of_each(left.limit(0)).count() == 0


def test_jaccard_keeps_different_texts_of_one_id(spark):
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, ""), (None, None), (4, texts[2]), (4, texts[3]), (4, texts[3] + " tail"), (4, "")]
    rows += [(-1, texts[4]), (None, texts[4]), (5, texts[5]), (6, texts[5])]  # a null id is not the id -1
    left = jaccard_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("x")))
    assert left.columns == ["doc_id", "text", "root"]
    got = sorted((str(r.doc_id), (r.text or "").removesuffix(" tail")) for r in left.collect())
    want = [("None", texts[0]), ("None", texts[1]), ("None", ""), ("None", ""), ("4", texts[2]), ("4", texts[3]), ("4", ""), ("-1", texts[4]), ("5", texts[5])]
    assert got == sorted(want)


def test_quality_rules_base_equals_brute_force(spark):
    random.seed(5)
    texts = [*AWKWARD, "one two three four five six\none two three four five six\n\nq", "#a *b $c %d &e |f <g> h i j k"]
    texts += [" ".join(random.choice("abcd") for _ in range(random.randint(1, 60))) for _ in range(60)]
    got = quality_rules.quality_rules(frame(spark, texts, "clashes")).collect()
    want = []
    for t in texts:
        t = t or ""
        words = t.encode().split()
        cover, seen = [False] * len(words), {}
        for s in range(len(words) - 4):
            seen.setdefault(tuple(words[s : s + 5]), []).append(s)
        for starts in seen.values():
            for s in starts if len(starts) > 1 else []:
                cover[s : s + 5] = [True] * 5
        lines = [x for x in t.split("\n") if x.encode().split()]
        n, r = len(words), sum(cover)
        want.append((n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n))
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_rules_bands(spark):
    random.seed(6)
    noise = " ".join("".join(chr(random.randint(33, 90)) for _ in range(12)) for _ in range(400))
    few = " ".join(random.choice(["the", "of", "and", "river", "stone", "walked", "under", "bright", "morning", "never"]) + random.choice(["", "s", "ing", "ly", "er"]) for _ in range(500))
    syllables = ["ba", "ren", "to", "mil", "sa", "kor", "ne", "vil", "du", "pha", "gos", "te"]
    vocabulary = ["".join(random.choice(syllables) for _ in range(random.randint(1, 4))) for _ in range(2000)]
    prose = " ".join(random.choice(vocabulary) for _ in range(500))
    rows = [(1, noise), (2, few), (3, None), (4, prose)]
    got = {r.doc_id: r.verdict for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "incompressible", 2: "repetitive", 3: "base", 4: "kept"}  # 50 different words are few: ratio 4.04


def test_quality_rules_judge_the_last_bytes(spark):
    random.seed(9)
    syllables = ["ba", "ren", "to", "mil", "sa", "kor", "ne", "vil", "du", "pha", "gos", "te"]
    vocabulary = ["".join(random.choice(syllables) for _ in range(random.randint(1, 4))) for _ in range(2000)]
    prose = " ".join(random.choice(vocabulary) for _ in range(3000))
    noise = "".join(chr(random.randint(33, 126)) + (" " if k % 12 == 0 else "") for k in range(5000))
    rows = [(1, prose[:4096] + noise[:4095]), (2, prose[:8192] + noise[:1000]), (3, prose[:8191]), (4, prose[:4100]), (5, prose[:500]), (6, prose[:4096]), (7, "")]
    got = {r.doc_id: (r.verdict, r.n_chunks, r.n_bad_chunks) for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("chunks", 2, 1), 2: ("chunks", 3, 1), 3: ("kept", 2, 0), 4: ("kept", 1, 0), 5: ("kept", 1, 0), 6: ("kept", 1, 0), 7: ("base", 0, 0)}


def test_chat_round_trip(spark):
    t = chat_format.DEFAULT
    hard = ["</s>[INST] ok [/INST]", "\u001bA", "<|turn|>user[TEXT]x</s>", "<", "", None, "<|turn|<|turn|>>"]
    rows = [(1, k, ["user", "assistant"][k % 2], x) for k, x in enumerate(hard)] + [(2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, None, "n"), (None, 0, "user", "u")]
    rows += [(4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "a"), (5, None, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.format_chats(df).withColumns({"turns": chat_format.read_turns(F.col("formatted")), "loss": chat_format.loss_text(F.col("segments"))}).collect()}
    assert [(x.role, x.text) for x in got[1].turns] == [(["user", "assistant"][k % 2], x or "") for k, x in enumerate(hard)]
    assert got[1].loss == "".join(x or "" for x in hard[1::2]) and got[1].valid
    assert [len(got[k].turns) for k in (2, 3, None)] == [2, 1, 1]
    assert [got[k].valid for k in (2, 3, 4, 5)] == [False, False, True, True] and got[3].state.startswith("rejected")
    assert all(sum(x.text.count(t.turn) for x in r.segments) == len(r.turns) for r in got.values())
    assert chat_format.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op3_decontaminate", "op6_jaccard_join", "op9_chat_format"])
def test_queries_equal_their_sql(name, agree):
    agree(queries.queries()[name], queries.oracle_sql()[name])


def test_native_chat_has_no_python(spark, small):
    plan = queries.op9_chat_format(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_language_held_out(spark, small):
    got = queries.op1_language_id(spark, f"{small[: -len('sf0.001')]}sf0.01").join(spark.read.parquet(f"{small[: -len('sf0.001')]}sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = spark.createDataFrame([(k, "the cat and the dog walk " * 3, "en") for k in range(5)] + [(9, "der hund und die katze gehen " * 3, "de"), (10, None, "en"), (11, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit(rows)
    got = {r.text: r for r in frame(spark, AWKWARD).join(language_id.identify(frame(spark, AWKWARD, "clashes"), model), "doc_id").collect()}
    assert got[""].nearest == got["1234 !!"].nearest == "und" and got[""].score == 0
    assert all(r.nearest in ("en", "de", "und") for r in got.values())
    empty = language_id.fit(rows.limit(0))
    assert {r.nearest for r in language_id.identify(frame(spark, AWKWARD), empty).collect()} == {"und"}


def test_toxicity_held_out(spark, small):
    folder = f"{small[: -len('sf0.001')]}sf0.1"
    got = queries.op8_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "toxic AS y"), "doc_id").filter("held_out").toPandas()
    assert got[got.y == 1].rejected.mean() > 0.85
    assert got[got.y == 0].rejected.mean() < 0.01


def test_toxicity_edges(spark):
    chain = toxicity.fit(frame(spark, AWKWARD), spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, label int"))
    got = toxicity.classify(frame(spark, AWKWARD, "clashes"), chain).collect()
    assert len(got) == len(AWKWARD) and not any(r.rejected for r in got)
    assert toxicity.keep_clean(frame(spark, AWKWARD, "clashes"), chain).columns == frame(spark, AWKWARD, "clashes").columns


def test_quality_model_held_out(spark, small):
    folder = f"{small[: -len('sf0.001')]}sf0.1"
    got = queries.op10_quality_model(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert got[got.quality == 1].score.mean() - got[got.quality == 0].score.mean() > 0.7


def test_quality_model_gradient():
    s = quality_model.Settings(filters=4, hidden=5)
    net = quality_model.Network.fresh(s)
    docs, labels, weights = [b"hello world " * 40, b"", b"zz*** q"], np.array([1.0, 0.0, 1.0], np.float32), np.ones(3, np.float32)

    def loss():
        p = net.score(docs)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    g = net.gradient(docs, labels, weights)
    for name, at in (("bias", (0,)), ("pool", (0,)), ("sum", (1,)), ("mix", (1, 2)), ("taps", (0, 104, 1))):
        held, h = net.p[name][at], 1e-2
        net.p[name][at] = held + h
        up = loss()
        net.p[name][at] = held - h
        down = loss()
        net.p[name][at] = held
        assert abs((up - down) / (2 * h) - g[name][at]) < 2e-3


def test_quality_model_edges(spark):
    net = quality_model.fit(frame(spark, AWKWARD), spark.createDataFrame([], "doc_id long, label int"))
    got = quality_model.score(frame(spark, AWKWARD, "clashes"), net).collect()
    assert len(got) == len(AWKWARD) and all(abs(r.score - 0.5) < 0.01 for r in got)


def test_folds_are_crc32(spark):
    from gradelake.llm.common import crc32_mod

    got = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", crc32_mod("doc_id", 5).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


def test_spread():
    assert spread(np.arange(10), np.array([2, 0, 3]), np.array([2, 0, 1, 2])).tolist() == [2, 3, 4, 0, 1, 2, 3, 4]


def test_multikey_quicksort_parts_large_runs(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SMALL", 300)
    r = np.random.default_rng(5)
    a, b = r.integers(0, 7, 5000, dtype=np.uint64), r.integers(0, 900, 5000, dtype=np.uint64)
    order = suffix_dedup.multikey_order([a, b])
    assert sorted(order.tolist()) == list(range(5000))
    assert [(a[k], b[k]) for k in order] == sorted(zip(a, b, strict=True))


def small_documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()


def test_suffix_query_equals_brute_force(spark, small):
    rows = small_documents(spark, small)
    raw = [(r.text or "").encode() for r in rows]
    want = []
    for r, t, c in zip(rows, raw, brute_repeats(raw, 400), strict=True):
        want.append((r.doc_id, len(t), int(c.sum()), int((np.diff(np.r_[0, c.astype(int)]) == 1).sum()), sha(np.frombuffer(t, np.uint8)[~c].tobytes())))
    assert sorted(map(tuple, queries.op2_suffix_dedup(spark, small).collect())) == sorted(want)


def test_piece_query_equals_the_library(spark, small):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    want = []
    for r in small_documents(spark, small):
        ids = sp.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted(map(tuple, queries.op4_sentence_pieces(spark, small).collect())) == sorted(want)


def test_token_query_equals_the_library(spark, small):
    from tokenizers import Tokenizer

    tk, start, want = Tokenizer.from_file(token_files.default_vocabulary()), 0, []
    for r in small_documents(spark, small):
        ids = [*tk.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op5_token_files(spark, small).collect())) == want


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = token_files.WordEncoder(path)
    docs = ["Two  words\n\nhere", "", "Été <|endoftext|> x"]
    ids, counts = encoder.encode([t.encode() for t in docs])
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in docs]
    assert not encoder.by_words and token_files.encoder_at(token_files.default_vocabulary()).by_words
    assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]


def test_word_memory_is_bounded():
    from gradelake.llm.common import WordIds

    words = WordIds(lambda ws: (np.array([len(w) for w in ws for _ in w], np.int32), np.array([len(w) for w in ws], np.int64)), limit=5, id_limit=40)
    for text in ("a bb ccc", "a bb ccc dddd eeeee", "q" * 50, "a bb", "zz yy xx ww vv"):
        raw = text.encode()
        data = np.frombuffer(raw + bytes(8), np.uint8)
        starts = np.array([k for k in range(len(raw)) if text[k] != " " and (k == 0 or text[k - 1] == " ")])
        ends = np.array([s + len(w) for s, w in zip(starts, text.split(), strict=True)])
        ids, n = words.ids(data, starts, ends, np.array([len(starts)]))
        assert ids.tolist() == [len(w) for w in text.split() for _ in w] and n.tolist() == [len(ids)]
        assert words.n_known <= 5 and words.used <= 40 + len(raw)


def test_quality_query_equals_brute_force(spark, small):
    docs = {r.doc_id: (r.text or "").encode() for r in small_documents(spark, small)}
    labels = spark.read.parquet(f"{small}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    limits = quality_rules.calibrated(spark.read.parquet(f"{small}/documents.parquet"), labels.withColumnRenamed("quality", "label"))
    assert limits != quality_rules.Limits()
    ratio = quality_rules.compression(limits)

    def band(n):
        return next((b.lowest, b.highest) for b in limits.bands if n < b.below)

    for r in queries.op7_quality_rules(spark, small).collect():
        t = docs[r.doc_id]
        lowest, highest = band(len(t))
        said = "base" if r.base_failed else "incompressible" if ratio(t) < lowest else "repetitive" if ratio(t) > highest else "kept"
        if said == "kept":
            bad, ends = 0, quality_rules.chunk_ends(len(t), limits)
            for a, b in zip([0, *ends], ends):
                lowest, highest = band(b - a) if b - a < 4096 else (limits.chunk_lowest, limits.chunk_highest)
                bad += not lowest <= ratio(t[a:b]) <= highest
            said = "chunks" if bad > 0.25 * max(1, len(ends)) else "kept"
        assert (r.verdict, r.kept) == (said, said == "kept")


def test_calibrated_bands_count_all_good_texts(spark):
    """Sixty long texts among 12000 are enough for a band of their own, if all count."""
    rng = random.Random(5)
    short = ["the cat sat on the mat and saw a dog by the door number %d again" % k for k in range(11940)]
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(40)]
    long = [" ".join(rng.choices(vocabulary, k=400)) for _ in range(60)]
    rows = list(enumerate(short + long))
    docs = spark.createDataFrame(rows + rows[-20:], "doc_id long, text string").repartition(4)
    limits = quality_rules.calibrated(docs, docs.select("doc_id", F.lit(1).alias("label")))
    ratio, c = quality_rules.compression(limits), quality_rules.Calibration()
    for texts in (short, long):
        ratios = sorted(ratio(t.encode()) for t in texts)
        band = next(b for b in limits.bands if len(texts[0]) < b.below)
        assert abs(band.lowest / ratios[int(c.quantile * (len(texts) - 1))] / (1 - c.slack) - 1) < 0.004
        assert abs(band.highest / ratios[int((1 - c.quantile) * (len(texts) - 1))] / (1 + c.slack) - 1) < 0.004


def test_calibrated_bands_reject_planted_junk(spark, small):
    folder = f"{small[: -len('sf0.001')]}sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "quality AS label")
    known = docs.select("doc_id", "text").join(labels, "doc_id").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    limits = quality_rules.calibrated(docs, known.filter("not held_out").select("doc_id", "label"))
    got = quality_rules.quality_rules(known.filter("held_out"), limits).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert got[got.label == 1].kept.mean() > 0.99
    assert got[got.label == 0].kept.mean() < 0.55
    random.seed(11)
    prose = [r.text for r in docs.join(labels.filter("label = 1"), "doc_id").filter("length(text) between 6000 and 9000").limit(5).collect()]
    noise = ["".join(chr(random.randint(33, 126)) + " " * (k % 9 == 0) for k in range(n)) for n in (300, 1500, 6000)]
    again = [" ".join(w for k in range(30) for w in [*p.split()[:4], str(k * 7919)]) for p in prose]
    rows = spark.createDataFrame(list(enumerate(prose + noise + again)), "doc_id long, text string")
    said = [r.verdict for r in quality_rules.quality_rules(rows, limits).orderBy("doc_id").collect()]
    assert said[: len(prose)] == ["kept"] * len(prose)
    assert said[len(prose) : len(prose) + 3] == ["incompressible"] * 3
    assert set(said[len(prose) + 3 :]) == {"repetitive"}
    assert quality_rules.calibrated(docs, labels.limit(0)) == quality_rules.Limits()


def test_empty_tables(spark):
    empty = frame(spark, AWKWARD).limit(0)
    assert sentence_pieces.encode_and_decode(empty).count() == 0
    assert quality_rules.quality_rules(empty).count() == 0
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, label int")
    assert toxicity.classify(empty, toxicity.fit(frame(spark, AWKWARD), labels.limit(0))).count() == 0
    assert quality_model.score(empty, quality_model.fit(empty, labels)).count() == 0
    assert not any(r.rejected for r in toxicity.classify(frame(spark, AWKWARD), toxicity.fit(empty, labels)).collect())
    model = language_id.fit(frame(spark, ["the cat walks", "a dog runs far"]).withColumn("lang", F.lit("en")))
    assert language_id.identify(empty, model).count() == 0


def test_trained_chain_on_awkward_rows(spark):
    random.seed(12)
    calm, rude = "river stone walked under bright morning".split(), "idiot moron pathetic loser".split()
    texts = [" ".join(random.choice(calm) for _ in range(12)) + (" " + " ".join(random.choice(rude[:2] if k % 4 else rude[2:]) for _ in range(3)) if k % 2 else "") for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, label int")
    chain = toxicity.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels)
    got = toxicity.classify(frame(spark, [*AWKWARD, "you idiot", "the river walked " * 3000], "clashes"), chain).collect()
    verdict = {r.doc_id: r.rejected for r in got}
    assert len(got) == len(AWKWARD) + 2 and verdict[len(AWKWARD)] and not any(v for k, v in verdict.items() if k != len(AWKWARD))
    assert sum(toxicity.two_kinds(np.array([[1, 0], [1, 0], [0, 1], [1, 0.1]], np.float32))) == 1


def test_language_needs_a_letter_of_category_l(spark):
    model = language_id.fit(frame(spark, ["the cat walks", "a dog runs far"]).withColumn("lang", F.lit("en")))
    got = language_id.identify(frame(spark, ["²½", "Ⅳ", "x", "ª"]), model).collect()
    assert sorted(r.nearest for r in got) == ["en", "en", "und", "und"]


def test_long_texts_join(spark):
    long = " ".join(f"w{k % 9973}x{k % 7919}" for k in range(60_000))
    rows = [(1, long), (2, long + " and a tail"), (3, long[: len(long) // 2]), (4, "a few words of another text")]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_out_of_fold_probabilities_owe_nothing_to_the_fold():
    rng = random.Random(8)
    bad, other = [f"bad{k}" for k in range(12)], [f"vile{k}" for k in range(12)]
    toxic = np.array([rng.random() < 0.4 for _ in range(300)])
    docs = [" ".join([rng.choice([f"w{k}" for k in range(60)]) for _ in range(20)] + ([rng.choice(rng.choice([bad, other])) for _ in range(4)] if t else [])) for t in toxic]
    s = toxicity.Settings()
    before = toxicity.Lesson(docs, toxic, s).out_of_fold()
    assert before.max() > 0.5
    for fold in (0, 3):
        own = np.arange(len(docs)) % s.folds == fold
        changed = toxic.copy()
        changed[own] = np.random.default_rng(fold).permutation(toxic[own])
        assert (changed != toxic).any()
        after = toxicity.Lesson(docs, changed, s).out_of_fold()
        assert np.array_equal(before[own], after[own]) and not np.array_equal(before[~own], after[~own])


def test_one_id_repeated_is_one_row_of_a_sample(spark):
    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 9).alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(spark.range(100, 150).select(F.col("id").alias("doc_id"), F.lit("other text").alias("text"), F.lit("en").alias("lang")))
    some, counts = common.sampled(docs, "lang", 200_000)
    assert counts == {"en": 100_050} and some.count() == 51
    labels = docs.select("doc_id", F.lit(1).alias("label"))
    found, _ = common.labelled_sample(docs, labels, 200_000)
    assert found.count() == 51 and found.filter("doc_id = 7").first().text == "text 0"


def test_suffix_ranges_and_buckets_have_a_bound(spark, monkeypatch):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(700))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 3000))) + (shared[rng.randint(0, 200) :] if k % 3 == 0 else "") for k in range(120)]
    want = None
    for ranges, buckets in ((1 << 17, 1 << 16), (3, 2)):
        monkeypatch.setattr(suffix_dedup, "MOST_RANGES", ranges)
        monkeypatch.setattr(suffix_dedup, "MOST_BUCKETS", buckets)
        found = suffix_dedup.remove_repeats(frame(spark, texts), 400)
        got = sorted((str(r.doc_id), [tuple(x) for x in r.spans], bytes(r.kept)) for r in found.collect())
        suffix_dedup.drop_blocks(found)
        want = want or got
        assert got == want and any(x[1] for x in got)


@pytest.mark.parametrize("block", [2, 1024])
def test_jaccard_leftovers_in_blocks(spark, block):
    rng = random.Random(10)
    base = [f"b{k}" for k in range(40)]
    texts = []
    for k in range(60):  # many texts that share most words and differ in some
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(40)] = f"x{rng.randint(0, 30)}"
        texts.append(" ".join(own))
    df = frame(spark, texts)
    s = jaccard_join.Settings(width=1, percent=80, direct=1, rounds=1, crowd=1, pivots=1, block=block)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, s).collect()}
    plain = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, jaccard_join.Settings(width=1, percent=80)).collect()}
    assert got == plain and len(set(got.values())) < 60


def test_jaccard_leftovers_of_a_region_meet_once(spark, monkeypatch):
    """Parts of the same points are one part: a point is in a row for each block, not for each block of each part."""
    rng = random.Random(11)
    texts = []
    for _ in range(90):  # all share most words, none links with many
        own = [f"b{k}" for k in range(40)]
        for k in rng.sample(range(40), 9):
            own[k] = f"x{rng.randint(0, 400)}"
        texts.append(" ".join(own))
    texts += [t + " more" for t in texts[:10]]
    df, direct, rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), jaccard_join._direct_pairs, []

    def counted(members, s):
        if "block" in members.columns:
            rows.append(members.count())
        return direct(members, s)

    monkeypatch.setattr(jaccard_join, "_direct_pairs", counted)
    s = jaccard_join.Settings(width=1, percent=80, direct=1, rounds=1, crowd=1, pivots=1, block=25)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, s).collect()}
    sets = [set(t.split()) for t in texts]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root))
    assert rows and max(rows) <= 2 * len(texts) * -(-len(texts) // 25)


def test_jaccard_large_parts_of_one_pivot_are_cut_once(spark, monkeypatch):
    """What is cut by size grows with the points, not with the parts that a point is in; the links stay those of all pairs."""
    rng = random.Random(12)
    texts = []
    for _ in range(80):  # all share most words, none links with many
        own = [f"b{k}" for k in range(40)]
        for k in rng.sample(range(40), 9):
            own[k] = f"x{rng.randint(0, 400)}"
        texts.append(" ".join(own))
    texts += [t + " more" for t in texts[:10]]
    df, by_size, rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), jaccard_join._by_size, []

    def counted(large, s):
        rows.append(large.count())
        return by_size(large, s)

    monkeypatch.setattr(jaccard_join, "_by_size", counted)
    s = jaccard_join.Settings(width=1, percent=80, direct=16, rounds=1, crowd=1, pivots=1)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, s).collect()}
    sets = [set(t.split()) for t in texts]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root))
    assert rows and max(rows) <= 3 * len(texts), rows


def test_jaccard_links_are_followed_once(spark, monkeypatch):
    """Components of later steps start from a tree of what was known: the links so far aren't followed again in each."""
    rng = random.Random(13)
    base, texts = [f"b{k}" for k in range(40)], []
    for _ in range(70):  # a family with many links, and texts that link with few
        own = list(base)
        for k in rng.sample(range(40), rng.randint(0, 8)):
            own[k] = f"x{rng.randint(0, 30)}"
        texts.append(" ".join(own))
    df, components, edges = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), jaccard_join.components, []

    def counted(links, files=None):
        edges.append({(bytes(r.a), bytes(r.b)) for r in links.collect()})
        return components(links, files)

    monkeypatch.setattr(jaccard_join, "components", counted)
    s = jaccard_join.Settings(width=1, percent=80, direct=1, rounds=2, crowd=1, pivots=1, block=25)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, s).collect()}
    sets = [set(t.split()) for t in texts]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root))
    most = max(edges, key=len)
    after = edges[edges.index(most) + 1 :]
    assert len(most) > len(texts) and after and all(2 * len(e) <= len(most) for e in after), [len(e) for e in edges]


def test_linked_points_live_in_regions_of_pivots(spark):
    """At sf0.01 nine tenths of the points that link are at home with a sampled pivot."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    s = jaccard_join.Settings(width=4, percent=85)
    pivots = jaccard_join.sampled_pivots(docs, docs.count(), s)
    sets = {jaccard_join.key_of(t): t for t in jaccard_join.shingle_sets([(r.text or "").encode() for r in docs.collect()], s.width)}
    keys, own = list(sets), list(sets.values())
    home, _ = pivots.regions(own)
    every = jaccard_join.Pivots.__new__(jaccard_join.Pivots)
    every.percent = s.percent
    every._index(own)
    a, b, both = every.common(own)
    sizes = np.array([len(t) for t in own])
    near = (a != b) & (100 * both >= s.percent * (sizes[a] + sizes[b] - both))
    linked = np.unique(a[near])
    assert len(linked) > 3 and home[linked].mean() >= 0.9 and len(keys) == len(own)
