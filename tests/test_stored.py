"""What is kept in the shared storage: stored signatures, indexes, snapshots, raw messages, state, partitions, functions, runs."""

import collections
import dataclasses
import itertools
import os
import random
import re
import time
from datetime import datetime, timedelta
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from gradelake.operators import dedup, partitions, search, seen, writes
from gradelake.operators.indexes import LONG_WORD, TrigramIndex, VectorIndex, WordIndex
from gradelake.operators.snapshots import Snapshots
from gradelake.plans import functions
from gradelake.plans.academic import academic, view
from gradelake.plans.queries import QUERIES
from gradelake.sources import mailbox
from gradelake.sources.folders import new_folder
from gradelake.streaming import memory, runs


def signed(spark, small, name):
    sign, scheme = {"simhash": (dedup.simhash, seen.SIMHASH), "minhash": (dedup.minhash, seen.MINHASH)}[name]
    rows = sign(spark.read.parquet(f"{small}/documents.parquet"), "doc_id", "text").collect()
    return [(r.doc_id, r[name]) for r in rows], scheme, "long" if name == "simhash" else "array<long>"


def near_pairs(rows, differ):
    classes = {}
    for k, x in sorted(rows):
        classes.setdefault(x if isinstance(x, int) else tuple(x), k)
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() if isinstance(a, int) else sum(x != y for x, y in zip(a, b))
    pairs = {(min(a, b), max(a, b), apart(x, y)) for (x, a), (y, b) in itertools.combinations(classes.items(), 2) if apart(x, y) <= differ}
    return pairs, {(k, classes[x if isinstance(x, int) else tuple(x)]) for k, x in rows}


@pytest.mark.parametrize(("name", "limit"), [("simhash", 4096), ("simhash", 4), ("minhash", 4096), ("minhash", 4)])
def test_batches_give_the_pairs_of_one_run(spark, small, name, limit):
    rows, scheme, kind = signed(spark, small, name)
    want, members = near_pairs(rows, scheme.differ)
    store = seen.SeenStore(spark, new_folder(spark, "seen"), dataclasses.replace(scheme, limit=limit))
    frame = lambda own: spark.createDataFrame(own, f"doc_id long, sig {kind}")
    third = len(rows) // 3
    rows = sorted(rows)
    batches = [rows[:third], rows[third : 2 * third], [], rows[2 * third :]]
    got = set()
    for n, own in enumerate(batches):
        pairs = {tuple(r) for r in store.add(frame([*own, (None, None)]), "doc_id", "sig", n).collect()}
        if n == 1:  # taken again, it gives the same
            assert {tuple(r) for r in store.add(frame(own), "doc_id", "sig", n).collect()} == pairs
        got |= pairs
    assert got == want and {tuple(r) for r in store.members(len(batches)).collect()} == members


@pytest.mark.parametrize(("name", "block"), [("simhash", 65536), ("simhash", 9), ("minhash", 65536), ("minhash", 9)])
def test_batches_count_the_links_of_one_run(spark, small, name, block):
    rows, scheme, kind = signed(spark, small, name)
    base = rows[0][1]
    near = lambda k: base ^ 5 << k if name == "simhash" else [*base[:k], *range(k, k + 9), *base[k + 9 :]]
    rows = sorted([*rows, *((10_000_000 + k, near(k)) for k in range(0, 50, 2))])  # a family, in several batches
    random.Random(5).shuffle(rows)
    pairs, _ = near_pairs(rows, scheme.differ)
    store = seen.SeenStore(spark, new_folder(spark, "seen"), scheme)
    frame = lambda own: spark.createDataFrame(own, f"doc_id long, sig {kind}")
    third = len(rows) // 3
    batches = [sorted(rows)[:third], sorted(rows)[third : 2 * third], [], sorted(rows)[2 * third :]]
    for n, own in enumerate(batches):
        links = sorted(store.count(frame([*own, (None, None)]), "doc_id", "sig", n, block).collect())
        if n == 1:  # taken again, it gives the same
            assert sorted(store.count(frame(own), "doc_id", "sig", n, block).collect()) == links
    _, members = near_pairs(rows, scheme.differ)
    many = collections.Counter(k for a, b, _ in pairs for k in (a, b))
    assert {tuple(r) for r in store.linked(4).collect()} == {(k, first, many[first]) for k, first in members} and len(pairs) > 100
    with pytest.raises(ValueError, match="by add or by count"):
        store.add(frame(rows[:1]), "doc_id", "sig", 4)


@pytest.mark.parametrize("name", ["simhash", "minhash"])
def test_stored_signatures_give_a_row_a_document(spark, small, name):
    got = QUERIES[f"j13_stored_{name}"](spark, small)
    want = QUERIES[f"m02_{name}_pairs"](spark, small)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_a_dead_batch_is_not_read(spark, small, monkeypatch):
    rows, scheme, kind = signed(spark, small, "simhash")
    store = seen.SeenStore(spark, new_folder(spark, "seen"), scheme)
    frame = spark.createDataFrame(rows, f"doc_id long, sig {kind}")
    monkeypatch.setattr(store, "_pairs", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.add(frame, "doc_id", "sig", 0)
    monkeypatch.undo()
    assert store.members(1).count() == 0
    assert {tuple(r) for r in store.add(frame, "doc_id", "sig", 1).collect()} == near_pairs(rows, scheme.differ)[0]
    with pytest.raises(ValueError, match="more than one signature"):
        store.add(spark.createDataFrame([(rows[0][0], 12345)], f"doc_id long, sig {kind}"), "doc_id", "sig", 2)


def test_vector_index_recall_and_pruning(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(-1, None), (-2, [0.0] * 64), (-3, [1.0]), (-4, [None] + [1.0] * 63)], "vec_id long, embedding array<float>")
    index = VectorIndex(spark, new_folder(spark, "vectors")).build(vectors.unionByName(odd), "vec_id", "embedding")
    assert spark.read.parquet(f"{index.folder}/cells").count() == vectors.count() + 4
    asked = vectors.filter("vec_id % 10 = 0")
    exact = {(r.query_id, r.match_id): r.score for r in search.cosine_topk(asked, vectors, "vec_id", "embedding").collect()}
    found = index.search(asked, "vec_id", "embedding")
    got = {(r.query_id, r.match_id): r.score for r in found.collect()}
    assert len(exact.keys() & got.keys()) >= 0.9 * len(exact) and all(abs(exact[k] - got[k]) < 2e-6 for k in exact.keys() & got.keys())
    cells = len(spark.read.parquet(f"{index.folder}/centers").collect())
    every = {(r.query_id, r.match_id) for r in index.search(asked, "vec_id", "embedding", probes=cells).collect()}
    assert every == exact.keys()
    one = index.search(vectors.filter("vec_id = 0"), "vec_id", "embedding", probes=3)
    plan = one._jdf.queryExecution().toString()
    read = re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(([\d,]+)\)", plan)[1]
    assert len(read.split(",")) == 3
    assert index.search(odd, "vec_id", "embedding").count() == 0
    assert VectorIndex(spark, new_folder(spark, "vectors")).build(vectors.limit(0), "vec_id", "embedding").search(asked, "vec_id", "embedding").count() == 0


def test_word_index_scores_like_the_scan(spark):
    random.seed(21)
    word = lambda: "".join(random.choice("abc1") for _ in range(random.choice([1, 2, 3, 4, 5, 6, 7, 8, LONG_WORD - 2, LONG_WORD, LONG_WORD + 3])))
    stock = [word() for _ in range(60)]
    said = lambda: " ".join(random.choice(stock) for _ in range(random.randint(0, 4)))
    rows = [(k, said(), said() if k % 7 else None) for k in range(150)] + [(None, "abc abc", "ABC-abc")]
    docs = spark.createDataFrame(rows, "id long, usn string, name string")
    index = WordIndex(spark, new_folder(spark, "words")).build(docs, "id", ["usn", "name"])
    asked = []
    for k in range(25):
        own = list(random.choice(stock))
        for _ in range(random.randint(0, 3)):
            at = random.randrange(len(own) + 1)
            own[at : at + random.randint(0, 1)] = random.choice(["", "a", "x"])
        asked.append((k, "".join(own) + (" ABC abc" if k % 5 == 0 else "")))
    boosts = {"usn": 2.0, "name": 1.0}
    got = index.search(spark.createDataFrame([*asked, (99, None), (98, " -- ")], "q long, said string"), "q", "said", boosts).collect()
    want = set()
    for k, text in asked:
        terms = [t for t in re.split("[^a-z0-9]+", text.lower()) if t]
        want |= {(k, r.id, r.score) for r in search.text_search(docs, "id", boosts, terms).collect()}
    assert {(r.query_id, r.key, r.score) for r in got} == want
    none = WordIndex(spark, new_folder(spark, "words")).build(docs.limit(0), "id", ["usn", "name"])
    assert none.search(spark.createDataFrame(asked, "q long, said string"), "q", "said", boosts).count() == 0
    best = index.search(spark.createDataFrame(asked, "q long, said string"), "q", "said", boosts, 2).groupBy("query_id").count().collect()
    assert max(r["count"] for r in best) == 2


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_trigram_index_equals_brute_force(spark, percent):
    random.seed(22)
    names = ["", "a", "Ann", "ANN ", "ann lee", "Anne Lee", None, "x" * 300] + [" ".join(random.choice(["Ann", "Anne", "Lee", "Li", "Bo", "Bob"]) for _ in range(random.randint(1, 4))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    index = TrigramIndex(spark, new_folder(spark, "trigrams"), 50).build(rows, "id", "name")
    asked = [(k, n) for k, n in enumerate(names) if k % 3 == 0] + [(1000, "Annn Leee"), (1001, "zzz")]
    grams = lambda n: {("  " + n.upper() + " ")[k : k + 3] for k in range(len(n) + 1)}
    want = set()
    for (q, a), (k, b) in itertools.product(asked, enumerate(names)):
        if a is not None and b is not None:
            both, every = len(grams(a) & grams(b)), len(grams(a) | grams(b))
            if both * 100 >= percent * every:
                want.add((q, k, round(both / every, 6)))
    got = index.search(spark.createDataFrame(asked, "id long, name string"), "id", "name", percent)
    assert {tuple(r) for r in got.collect()} == want
    assert TrigramIndex(spark, new_folder(spark, "trigrams"), 50).build(rows.limit(0), "id", "name").search(rows, "id", "name", percent).count() == 0
    with pytest.raises(ValueError, match="50 per cent"):
        index.search(rows, "id", "name", 40)


def test_trigrams_are_not_compared_where_names_meet(spark):
    words = [f"{a}{b} number {a * b % 97}" for a in range(30) for b in range(9)]
    words += [" ".join(words[:40]), " ".join(words[1:41]), " ".join(words[60:100])]  # more trigrams than there are bits
    rows = spark.createDataFrame(list(enumerate(words)), "id long, name string")
    found = TrigramIndex(spark, new_folder(spark, "trigrams")).build(rows, "id", "name").search(rows, "id", "name", 80)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Join" in line and "array_intersect" in line]
    grams = [{f"  {w.upper()} "[k : k + 3] for k in range(len(w) + 1)} for w in words]
    want = {(a, b) for a, x in enumerate(grams) for b, y in enumerate(grams) if len(x & y) * 100 >= len(x | y) * 80}
    assert {(r.query_id, r.match_id) for r in found.collect()} == want


def test_equal_names_are_posted_once(spark):
    rows = spark.createDataFrame([(k, f"Customer {k % 5}") for k in range(50)], "id long, name string")
    index = TrigramIndex(spark, new_folder(spark, "trigrams"), 50).build(rows, "id", "name")
    one = TrigramIndex(spark, new_folder(spark, "trigrams"), 50).build(rows.limit(5), "id", "name")
    assert spark.read.parquet(f"{index.folder}/postings").count() == spark.read.parquet(f"{one.folder}/postings").count()
    got = {(r.query_id, r.match_id) for r in index.search(rows.filter("id < 2"), "id", "name", 100).collect()}
    assert got == {(q, k) for q in (0, 1) for k in range(50) if k % 5 == q}


def test_saved_records_are_extracted_once(spark, small):
    from gradelake.plans import stores

    plan = stores.k10_saved_records(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # the plan reads what one job has extracted, however often it needs it


def files_of(store):
    return {x for _, _, names in os.walk(store.folder.removeprefix("file://") + "/data") for x in names if x.startswith("part-")}


def test_snapshots_touch_only_their_buckets(spark, monkeypatch):
    store = Snapshots(spark, new_folder(spark, "store"), "k int, v string", ["k"], {"v": writes.newest}, buckets=16)
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    assert store.read().count() == 0 and store.versions() == []
    assert store.upsert(frame([(k, "a") for k in range(200)] + [(None, "n")]), "one") == 1
    first, before = store.manifest(), files_of(store)
    assert store.upsert(frame([(3, "b"), (None, "m"), (1000, "new")]), "two") == 2
    second = store.manifest()
    moved = {b for b in second["files"] if first["files"].get(b) != second["files"][b]}
    assert 1 <= len(moved) <= 3 and before <= files_of(store) and len(files_of(store) - before) <= 3
    want = {(k, "b" if k == 3 else "a") for k in range(200)} | {(None, "m"), (1000, "new")}
    assert {tuple(r) for r in store.read().collect()} == want
    assert store.upsert(frame([(3, "b"), (None, "m"), (1000, "new")]), "two") == 2 and store.versions() == [1, 2]
    assert {tuple(r) for r in store.read(version=1).collect()} == {(k, "a") for k in range(200)} | {(None, "n")}
    assert {tuple(r) for r in store.lookup(frame([(3, ""), (None, ""), (777, "")])).collect()} == {(3, "b"), (None, "m")}
    # A writer that dies leaves the table as it was; so does a batch that changes a key twice.
    monkeypatch.setattr(store, "_publish", lambda manifest: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.upsert(frame([(3, "lost")]), "three")
    monkeypatch.undo()
    with pytest.raises(Exception, match="more than once"):
        store.upsert(frame([(3, "x"), (3, "y")]), "four")
    assert {tuple(r) for r in store.read().collect()} == want
    # Of two writers from one version the second fails.
    store.upsert(frame([(4, "c")]), "five")
    with pytest.raises(RuntimeError, match="another"):
        store._publish({**second, "version": 3})
    assert store.cleared(keep=1) >= 3 and {tuple(r) for r in store.read().collect()} == {(k, "c" if k == 4 else v) for k, v in want}
    assert store.upsert(frame([]), "none") == 4 and store.read().count() == 202


def mail(k, body="hello", **heads):
    m = EmailMessage()
    m["Message-ID"], m["Subject"], m["From"], m["To"] = f"<m{k}@x>", heads.get("subject", "Büro ✓"), "Ann <ann@x>", "a@x, B <b@x>"
    if k:
        m["In-Reply-To"], m["References"] = f"<m{k - 1}@x>", f"<r@x> <m{k - 1}@x>"
    m.set_content(body)
    return m


def test_mailbox_table(spark, tmp_path):
    spark.dataSource.register(mailbox.MailboxSource)
    nested = mail(1)
    nested.add_attachment(mail(7, "inner text"))
    nested.add_attachment(b"12345", maintype="application", subtype="pdf", filename="märks.pdf")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.eml").write_bytes(bytes(nested))
    (tmp_path / "bad.eml").write_bytes(b"no header at all\nContent-Type: multipart/mixed; boundary=zz\n\n--yy\nx")
    (tmp_path / "empty.eml").write_bytes(b"")
    (tmp_path / "odd.eml").write_bytes(b"Subject: =?nope?q?x?=\nContent-Type: text/plain; charset=nope\n\n\xff\xfe ok")
    (tmp_path / "other.txt").write_text("From nothing")
    got = {r.file: r for r in spark.read.format("mailbox").load(f"file://{tmp_path}").collect()}
    assert set(got) == {"a/one.eml", "bad.eml", "odd.eml"}  # a file without bytes has no message
    one = got["a/one.eml"]
    assert (one.message_id, one.in_reply_to, one.references, one.subject, one.body.strip(), one.nested) == ("m1@x", "m0@x", ["r@x", "m0@x"], "Büro ✓", "hello", 1)
    assert [tuple(a) for a in one.attachments] == [("märks.pdf", "application/pdf", 5)] and one.recipients == ["a@x", "b@x"] and one.problem is None
    assert got["bad.eml"].message_id is None and got["bad.eml"].problem and "ok" in got["odd.eml"].body


def test_mailbox_stream_resumes_at_its_offsets(spark, tmp_path):
    spark.dataSource.register(mailbox.MailboxSource)
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()

    def run():
        stream = spark.readStream.format("mailbox").load(f"file://{inbox}").select("file", "message_id")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.message_id for r in spark.read.schema("message_id string").parquet(out).collect())

    append = lambda k: (inbox / "box.mbox").open("ab").write(b"From a@b Mon\n" + bytes(mail(k, "x\n>From y")) + b"\n\n")
    append(0)
    (inbox / "z.eml").write_bytes(bytes(mail(1)))
    assert run() == ["m0@x", "m1@x"] == run()
    append(2)
    append(3)
    (inbox / "a.eml").write_bytes(bytes(mail(4)))  # earlier by name, later in time
    assert run() == [f"m{k}@x" for k in range(5)] == run()


def test_mailboxes_are_cut_anywhere():
    random.seed(23)
    parts, want = [], []
    for k in range(50):
        body = "\n".join(random.choice(["hello", "From me", "", ">From x", "line"]) for _ in range(random.randint(0, 30)))
        quoted = re.sub(r"(?m)^(>*From )", r">\1", body)
        want.append(f"Message-ID: <m{k}@x>\n\n{body}".encode().rstrip())
        parts.append(f"From a@b Mon\nMessage-ID: <m{k}@x>\n\n{quoted}\n\n")
    raw = "".join(parts).encode()
    for step in (1, 7, 100, 10**6):
        cuts = [mailbox.raw_messages(lambda a, b: raw[a : max(a, b)], at, min(at + step, len(raw)), len(raw)) for at in range(0, len(raw), step)]
        assert [m.rstrip() for cut in cuts for _, m in cut] == want


def test_small_files_share_a_task(monkeypatch):
    monkeypatch.setattr(mailbox, "SLICE_BYTES", 100)
    sizes = {f"{k}.eml": 30 for k in range(10)} | {"box.mbox": 250, "large.eml": 500}
    got = mailbox.bundled(mailbox.slices_of({"0.eml": 30, "box.mbox": 20}, sizes))
    assert [x for b in got for x in b.slices] == mailbox.slices_of({"0.eml": 30, "box.mbox": 20}, sizes)
    assert [len(b.slices) for b in got] == [3, 3, 3, 1, 1, 1, 1] and len(mailbox.bundled([])) == 1


def test_memory_expires(spark, tmp_path):
    spark.conf.set(*memory.STORE)
    kind = "run_id string, key string, value string, ts timestamp"
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)

    def run(*rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        out = memory.remembered(stream, timedelta(hours=1)).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        out.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    try:
        run(("r1", "a", "1", at(0)), ("r1", "b", "2", at(30)), ("r2", "a", "9", at(1)))
        run(("r1", "c", "3", at(70)), ("r1", "b", None, at(75)), ("r1", "c", "4", at(80)))
        run(("r3", "z", "0", at(300)))
        run(("r3", "z", "1", at(301)))
    finally:
        spark.conf.unset(memory.STORE[0])
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    noted = {(r.run_id, r.key, r.value): list(r.remembered) for r in rows if r.kind != "expired"}
    assert noted[("r1", "b", "2")] == ["a=1", "b=2"] and noted[("r1", "c", "3")] == ["b=2", "c=3"]  # a is an hour old at 1:00
    assert noted[("r1", "b", None)] == ["c=3"] and noted[("r1", "c", "4")] == ["c=4"] and noted[("r3", "z", "1")] == ["z=1"]
    gone = {(r.run_id, r.key, r.value, tuple(r.remembered)) for r in rows if r.kind == "expired"}
    assert ("r1", "c", "4", ()) in gone and ("r2", "a", "9", ()) in gone and not any(r[0] == "r3" for r in gone)


def test_months_are_pruned_at_run_time(spark, small):
    folder = new_folder(spark, "by-month")
    orders = spark.read.parquet(f"{small}/orders.parquet")
    partitions.write_by_month(orders, "o_orderdate", f"{folder}/orders")
    months = orders.select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    months.withColumn("term", F.when(F.col("month") == 3, "x").otherwise("y")).write.parquet(f"{folder}/calendar")
    wanted = spark.read.parquet(f"{folder}/calendar").filter("term = 'x' and year = 1996")
    found = partitions.in_months(spark, f"{folder}/orders", wanted)
    assert found.count() == orders.filter("year(o_orderdate) = 1996 and month(o_orderdate) = 3").count() > 0
    rows = found.select("o_orderkey")
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    assert min(_metric(plan, "numFiles")) == 1


def _metric(plan, name):
    """The values of a metric over all nodes of a plan that ran."""
    out, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            waiting.append(node.plan())
        found = node.metrics().get(name)
        if found.isDefined():
            out.append(found.get().value())
        children = node.children().iterator()
        while children.hasNext():
            waiting.append(children.next())
    return out


def test_functions_in_sql(spark):
    assert set(functions.register(spark)) >= {"grade_of_marks", "gpa_of", "message_rows", "bar_rows"}
    one = spark.sql("SELECT grade_of_marks(55, 100) AS a, grade_of_marks(5, 0) AS b, points_of_grade(' a+ ') AS c, grade_of_points(8.5) AS d, gpa_of(array(8D, 0D), array(4, 3)) AS e, usn_in('of 1ms21cs001.') AS f, usn_in('x') AS g").first()
    assert tuple(one) == ("B", "F", 9.0, "A", 4.57, "1MS21CS001", None)
    text = "a | b\\n# note | x\\n\\n1 | 2 | 0.5\\n| |\\n3 | 7"
    rows = spark.sql(f"SELECT * FROM bar_rows('{text}')").collect()
    assert [tuple(r) for r in rows] == [(0, ["a", "b"], 1.0), (3, ["1", "2"], 0.5), (5, ["3", "7"], 1.0)]
    assert spark.sql("SELECT * FROM message_rows(NULL)").count() == 0


def test_tools(spark, small):
    data = academic(spark, small)
    usn = view(spark, small, "students").orderBy("usn").first().usn
    assert functions.call("student_lookup", data, usn=usn.lower()).count() == 1
    assert functions.call("gpa_compute", data, usn=usn).filter("semester is null").count() == 1
    assert functions.call("query_db", data, sql="SELECT count(*) AS n FROM students").first().n == data.students.count()
    assert functions.listed(spark).count() == len(functions.TOOLS)
    for name, arguments, wrong in (("nothing", {}, ValueError), ("gpa_compute", {}, ValueError), ("gpa_compute", {"usn": 5}, ValueError), ("backlogs", {"x": 1}, ValueError), ("query_db", {"sql": "DROP TABLE students"}, ValueError)):
        with pytest.raises(wrong):
            functions.call(name, data, **arguments)


def test_runs_are_kept(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    counters = runs.by_status("event_type", ["click", "error"])
    got = runs.counted(events, counters, lambda rows: rows.write.parquet(f"{tmp_path}/events"))
    assert got["rows"] == events.count() and got["status_click"] == events.filter("event_type = 'click'").count()
    folder, listener = f"{tmp_path}/runs", None
    listener = runs.RunListener(spark, folder)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
        seen_ = stream.observe("counters", *(c.alias(n) for n, c in counters.items()))
        seen_.writeStream.queryName("copy").format("noop").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
        bad = stream.withColumn("x", F.raise_error(F.lit("broken")).cast("string")).writeStream.queryName("bad").format("noop").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="broken"):
            bad.awaitTermination()
        for _ in range(100):
            state = {r.name: r for r in runs.state_of(spark, folder).collect()} if os.path.exists(folder) else {}
            if {r.status for r in state.values()} == {"finished", "failed"}:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert state["copy"].status == "finished" and state["copy"].rows_in == got["rows"] and f'"rows":{got["rows"]}' in state["copy"].counters
    assert state["bad"].status == "failed" and "broken" in state["bad"].error
