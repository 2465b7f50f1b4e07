"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm import (
    chat_format,
    collocations,
    decontaminate,
    jaccard_join,
    language_id,
    mixture,
    quality_model,
    quality_rules,
    sentence_pieces,
    spelling,
    suffix_dedup,
    token_files,
    toxicity,
)
from gradelake.llm.common import crc32_mod, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs.filter(crc32_mod("doc_id", 5) != 0))
    held_out = F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("nearest").alias("lang_pred"), "score", (F.col("lang") == language_id.UNKNOWN).alias("rejected"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once repeated strings of 400 bytes are gone."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), 400)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie inside an occurrence of a benchmark window, and the items they are from."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_OP3_SQL = r"""
WITH fold AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS re, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), re) AS w FROM documents, fold),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), re) AS w FROM benchmark, fold),
iw AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram FROM iw),
q AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
m AS (SELECT doc_id, item_id, g.n, q.p FROM q JOIN g ON q.n = g.n AND array_to_string(list_slice(w, p, p + q.n - 1), ' ') = gram),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(m.p, m.p + n)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's piece ids and of the text they decode to."""
    out = sentence_pieces.encode_and_decode(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest, read back from the written token files."""
    path = token_files.write_token_ids(table(spark, sf_dir, "documents", "doc_id", "text"))
    return token_files.read_token_ids(spark, path).select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    settings = jaccard_join.Settings(width=4, percent=85)
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"), settings)


_OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT b, root FROM r JOIN e ON a = node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) ON node = d.doc_id"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics and the compression-band verdict of every document, bands learned outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").filter(crc32_mod("doc_id", 5) != 0)
    return quality_rules.quality_rules(docs, quality_rules.calibrated(docs, labels.withColumnRenamed("quality", "label")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity chain's probabilities for every document, learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = toxicity.classify(docs, fitted_toxicity(spark, sf_dir))
    return found.withColumn("held_out", F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False)))


def fitted_toxicity(spark: SparkSession, sf_dir: str) -> toxicity.Chain:
    """The chain learned from ``labels`` whose crc32(doc_id as text) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(crc32_mod("doc_id", 5) != 0)
    return toxicity.fit(docs, labels.withColumnRenamed("toxic", "label"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings, formatted and read back."""
    ours = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{ours}'), (-1L, 1L, 'assistant', '{ours}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(extra)
    chats = chat_format.format_chats(rows).withColumns(
        {"turns": chat_format.read_turns(F.col("formatted")), "loss": chat_format.loss_text(F.col("segments"))}
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from labels outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").filter(crc32_mod("doc_id", 4) != 2)
    network = quality_model.fit(docs, labels.withColumnRenamed("quality", "label"))
    held_out = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False))
    scored = quality_model.score(docs, network)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its form and root, over runs of letters of which one in 199 is damaged."""
    counts = spelling.word_counts(table(spark, sf_dir, "documents", "doc_id", "text"), min_length=6, every=199)
    return spelling.spelling_groups(counts.filter("n >= 5"))


_OP11_SQL = r"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
  lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS tab),
runs AS (SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY doc_id, w),
hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
    lambda c, b: xor(tab[1 + (xor(c, b) & 255)], c // 256))) AS h FROM runs, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
f AS (SELECT v.word, v.n, count(near) AS n_near, arg_min(near, (-near_n, near)) AS best, max(near_n) AS best_n FROM v LEFT JOIN pairs USING (word) GROUP BY v.word, v.n),
g AS (SELECT word, n, n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM f),
r AS (SELECT word, form AS cur, 1 AS k FROM g WHERE form IS NOT NULL UNION ALL SELECT r.word, g.form, k + 1 FROM r JOIN g ON r.cur = g.word WHERE g.form IS NOT NULL),
l AS (SELECT word, arg_max(cur, k) AS root FROM r GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM g LEFT JOIN l USING (word)"""


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes, and its source's target."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    found = mixture.mixed(docs.select("doc_id", "source", mixture.words(F.col("text")).alias("size")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


_OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, sum(words) OVER () AS total, sum(w) OVER () AS all_w, coalesce(sum(words) OVER below, 0) AS full_words, coalesce(sum(w) OVER below, 0) AS full_w
  FROM s WINDOW below AS (ORDER BY words::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT coalesce(max(full_words + words), 0) AS full_words, coalesce(max(full_w + w), 0) AS full_w FROM o
  WHERE w * (3 * total - 4 * full_words) >= 4 * words * (all_w - full_w)),
t AS (SELECT o.source, o.words, least(CASE WHEN all_w > c.full_w THEN (w * (3 * total - 4 * c.full_words))::DOUBLE / (2 * (all_w - c.full_w)) ELSE 2 * o.words END, 2 * o.words)::DOUBLE AS target,
  ('0x' || substr(md5('0:' || coalesce(o.source, chr(0))), 1, 12))::BIGINT % 1000000000 AS off FROM o, c),
e AS (SELECT doc_id, size, words, target, off, CASE WHEN words = 0 THEN 0 ELSE least(round(target / words * 1000000000)::BIGINT, 2000000000) END AS x,
  row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST) - 1 AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, ((off + (k::HUGEINT * x) % 1000000000) % 1000000000 + x)::BIGINT // 1000000000 AS copies FROM e)
SELECT doc_id, size::BIGINT AS size, words::BIGINT AS source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM n"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents", "lang", "text"), 2000)


_OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, k, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, size, a, w, unnest(range(1, size)) AS k FROM c),
s AS (SELECT c.lang, c.phrase, c.size, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score FROM cuts c
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, c.k), ' ')
  JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, c.k + 1, c.size), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, size, k, unnest(range(1, size - k + 2)) AS i FROM c, (VALUES (2), (3)) t(k) WHERE k < size) GROUP BY 1, 2),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000"""


def _op9_sql() -> str:
    template = chat_format.DEFAULT
    quote = lambda s: "'" + s.replace("'", "''") + "'" if "\u001b" not in s else " || ".join(["chr(27)", *(quote(x) for x in s.split("\u001b") if x)])

    def escaped(x: str) -> str:
        for string, code in template.codes():
            x = f"replace({x}, {quote(string)}, {quote(code)})"
        return x

    fixed = len(template.turn + template.content + template.end)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {fixed} + length({escaped("role")}) + length({escaped("text")}) AS emitted,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(emitted)::BIGINT AS formatted_chars,
  bool_and(coalesce((before IS NULL AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
    OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user'), false))
    AND arg_max(role, (turn, role, text)) <> 'system' AS valid
FROM e GROUP BY conv_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name; ``pipeline`` is added where corpus_pipeline.py can be imported."""
    return {
        "op1_language_id": op1_language_id,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_decontaminate": op3_decontaminate,
        "op4_sentence_pieces": op4_sentence_pieces,
        "op5_token_files": op5_token_files,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_quality_rules": op7_quality_rules,
        "op8_toxicity": op8_toxicity,
        "op9_chat_format": op9_chat_format,
        "op10_quality_model": op10_quality_model,
        "op11_spelling_groups": op11_spelling_groups,
        "op12_source_mix": op12_source_mix,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {
        "op3_decontaminate": _OP3_SQL,
        "op6_jaccard_join": _OP6_SQL,
        "op9_chat_format": _op9_sql(),
        "op11_spelling_groups": _OP11_SQL,
        "op12_source_mix": _OP12_SQL,
        "op13_collocations": _OP13_SQL,
    }
