"""The corpus pipeline: toxic documents go, near duplicates go, repeated passages go, benchmark text goes, pieces come.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's rows to the shared folder and reads them again, so a stage works on all its predecessor
kept and a lost executor costs no more than a stage.

Stages on an empty table return an empty table. Columns of documents beyond doc_id, text and n_chars pass through all
stages but the last, whatever their names; n_chars follows the text where the table has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm import decontaminate, jaccard_join, queries, sentence_pieces, suffix_dedup, toxicity
from gradelake.llm.common import discard, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain, learned from the labels table, doesn't reject."""
    return toxicity.keep_clean(docs, queries.fitted_toxicity(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the one with the smallest id."""
    return jaccard_join.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words, or of 400 bytes or more, that occur twice."""
    other = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    packed = docs.select("doc_id", "text", *([F.struct(*(docs[c] for c in other)).alias("carried")] if other else []))
    left = suffix_dedup.remove_repeats(packed, carry=("carried",) if other else (), whole_characters=True, n_words=51)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept").cast("string"), "n_chars": F.length(F.col("kept").cast("string")).cast("long")}
    columns |= {c: F.col("carried")[c] for c in other}
    out = left.select(*(columns[c].alias(c) for c in docs.columns))
    out.blocks_table = left.blocks_table
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids, their number and the text they decode to."""
    return sentence_pieces.encode_and_decode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: A trained model, text surgery on bytes and a tokenizer: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's rows are deleted once the next one's are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        docs = written(found, f"pipeline-{name}")
        if "blocks_table" in vars(found):
            suffix_dedup.drop_blocks(found)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
