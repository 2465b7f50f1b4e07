"""Mixing sources to target weights by systematic sampling.

Every source has a weight; together the sources shall give a share of all words, dealt by weight, but no source more than
``most`` times its own words (what is above goes to the others by weight, until none is above). A document's expected
copies are its source's target over its source's words. Expected copies are summed up in the source's order, one random
offset a source is added, and a document is taken once for each whole number its stretch of the sum crosses.

The order within a source is by size, then by id: neighbours have nearly the same size, so that the words taken differ
from the target by no more than about the largest document. The sums run over any number of tasks: rows are dealt by
range of (source, size, id), each range sums its own rows, and the sums before it are added afterwards. Only the sources'
weights are settled by rounds of one sum each; they, the sources' words and the ranges' sums are small tables.

Defined results: columns of documents named source_size, target or copies are replaced; a null text has size 0; a null source is a source of its own, the last one; documents of size 0 take part
and take no words; rows with equal ids and sizes are told apart by their other columns, equal rows get any of their
places; a source without words has target 0 and takes nothing; an empty table gives an empty result. Expected copies are
kept to nine digits. A run with the same seed gives the same result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.common import written

#: One copy, in the units that expected copies are kept in.
COPY = 10**9


def words(text: Column) -> Column:
    """How many runs of other than white space a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def sums_before(rows: DataFrame, group: str, value: Column, order: list[Column], name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same ``group`` (null is one) that stand before, as ``name``.

    Rows are dealt by range of (group, order), so a group of any size lies in as many tasks as it needs; rows that are
    equal in all of that are split too. The dealt rows are written once: all sums are of the same ranges.
    """
    part, tie, own, total, base = (f"{x}_{uuid.uuid4().hex[:8]}" for x in ("part", "tie", "own", "total", "base"))
    dealt = rows.withColumn(own, value).withColumn(tie, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(F.col(group).asc_nulls_last(), *order, F.col(tie)).withColumn(part, F.spark_partition_id())
    dealt = written(dealt, "dealt")
    inside = Window.partitionBy(group, part).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range and group in it.
    ranges = dealt.groupBy(group, part).agg(F.sum(own).alias(total))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col(group).alias(f"{group}_{base}"), F.col(part).alias(f"{part}_{base}"), F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(base))
    same = F.col(group).eqNullSafe(F.col(f"{group}_{base}")) & (F.col(part) == F.col(f"{part}_{base}"))
    summed = dealt.withColumn(name, F.coalesce(F.sum(own).over(inside), F.lit(0)))
    return summed.join(ranges, same).withColumn(name, F.col(name) + F.col(base)).select(*rows.columns, name)


def ranked(sources: DataFrame, column: str, name: str) -> DataFrame:
    """``sources`` with each row's place (from 0) in the order of ``column``, null last."""
    one = sources.withColumn("all_", F.lit(0))
    return sums_before(one, "all_", F.lit(1).cast("long"), [F.col(column).asc_nulls_last()], name).drop("all_")


def targets(sources: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``sources`` (with words and weight) with the words that each shall give: ``share`` (a fraction) of all, by weight.

    A source gives ``most`` times its words at most; each round shares out again what others can't give. All sources
    give their most where the share is above what there is.
    """
    above, below = share
    every = sources.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).head()
    wanted, full_words, full_weight = above * every.n, 0, 0  # in units of 1 / below words
    while True:
        left, weight = wanted - below * full_words, every.w - full_weight
        by_weight = F.col("weight") * F.lit(left) / F.lit(below * weight) if weight else F.lit(float("inf"))
        is_full = by_weight >= most * F.col("words")
        now = sources.agg(F.coalesce(F.sum(F.when(is_full, most * F.col("words"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(is_full, F.col("weight"))), F.lit(0)).alias("w")).head()
        if now.w <= full_weight:
            return sources.withColumn("target", F.least(by_weight, (most * F.col("words")).cast("double")))
        full_words, full_weight = now.n, now.w


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 0, source: str = "source", size: str = "size", key: str = "doc_id") -> DataFrame:
    """``docs`` (with ``size``, ``source``, ``key``) with source_size, target and how many copies the mix takes (0 to ``most``).

    Sources in code-point order, null last, weigh ``weights``, repeating.
    """
    own = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    plain = docs.select(F.struct(*own).alias("row"), F.col(key).alias("its_key"), F.col(source).alias("of_source"), F.col(size).cast("long").alias("of_size"))
    sources = written(plain.groupBy("of_source").agg(F.sum("of_size").alias("words")), "sources", 1)
    weight = F.element_at(F.array(*(F.lit(x).cast("long") for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    dealt = targets(written(ranked(sources, "of_source", "place").withColumn("weight", weight), "weights", 1), share, most)
    dealt = dealt.select(F.col("of_source").alias("its_source"), F.col("words").alias("source_size"), "target", offset(F.col("of_source"), seed).alias("offset"))
    rows = plain.join(dealt, F.col("of_source").eqNullSafe(F.col("its_source"))).drop("its_source")
    expected = F.coalesce(F.round(F.try_divide(F.col("target"), F.col("source_size").cast("double")) * COPY).cast("long"), F.lit(0))
    rows = rows.withColumn("expected", F.least(expected, F.lit(most * COPY)))
    summed = sums_before(rows, "of_source", F.col("expected"), [F.col("of_size"), F.col("its_key").asc_nulls_last(), F.xxhash64("row")], "before")
    start = (F.col("before") + F.col("offset")) % COPY
    return summed.select("row.*", "source_size", "target", F.floor((start + F.col("expected")) / COPY).alias("copies"))


def offset(source: Column, seed: int) -> Column:
    """The source's random offset, from 0 to one copy."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % COPY


def emitted(mix: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it was taken, numbered from 0 by ``copy``."""
    return mix.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
