"""Conversations: who answers whom, to any depth, and each conversation as one nested tree.

Defined results: a message without an id is a conversation of its own, each row of it; rows of one id are one message, whose
parent is the smallest that they name, and each row gets that message's result; an unknown or missing parent makes a root;
of messages that answer each other in a circle the one with the smallest id is the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.sources.folders import file_system, new_folder


class _Rounds:
    """Tables of one round after another in a folder of their own; a round's table goes once the next is written."""

    def __init__(self, messages: DataFrame, label: str) -> None:
        self.spark, self.folder, self.n = messages.sparkSession, new_folder(messages.sparkSession, label), 0

    def keep(self, rows: DataFrame) -> DataFrame:
        """``rows``, written and read again."""
        self.n += 1
        rows.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{self.n}")

    def drop(self, *rounds: int) -> None:
        """Delete the tables of these rounds."""
        for n in rounds:
            system, at = file_system(self.spark, f"{self.folder}/{n}")
            system.delete(at, True)


def _followed(nodes: DataFrame, rounds: _Rounds) -> tuple[DataFrame, bool]:
    """(id, up, steps, least, moved) once pointers have been doubled until none moves, or they have gone in circles.

    ``least`` is the smallest id on the way from a message up to, but without, the one it points at.
    """
    at = nodes.select("id", F.coalesce("parent", "id").alias("up"), F.col("parent").isNotNull().cast("long").alias("steps"), F.col("id").alias("least"), F.col("parent").isNotNull().alias("moved"))
    at = rounds.keep(at)
    while True:
        n, moving, most = at.agg(F.count("*"), F.max("moved"), F.max("steps")).first()
        if not moving or most > 2 * n:
            return at, bool(moving)
        over = at.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("least").alias("other"))
        doubled = at.join(over, "up").select("id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.least("least", F.when(F.col("more") > 0, F.col("other"))).alias("least"), (F.col("more") > 0).alias("moved"))
        at = rounds.keep(doubled)
        rounds.drop(rounds.n - 1)


def linked(messages: DataFrame, key: str, parent: str) -> DataFrame:
    """(id, parent, root, depth), one row for each distinct id; the parent is null where the message is a root.

    A message points at its parent; pointers are doubled until none moves, so the rounds grow with the logarithm of the
    depth, which isn't bounded. Each round is written to the shared folder.
    """
    rounds = _Rounds(messages, "threads")
    ids = messages.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(parent).alias("named"))
    known = ids.select(F.col("id").alias("known"))
    nodes = ids.join(known, ids["named"] == known["known"], "left").select("id", F.nullif("known", "id").alias("parent"))
    nodes = rounds.keep(nodes)
    at, circles = _followed(nodes, rounds)
    if circles:
        # A pointer that still moves has come to a circle; from there it has gone all around it.
        turning = at.filter("moved")
        around = turning.select(F.col("id").alias("up"), F.col("least").alias("first"))
        cut = turning.join(around, "up").select(F.col("first").alias("id")).distinct().withColumn("cut", F.lit(True))
        nodes = rounds.keep(nodes.join(cut, "id", "left").select("id", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent")))
        at, _ = _followed(nodes, rounds)
    return nodes.join(at.select("id", F.col("up").alias("root"), F.col("steps").cast("int").alias("depth")), "id")


def threads(messages: DataFrame, key: str, parent: str) -> DataFrame:
    """Every message (row) with its thread's root and its depth."""
    found = linked(messages, key, parent).select(F.col("id").alias(key), "root", "depth")
    rows = messages.select(key)
    named = rows.filter(F.col(key).isNotNull()).join(found, key).select(key, "root", "depth")
    return named.unionByName(rows.filter(F.col(key).isNull()).select(key, F.col(key).alias("root"), F.lit(0).alias("depth")))


def reply_trees(messages: DataFrame, key: str, parent: str, order: Column, fields: list[str]) -> DataFrame:
    """(root, messages, depth, tree): each conversation as JSON, a message with ``key``, ``fields`` and its replies in ``order``.

    A message's text opens where it is entered and closes where it is left. Both are links of a list (on to the first
    reply, the next one, back to the parent) whose order comes from doubling pointers, so a tree of any depth takes as
    many rounds as the logarithm of its size, and nothing recurses. A tree is one row; its messages meet in one task. Of
    rows with one id the first in ``order`` gives the fields; a row without an id has a null root.
    """
    rounds = _Rounds(messages, "trees")
    plain = messages.select(F.col(key).alias("id"), order.alias("place"), F.struct(F.col(key), *fields).alias("said"))
    first = plain.filter("id is not null").groupBy("id").agg(F.min(F.struct("place", "said")).alias("first")).select("id", "first.place", "first.said")
    opened = lambda said: F.concat(F.expr(f"substring(to_json({said}, map('ignoreNullFields', 'false')), 1, length(to_json({said}, map('ignoreNullFields', 'false'))) - 1)"), F.lit(',"replies":['))
    nodes = linked(messages, key, parent).join(first, "id")
    among = Window.partitionBy("parent").orderBy("place", "id")
    replies = nodes.filter("parent is not null").withColumns({"after": F.lead("id").over(among), "nth": F.row_number().over(among)})
    nodes = nodes.filter("parent is null").withColumns({"after": F.nullif("id", "id"), "nth": F.lit(1)}).unionByName(replies)
    nodes = rounds.keep(nodes.select("id", "parent", "root", "depth", "after", "nth", opened("said").alias("text")))
    reply = nodes.filter("parent is not null and nth = 1").select(F.col("parent").alias("id"), F.col("id").alias("reply"))
    entered = nodes.join(reply, "id", "left").select("id", F.lit(0).alias("out"), F.coalesce("reply", "id").alias("to"), F.col("reply").isNull().cast("int").alias("to_out"))
    left = nodes.select("id", F.lit(1).alias("out"), F.coalesce("after", "parent").alias("to"), F.col("after").isNull().cast("int").alias("to_out"))
    at = rounds.keep(entered.unionByName(left).withColumn("steps", F.col("to").isNotNull().cast("long")))
    while at.filter("to is not null").limit(1).count():
        over = at.select(F.col("id").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("next"), F.col("to_out").alias("next_out"), F.col("steps").alias("more"))
        at = rounds.keep(at.join(over, ["to", "to_out"], "left").select("id", "out", F.col("next").alias("to"), F.col("next_out").alias("to_out"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        rounds.drop(rounds.n - 1)
    comma = F.when((F.col("nth") > 1) & F.col("parent").isNotNull(), ",").otherwise("")
    text = F.when(F.col("out") == 0, F.concat(comma, "text")).otherwise("]}")
    parts = at.select("id", "out", "steps").join(nodes, "id").select("root", "depth", "out", F.struct((-F.col("steps")).alias("nth"), text.alias("text")).alias("part"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["text"]), "")
    trees = parts.groupBy("root").agg(F.count_if(F.col("out") == 0).alias("messages"), F.max("depth").alias("depth"), joined.alias("tree"))
    alone = plain.filter("id is null").select(F.col("id").alias("root"), F.lit(1).cast("long").alias("messages"), F.lit(0).alias("depth"), F.concat(opened("said"), F.lit("]}")).alias("tree"))
    return trees.unionByName(alone)
