"""Indexes in the shared storage: vectors by cell, words with their misspellings, names by trigram.

Each is built once from a table, in a folder of its own, and takes many queries at once: a table of queries is joined with
what the index holds, so nothing is compared that shares no cell, word or trigram. Null ids are ids; null texts and names
match nothing; vectors that are null, hold a null or are zero lie in a cell that is never probed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradelake.operators.search import BLOCK, trigrams

#: Partitions that a word's postings may lie in.
BUCKETS = 64
#: Words of more letters have no table of variants (it grows with the square of the length); they meet by length.
LONG_WORD = 32
#: Words of 64 bits that tell a name's trigrams.
WORDS = 2


def _store(rows: DataFrame, path: str, *by: str) -> None:
    """Write ``rows`` partitioned, a large partition as several files, and their schema: a table without rows has no file that tells it."""
    rows = rows.sparkSession.sql(f"SELECT /*+ REBALANCE({', '.join(by)}) */ * FROM {{rows}}", rows=rows)
    rows.write.partitionBy(*by).parquet(path)
    rows.sparkSession.createDataFrame([(rows.schema.json(),)], "kinds string").coalesce(1).write.parquet(f"{path}-schema")


def _load(spark: SparkSession, path: str) -> DataFrame:
    kinds = StructType.fromJson(json.loads(spark.read.parquet(f"{path}-schema").first().kinds))
    return spark.read.schema(kinds).parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; vectors with nulls or of another length become rows of NaN."""
    rows = column.to_pylist()
    size = max((len(r) for r in rows if r is not None), default=0)
    return np.array([r if r is not None and len(r) == size and None not in r else [np.nan] * size for r in rows], np.float64).reshape(len(rows), size)


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which rows have a direction."""
    with np.errstate(invalid="ignore", divide="ignore"):
        norms = np.linalg.norm(rows, axis=1)
        good = np.isfinite(norms) & (norms > 0)
        return np.where(good[:, None], rows / norms[:, None], 0.0), good


def centers_of(rows: np.ndarray, n: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Directions of ``n`` cells by spherical k-means; an empty cell takes the row farthest from its own cell."""
    random = np.random.default_rng(seed)
    centers = rows[random.choice(len(rows), min(n, len(rows)), replace=False)]
    for _ in range(rounds):
        near = rows @ centers.T
        own, closeness = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centers)) == 0)
        sums[empty] = rows[np.argsort(closeness)[: len(empty)]]
        centers = _unit(sums)[0]
    return centers


def probes_for(rows: np.ndarray, centers: np.ndarray, recall: float, k: int = 10, asked: int = 256) -> int:
    """How many cells a query must read to meet ``recall`` of its ``k`` nearest rows, by the first ``asked`` rows among all."""
    q = rows[:asked]
    near = np.argsort(-(q @ rows.T), axis=1)[:, : min(k, len(rows))]
    cell = (rows @ centers.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(q @ centers.T), axis=1), axis=1)
    places = np.sort(np.take_along_axis(place, cell[near], axis=1).reshape(-1))
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1


class VectorIndex:
    """Vectors in cells, a partition each; a query reads the cells whose centers are nearest to it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, vectors: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = 20_000, recall: float = 0.95) -> VectorIndex:
        """Cells are learned from ``sample`` vectors at most (the first by a hash of their key), then every row is placed.

        About as many cells as the square root of the number of rows, 4096 at most, unless ``cells`` is given. The sample also
        tells how many cells a query has to read for ``recall``; vectors without any clusters need most of them.
        """
        rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
        n = rows.count()
        some = rows.filter("vector is not null").orderBy(F.xxhash64("key"), "key").limit(sample).select("vector").toArrow()
        matrix, good = _unit(_matrix(some.column(0).combine_chunks()))
        centers = centers_of(matrix[good], cells or min(4096, max(1, int(n**0.5)))) if good.any() else np.zeros((0, 0))
        self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "cell int, center array<double>").coalesce(1).write.parquet(f"{self.folder}/centers")
        probes = probes_for(matrix[good], centers, recall) if len(centers) else 0
        self.spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.parquet(f"{self.folder}/probes")
        sent = self.spark.sparkContext.broadcast(centers)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, good = _unit(_matrix(batch.column(1)))
                centers, cell = sent.value, np.full(len(rows), -1, np.int32)
                if len(centers) and rows.shape[1] == centers.shape[1]:
                    cell[good] = (rows[good] @ centers.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["key", "vector", "cell"])

        kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        _store(rows.mapInArrow(place, f"{kinds}, cell int"), f"{self.folder}/cells", "cell")
        return self

    def search(self, queries: DataFrame, key: str, vector: str, k: int = 10, probes: int | None = None, digits: int = 6) -> DataFrame:
        """(query_id, match_id, score, place): the ``k`` best by exact cosine among the vectors of ``probes`` cells a query.

        Without ``probes``, as many as the index's recall needs.

        Queries are a stated set, taken in blocks that are broadcast; only the cells that a block probes are read.
        """
        centers = np.array([r.center for r in self.spark.read.parquet(f"{self.folder}/centers").orderBy("cell").collect()])
        stored = _load(self.spark, f"{self.folder}/cells")
        kind = stored.schema["key"].dataType.simpleString()
        asked = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q")).filter("q is not null")
        n_blocks = max(1, -(-asked.count() // BLOCK))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
        scored = self.spark.createDataFrame([], f"query_id {kind}, match_id {kind}, score double")
        for block in range(n_blocks if len(centers) else 0):
            own = asked.filter(F.col("block") == block).orderBy("query_id").toArrow()  # about BLOCK vectors
            q, good = _unit(_matrix(own.column("q").combine_chunks())) if own.num_rows else (np.zeros((0, 0)), np.zeros(0, bool))
            if not good.any() or q.shape[1] != centers.shape[1]:
                continue
            n = min(probes or self.spark.read.parquet(f"{self.folder}/probes").first().probes, len(centers))
            near = np.argpartition(-(q @ centers.T), n - 1, axis=1)[:, :n]
            of_cell = {c: np.flatnonzero((near == c).any(axis=1) & good) for c in np.unique(near[good]).tolist()}
            sent = self.spark.sparkContext.broadcast((own.column("query_id").combine_chunks(), q, of_cell))

            def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                ids, q, of_cell = sent.value
                for batch in batches:
                    rows, cell = _unit(_matrix(batch.column(1)))[0], batch.column(2).to_numpy()
                    for c in np.unique(cell).tolist():
                        asking, here = of_cell[c], np.flatnonzero(cell == c)
                        s = np.round(rows[here] @ q[asking].T, digits)
                        n = min(len(here), k)
                        row, col = np.nonzero(s >= -np.partition(-s, n - 1, axis=0)[n - 1])
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(asking[col])), batch.column(0).take(pa.array(here[row])), pa.array(s[row, col])], names=["query_id", "match_id", "score"])

            some = stored.filter(F.col("cell").isin(sorted(of_cell))).select("key", "vector", "cell")
            scored = scored.unionByName(some.mapInArrow(score, f"query_id {kind}, match_id {kind}, score double"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id"))
        return scored.withColumn("place", place).filter(F.col("place") <= k)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")


def _allowed(word: Column) -> Column:
    """Edits that a word of a query may be away: none below three letters, one below six, else two."""
    return F.when(F.length(word) < 3, 0).when(F.length(word) < 6, 1).otherwise(2)


def variants(words: DataFrame, word: str) -> DataFrame:
    """``words`` with (deleted, variant): the hash of every string that ``deleted`` (0 to 2) letters fewer make of a word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, said in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                own = range(len(said))
                made = {("".join(said[j] for j in own if j not in gone), n) for n in (0, 1, 2) for gone in combinations(own, n)}
                rows += [(k, n, x) for x, n in made]
            which, n, made = zip(*rows, strict=True) if rows else ((), (), ())
            out = batch.take(pa.array(which, pa.int64())).columns[:-1]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n, pa.int32()), pa.array(made, pa.string())], names=[*batch.schema.names[:-1], "deleted", "made"])

    kinds = ", ".join(f"{c} {t}" for c, t in words.dtypes)
    short = words.filter(F.length(word) <= LONG_WORD).withColumn("word_", F.col(word))
    return short.mapInArrow(work, f"{kinds}, deleted int, made string").withColumn("variant", F.xxhash64("made")).drop("made")


class WordIndex:
    """Postings of the words of several fields, and for each word the strings that it and its misspellings share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, docs: DataFrame, key: str, fields: list[str]) -> WordIndex:
        """Count every word of every field and row, and make the variants of every distinct word."""
        said = F.array(*(F.struct(F.lit(f).alias("field"), _words(F.col(f)).alias("words")) for f in fields))
        rows = docs.select(F.col(key).alias("key"), F.explode(said).alias("s")).select("key", "s.field", F.explode("s.words").alias("word"))
        counted = rows.groupBy("word", "field", "key").agg(F.count("*").alias("n"))
        _store(counted.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")), f"{self.folder}/postings", "bucket")
        words = _load(self.spark, f"{self.folder}/postings").select("word").distinct()
        variants(words, "word").select("variant", "deleted", "word").write.parquet(f"{self.folder}/variants")
        words.filter(F.length("word") > LONG_WORD - 2).select("word", F.length("word").alias("size")).write.parquet(f"{self.folder}/long")
        return self

    def matches(self, queries: DataFrame, query: str, text: str) -> DataFrame:
        """(query_id, asked, times, word): the index's words within a query's words' allowed edits.

        Two words at most two edits apart become equal by deleting at most two letters of each: an equi-join on variants,
        and the distance decides. Longer words meet those of nearly the same length.
        """
        rows = queries.select(F.col(query).alias("query_id"), F.explode(_words(F.col(text))).alias("asked"))
        rows = rows.groupBy("query_id", "asked").agg(F.count("*").alias("times"))
        asked = rows.select("asked").distinct().withColumn("allowed", _allowed(F.col("asked")))
        mine = variants(asked, "asked").filter("deleted <= allowed").withColumnRenamed("deleted", "own_deleted")
        theirs = self.spark.read.parquet(f"{self.folder}/variants")
        near = mine.join(theirs, "variant").filter("deleted <= allowed").select("asked", "allowed", "word").distinct()
        long = asked.filter(F.length("asked") > LONG_WORD - 2).withColumn("size", F.explode(F.sequence(F.length("asked") - 2, F.length("asked") + 2)))
        far = long.join(self.spark.read.parquet(f"{self.folder}/long"), "size").select("asked", "allowed", "word")
        near = near.unionByName(far).filter(F.levenshtein("asked", "word") <= F.col("allowed")).select("asked", "word").distinct()
        return rows.join(near, "asked").select("query_id", "asked", "times", "word")

    def search(self, queries: DataFrame, query: str, text: str, boosts: dict[str, float], limit: int | None = None) -> DataFrame:
        """(query_id, key, score): each match counts its field's boost; the best ``limit`` of a query, ties by key."""
        bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
        found = self.matches(queries, query, text).withColumn("bucket", bucket)
        postings = _load(self.spark, f"{self.folder}/postings").filter(F.col("field").isin(list(boosts)))
        boost = F.create_map(*(F.lit(x) for f, b in boosts.items() for x in (f, float(b))))[F.col("field")]
        scored = postings.join(found, ["bucket", "word"]).groupBy("query_id", "key").agg(F.round(F.sum(F.col("times") * F.col("n") * boost), 4).alias("score"))
        if limit is None:
            return scored
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
        return scored.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


class TrigramIndex:
    """Names by their rarest trigrams: as many as one similar name at least must share."""

    def __init__(self, spark: SparkSession, folder: str, percent: int = 50) -> None:
        self.spark, self.folder, self.percent = spark, folder.rstrip("/"), percent

    def _ordered(self, names: DataFrame, name: str, percent: int) -> DataFrame:
        """(name, size, bits, at, gram): each different name's rarest trigrams of the indexed ones, those not indexed first.

        ``bits`` has a bit for each of a name's trigrams; bits that two names don't share are no more than trigrams they don't.
        """
        rows = names.select(F.col(name).alias("name")).filter("name is not null").distinct()
        counts = self.spark.read.parquet(f"{self.folder}/counts")
        grams = rows.select("name", F.explode(trigrams(F.col("name"))).alias("gram")).join(counts, "gram", "left")
        place = F.pmod(F.xxhash64("gram"), F.lit(64 * WORDS)).cast("int")
        bit = lambda k: F.when(F.floor(place / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)).otherwise(F.lit(0).cast("long"))
        sorted_grams = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")))
        own = grams.groupBy("name").agg(sorted_grams.alias("grams"), F.array(*(F.bit_or(bit(k)) for k in range(WORDS))).alias("bits"))
        own = own.withColumn("size", F.size("grams"))
        prefix = F.col("size") - F.ceil(F.col("size") * percent / 100).cast("int") + 1
        return own.select("name", "size", "bits", F.posexplode(F.slice("grams", F.lit(1), prefix)).alias("at", "g")).select("name", "size", "bits", "at", "g.gram")

    def build(self, names: DataFrame, key: str, name: str) -> TrigramIndex:
        """Count the trigrams of the different names, then post each of these under its rarest ones, and store whose it is; queries may ask for ``percent`` or more."""
        rows = names.select(F.col(key).alias("match_id"), F.col(name).alias("name")).filter("name is not null").distinct()
        rows.write.parquet(f"{self.folder}/names")
        rows.select("name").distinct().select(F.explode(trigrams(F.col("name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{self.folder}/counts")
        posted = self._ordered(rows, "name", self.percent)
        _store(posted.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")), f"{self.folder}/postings", "bucket")
        return self

    def search(self, queries: DataFrame, key: str, name: str, percent: int) -> DataFrame:
        """(query_id, match_id, similarity) of the names whose trigrams are ``percent`` per cent the same or more.

        Different names meet; whose they are is joined to what is left. Names that meet on a trigram grow with the square of
        their number, so their bits are compared there, and trigrams for what is left.
        """
        if percent < self.percent:
            raise ValueError(f"the index holds what {self.percent} per cent and more need")
        bucket = F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")
        asked = self._ordered(queries, name, percent).select(F.col("name").alias("asked"), F.col("size").alias("x"), F.col("bits").alias("own"), F.col("at").alias("i"), "gram", bucket.alias("bucket"))
        stored = _load(self.spark, f"{self.folder}/postings").select("name", F.col("size").alias("y"), "bits", F.col("at").alias("j"), "gram", "bucket")
        met = stored.join(asked, ["bucket", "gram"])
        # As long as need be, and enough trigrams left after this one to share as many as the similarity needs.
        met = met.filter((F.col("y") * 100 >= F.col("x") * percent) & (F.col("x") * 100 >= F.col("y") * percent))
        met = met.filter((1 + F.least(F.col("x") - 1 - F.col("i"), F.col("y") - 1 - F.col("j"))) * (100 + percent) >= (F.col("x") + F.col("y")) * percent)
        apart = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("own")[k])) for k in range(WORDS)), F.lit(0))
        met = met.filter(apart * (100 + percent) <= (F.col("x") + F.col("y")) * (100 - percent))
        # Sizes come from the aggregate: a filter on names alone would be moved into the join and take apart all that meet.
        tasks = 4 * self.spark.sparkContext.defaultParallelism
        pairs = met.repartition(tasks, "asked", "name").groupBy("asked", "name").agg(F.max(F.col("x") + F.col("y")).alias("sizes"))
        both = F.size(F.array_intersect(trigrams(F.col("asked")), trigrams(F.col("name"))))
        scored = pairs.select("asked", "name", both.alias("both"), (F.col("sizes") - both).alias("every"))
        near = scored.filter(F.col("both") * 100 >= F.col("every") * percent).select("asked", "name", F.round(F.col("both") / F.col("every"), 6).alias("similarity"))
        who = queries.select(F.col(key).alias("query_id"), F.col(name).alias("asked")).filter("asked is not null").distinct()
        return near.join(who, "asked").join(self.spark.read.parquet(f"{self.folder}/names"), "name").select("query_id", "match_id", "similarity")
