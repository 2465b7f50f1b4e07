"""A keyed table in the shared storage as snapshots: buckets of rows, and a manifest that says which files are the table.

Rows lie in buckets by a hash of their key. A batch of changes writes anew only the buckets that its keys fall into; all other
files stay as they are, under their names. The manifest of the next version, which names a folder for each bucket, is
written last and moved into place in one step, so a reader sees the table before a batch or after it, and a writer that
dies leaves files that no manifest names (``cleared`` deletes them). Versions are numbered: of two writers that start from
the same version one finds its number taken and fails. The manifest also names the batches that are in it: a batch taken again
changes nothing.

Defined results: a null key is a key; a key that a batch changes twice fails the batch, and the table stays as it was; an
empty batch is a version; columns that a batch doesn't have keep their values.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.operators.writes import Rule, merge_upsert
from gradelake.sources.folders import exists, file_system


class Snapshots:
    """The table in ``folder``, of rows ``schema`` with ``keys``; ``rules`` say how a change meets an old value."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], rules: dict[str, Rule] | None = None, buckets: int = 64) -> None:
        self.spark, self.folder, self.schema, self.keys, self.rules, self.buckets = spark, folder.rstrip("/"), schema, keys, rules or {}, buckets

    def _names(self, folder: str) -> list[str]:
        if not exists(self.spark, f"{self.folder}/{folder}"):
            return []
        system, at = file_system(self.spark, f"{self.folder}/{folder}")
        return sorted(x.getPath().getName() for x in system.listStatus(at))

    def versions(self) -> list[int]:
        """The numbers of all versions, oldest first."""
        return [int(x.removesuffix(".json")) for x in self._names("manifests") if x.endswith(".json") and x[0].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the newest by default: its number, its batches, each bucket's folder."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "batches": [], "files": {}}
        at = f"{self.folder}/manifests/{known[-1] if version is None else version:010d}.json"
        return json.loads(self.spark.read.text(at, wholetext=True).first().value)

    def _publish(self, manifest: dict) -> None:
        name = f"{self.folder}/manifests/{manifest['version']:010d}.json"
        system, target = file_system(self.spark, name)
        _, written = file_system(self.spark, f"{self.folder}/manifests/_{uuid.uuid4().hex}")
        out = system.create(written, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if system.exists(target) or not system.rename(written, target):
            system.delete(written, False)
            raise RuntimeError(f"version {manifest['version']} has been written by another")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the newest by default, of some buckets where they are given."""
        files = self.manifest(version)["files"]
        paths = [files[str(b)] for b in (range(self.buckets) if buckets is None else buckets) if str(b) in files]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{p}" for p in paths))

    def bucket(self) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys; only their buckets are read."""
        wanted = keys.select(*self.keys).distinct()
        own = sorted(r.b for r in wanted.select(self.bucket().alias("b")).distinct().collect())
        named = wanted.select(*(F.col(k).alias(f"wanted_{k}") for k in self.keys))
        rows = self.read(buckets=own)
        same = [rows[k].eqNullSafe(named[f"wanted_{k}"]) for k in self.keys]
        return rows.join(named, same, "left_semi")

    def upsert(self, changes: DataFrame, batch: str) -> int:
        """Take a batch of changes; gives the version that has it. A batch that is in the table already changes nothing."""
        before = self.manifest()
        if batch in before["batches"]:
            return before["version"]
        # At most as many rows as there are buckets reach the driver.
        touched = sorted(r.b for r in changes.select(self.bucket().alias("b")).distinct().collect())
        rows = merge_upsert(self.read(before["version"] or None, touched), changes, self.keys, self.rules)
        data = f"data/{before['version'] + 1:010d}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", self.bucket())
        # A bucket with very many rows is several files.
        dealt = self.spark.sql("SELECT /*+ REBALANCE(bucket) */ * FROM {dealt}", dealt=dealt)
        dealt.write.partitionBy("bucket").parquet(f"{self.folder}/{data}")
        files = before["files"] | {str(b): f"{data}/bucket={b}" for b in touched}
        self._publish({"version": before["version"] + 1, "batches": [*before["batches"], batch], "files": files})
        return before["version"] + 1

    def cleared(self, keep: int = 2) -> int:
        """Delete what the ``keep`` newest versions don't name: older manifests and their files, and those of dead writers."""
        known = self.versions()
        named = {p.split("/")[1] for v in known[-keep:] for p in self.manifest(v)["files"].values()}
        gone = [f"manifests/{v:010d}.json" for v in known[:-keep]] + [f"data/{x}" for x in self._names("data") if x not in named]
        for path in gone:
            system, at = file_system(self.spark, f"{self.folder}/{path}")
            system.delete(at, True)
        return len(gone)
