"""Runs and what they have done: counters observed while a job runs, and a table of the runs of streams.

Counters ride along with the rows as the job writes them (``observe``), so they cost no pass of their own and say what was
written. A listener keeps, for each stream that runs, a row when it starts, one for each batch with its counters, and one when it
ends, with the error if it failed; rows are appended to a folder, which tells how far any run has come.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

RUNS = "run_id string, name string, status string, batch long, at timestamp, rows_in long, counters map<string,long>, error string"


def by_status(status: str, known: list[str]) -> dict[str, Column]:
    """Counters of rows: all, and those of each known status and of none of these."""
    other = ~F.coalesce(F.col(status).isin(known), F.lit(False))
    return {"rows": F.count(F.lit(1)), **{f"status_{s}": F.count_if(F.col(status) == s) for s in known}, "status_other": F.count_if(other)}


def counted(rows: DataFrame, counters: dict[str, Column], write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Run ``write`` on ``rows``; gives the counters of what went through."""
    seen = Observation(f"run-{uuid.uuid4().hex}")
    write(rows.observe(seen, *(c.alias(name) for name, c in counters.items())))
    return dict(seen.get)


class RunListener(StreamingQueryListener):
    """Keeps the run table in ``folder``; counters are those that the stream observes under ``counters``."""

    def __init__(self, spark: SparkSession, folder: str, counters: str = "counters") -> None:
        self.spark, self.folder, self.counters = spark, folder, counters
        self.names: dict[str, str] = {}
        self.lock = threading.Lock()

    def _add(self, run, status: str, batch: int | None = None, rows: int | None = None, counters: dict | None = None, error: str | None = None) -> None:
        said = (str(run), self.names.get(str(run)), status, batch, datetime.now(timezone.utc), rows, counters, error)
        with self.lock:
            self.spark.createDataFrame([said], RUNS).coalesce(1).write.mode("append").parquet(self.folder)

    def onQueryStarted(self, event) -> None:
        """The run begins."""
        self.names[str(event.runId)] = event.name
        self._add(event.runId, "running")

    def onQueryProgress(self, event) -> None:
        """A batch is done."""
        progress = event.progress
        found = progress.observedMetrics.get(self.counters)
        told = {k: v for k, v in found.asDict().items() if v is not None} if found is not None else None
        self._add(progress.runId, "running", progress.batchId, progress.numInputRows, told)

    def onQueryIdle(self, event) -> None:
        """Nothing to keep."""

    def onQueryTerminated(self, event) -> None:
        """The run has ended, by itself or by an error."""
        self._add(event.runId, "failed" if event.exception else "finished", error=event.exception)


def state_of(spark: SparkSession, folder: str) -> DataFrame:
    """One row a run: its last status, when it began and ended, its batches, rows and summed counters as JSON, its error."""
    rows = spark.read.schema(RUNS).parquet(folder)
    sums = rows.select("run_id", F.explode("counters").alias("name", "n")).groupBy("run_id", "name").agg(F.sum("n").alias("n"))
    sums = sums.groupBy("run_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n"))))).alias("counters"))
    last = F.when(F.max(F.col("status") == "failed"), "failed").when(F.max(F.col("status") == "finished"), "finished").otherwise("running")
    runs = rows.groupBy("run_id").agg(
        F.max("name").alias("name"), last.alias("status"), F.min("at").alias("began"), F.max(F.when(F.col("status") != "running", F.col("at"))).alias("ended"),
        F.count_distinct("batch").alias("batches"), F.coalesce(F.sum("rows_in"), F.lit(0)).alias("rows_in"), F.max("error").alias("error"),
    )
    return runs.join(sums, "run_id", "left").withColumn("counters", F.coalesce("counters", F.lit(json.dumps({}))))
