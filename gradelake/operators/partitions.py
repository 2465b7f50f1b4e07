"""Tables in folders by year and month, read for the months that another table names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_month(rows: DataFrame, time: str, folder: str) -> None:
    """``rows`` in folders by the year and month of ``time``; a row without one lies in a folder of its own."""
    dated = rows.withColumns({"year": F.year(time), "month": F.month(time)})
    # A month with very many rows is several files.
    dated = rows.sparkSession.sql("SELECT /*+ REBALANCE(year, month) */ * FROM {dated}", dated=dated)
    dated.write.partitionBy("year", "month").parquet(folder)


def in_months(spark: SparkSession, folder: str, months: DataFrame) -> DataFrame:
    """The rows of the months in ``months`` (year, month, distinct), joined with whatever else that says of them.

    ``months`` is small, a row a month at most, and is filtered while the query runs: the planner sends what is left of it to
    the scan, which opens those months' files alone.
    """
    return spark.read.parquet(folder).join(F.broadcast(months), ["year", "month"])
