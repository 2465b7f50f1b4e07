"""Where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='academic-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset, a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or _local_folder()).rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The file system of ``path`` and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``."""
    system, at = file_system(spark, path)
    return system.exists(at)


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own among the shared ones."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
