"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TEXTS = 1000  # rows in one batch that goes to a Python worker: texts are long, and a worker's memory follows the batch
BYTES = 8 << 20  # bytes in one batch, or one row

#: A worker lives on for the next stage. Arrays of 4 MB and more go back to the system at once, and freed memory at the top of
#: the heap soon, so that an executor does not hold what a stage before has used.
MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ready(spark: SparkSession) -> None:
    """Small batches and frugal memory for the Python workers, and this package on their path where the session was started
    without it."""
    for name, most in (("maxRecordsPerBatch", TEXTS), ("maxBytesPerBatch", BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        have = spark.conf.get(name).rstrip("b")
        if not (have.isdigit() and 0 < int(have) <= most):
            spark.conf.set(name, str(most))
    for key, value in MEMORY.items():
        spark.sparkContext.environment.setdefault(key, value)
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def query(name: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
