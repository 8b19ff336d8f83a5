"""Sinks: step dumps, accounting tables, statistics files, verified prompt tables."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# Flushes of a run that share a folder.
FLUSHES = 1024


def step_dump(df: DataFrame, path: str) -> None:
    """JSONL files partitioned by step."""
    df.write.mode("append").partitionBy("step").json(path)


def tree_packs(df: DataFrame, path: str) -> None:
    """Trees (iteration, tree, doc) below per-iteration folders, one JSON line per tree: a task writes one file per iteration,
    where a file per tree would make the driver list and move as many files as there are trees."""
    df.select("iteration", "tree", "doc").write.partitionBy("iteration").json(path)


def append_artifacts(df: DataFrame, path: str) -> None:
    """Append accounting, flush or manifest records below their run."""
    df.write.mode("append").partitionBy("run_id").parquet(path)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write the partitions that `df` holds and leave all others: a job that is repeated leaves the same rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_flush(df: DataFrame, path: str, block: int = FLUSHES) -> None:
    """Records of flushes below their run; a flush that is written again replaces itself.

    A folder holds `block` consecutive flushes of a run, so folders and files grow far slower than flushes. Folders that are
    written into again keep the flushes that `df` does not hold: those are copied aside first, then both replace the folder.
    """
    spark = df.sparkSession
    keys, folder = ["run_id", "flush_id"], ["run_id", "flush_block"]
    # the rows are used three times: a stored copy is the same each time
    new = materialise(df.withColumn("flush_block", F.floor(F.col("flush_id") / block)), "flushes")
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    if old is not None:
        touched, mine = new.select(*folder).distinct(), new.select(*keys).distinct()
        kept = old.join(F.broadcast(touched), folder, "left_semi").join(mine, keys, "left_anti")
        new = new.unionByName(materialise(kept.select(*new.columns), "kept"))
    replace_partitions(new.repartition(*folder), path, folder)


def statistics_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def compressed_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def verified_prompts(df: DataFrame, path: str) -> tuple[int, bool]:
    """Write, read again, return the row count and whether the schema survived (nullability aside)."""
    df.write.mode("overwrite").parquet(path)
    again = df.sparkSession.read.parquet(path)
    names = lambda d: [(f.name, f.dataType.simpleString()) for f in d.schema]
    return again.count(), names(again) == names(df)
