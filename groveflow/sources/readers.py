"""Readers with declared schemas. Inference is never used on large inputs; bad rows go to a quarantine column."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "struct<role:string,content:string>"
PROMPT_SCHEMA = (
    f"data_source string, prompt array<{MESSAGE}>, ability string, "
    "reward_model struct<style:string,ground_truth:string>, extra_info struct<split:string,index:bigint,question:string>"
)
CONVERSATION_SCHEMA = f"conv_id bigint, messages array<{MESSAGE}>"
PREFERENCE_SCHEMA = "prompt string, chosen string, rejected string"


def prompts(spark: SparkSession, *paths: str) -> DataFrame:
    """Several prompt files as one table."""
    return spark.read.schema(PROMPT_SCHEMA).parquet(*paths)


def sft(spark: SparkSession, path: str, prompt: str, response: str) -> DataFrame:
    """Prompt and response picked by key path from nested columns (`a.b.c`)."""
    return spark.read.parquet(path).select(F.col(prompt).alias("prompt"), F.col(response).alias("response"))


def preferences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREFERENCE_SCHEMA).parquet(path)


def conversations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONVERSATION_SCHEMA).parquet(path)


def tree_files(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One JSON tree per file below per-iteration folders.

    Iteration and tree number come from the path (-1 where the name is no number), documents encoded twice are
    unwrapped, unreadable files are skipped.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    number = F.regexp_extract("file", r"(?:/|tree=)(\d+)(?:\.json|/part-[^/]*)$", 1).try_cast("int")
    return _trees(raw.select("file", number.alias("tree"), "value"), schema)


def tree_packs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The same trees from files that hold many of them (`writers.tree_packs`): one line per tree, with its number and its
    document as a string. Files then grow with the bytes, not with the trees; a number that is missing is -1."""
    raw = spark.read.schema("tree int, doc string").option("recursiveFileLookup", True).json(root).withColumn("file", F.col("_metadata.file_path"))
    return _trees(raw.select("file", "tree", F.col("doc").alias("value")), schema)


def _trees(raw: DataFrame, schema: str) -> DataFrame:
    """Parsed documents (file, tree, value); the iteration comes from the path."""
    inner = F.from_json(F.concat(F.lit('{"s":'), F.col("value"), F.lit("}")), "s string")["s"]
    doc = F.when(F.ltrim("value").startswith('"'), inner).otherwise(F.col("value"))
    rows = raw.select(
        F.regexp_extract("file", r"iteration[_=](\d+)", 1).try_cast("int").alias("iteration"),
        F.coalesce("tree", F.lit(-1)).alias("tree_index"),
        F.from_json(doc, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("tree"),
    )
    return rows.where(F.col("tree").isNotNull() & F.col("tree._bad").isNull() & F.col("iteration").isNotNull())


def records(spark: SparkSession, schema: str, lines: str | None = None, whole: str | None = None) -> DataFrame:
    """JSONL files (one record per line) and JSON files (one document or array per file) as rows of one table;
    broken records keep their text in `_bad`. Folders are read recursively."""
    read = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True)
    parts = []
    if lines:
        parts.append(read.json(lines))
    if whole:
        parts.append(read.option("multiLine", True).json(whole))
    return reduce(DataFrame.unionByName, parts)


def rollout_dumps(spark: SparkSession, path: str, schema: str, mask: list[str] | None = None) -> DataFrame:
    """Rollout dumps of all steps in step order, given patterns masked with `*` in string columns."""
    rows = spark.read.schema(schema).json(path)
    for pattern in mask or []:
        rows = rows.withColumns({f.name: F.regexp_replace(f.name, pattern, "*") for f in rows.schema if f.dataType.typeName() == "string"})
    return rows.orderBy("step")


def shards(spark: SparkSession, root: str) -> DataFrame:
    """Merged shards of several producers with the shard number from the path."""
    return spark.read.option("basePath", root).parquet(root)


LOG_FIELDS = {
    "generation_throughput": r"Avg generation throughput: ([\d.]+) tokens/s",
    "running": r"Running: (\d+) reqs",
    "pending": r"Pending: (\d+) reqs",
    "gpu_cache": r"GPU KV cache usage: ([\d.]+)%",
    "cpu_cache": r"CPU KV cache usage: ([\d.]+)%",
}


def serving_log(spark: SparkSession, path: str) -> DataFrame:
    """Averages over the serving-log lines that carry each figure."""
    lines = spark.read.text(path)
    return lines.agg(*[F.avg(F.nullif(F.regexp_extract("value", p, 1), F.lit("")).cast("double")).alias(n) for n, p in LOG_FIELDS.items()])


def same_schema(frames: list[DataFrame]) -> bool:
    """Whether outputs concatenate: equal column names and types."""
    first = {f.name: f.dataType for f in frames[0].schema}
    return all({f.name: f.dataType for f in d.schema} == first for d in frames[1:])


def concatenated(frames: list[DataFrame]) -> DataFrame:
    if not same_schema(frames):
        raise ValueError("outputs do not share one schema")
    return reduce(DataFrame.unionByName, frames)


def contract(df: DataFrame, split: Column, expected: dict[str, int], required: list[str]) -> DataFrame:
    """Failing facts of a dataset contract: splits, row counts, required columns."""
    spark = df.sparkSession
    want = spark.createDataFrame(list(expected.items()), "split string, expected bigint")
    have = df.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("rows"))
    both = want.join(have, "split", "full_outer")
    bad = both.where(~F.col("rows").eqNullSafe(F.col("expected"))).select(
        F.concat_ws(" ", F.lit("rows of"), "split").alias("fact"), "expected", "rows"
    )
    missing = [(f"column {c}", 1, 0) for c in required if c not in df.columns]
    return bad.unionByName(spark.createDataFrame(missing, "fact string, expected bigint, rows bigint"))
