"""Seeded sampling, shuffling, splitting and slicing. Every draw is an order by md5(seed | id): the result
depends neither on partitioning nor on retries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import sample_key, uniform
from .spread import first_k, hash_bucket, ranked, scalar


def shuffled(df: DataFrame, row_id: str, seed, keys: list[str] | None = None, name: str = "pos") -> DataFrame:
    """Position of each row in the seeded shuffle (from 1), per group if keys are given."""
    key = sample_key(seed, F.col(row_id))
    rows = df.withColumn("__k", key)
    digits = 2 if keys else 3
    return ranked(rows, keys or [], [F.col("__k"), F.col(row_id)], hash_bucket(F.col("__k"), digits), name).drop("__k")


def subset(df: DataFrame, row_id: str, n: int, seed, keys: list[str] | None = None) -> DataFrame:
    """Seeded subset of n rows (per group). n is a report-size constant: top-n per task, then merged."""
    key = [sample_key(seed, F.col(row_id)), F.col(row_id)]
    if keys:
        return first_k(df, keys, key, n)
    return df.orderBy(*key).limit(n)


def iteration_slice(df: DataFrame, row_id: str, iteration: int, per_iteration: int, total: int, seed) -> DataFrame:
    """Rows of one iteration of a dataset that is shuffled again (new seed) on every pass over it."""
    start, stop = iteration * per_iteration, (iteration + 1) * per_iteration
    out = None
    for p in range(start // total, (stop - 1) // total + 1):
        rows = shuffled(df, row_id, f"{seed}.{p}").withColumn("at", F.col("pos") - 1 + p * total)
        part = rows.where((F.col("at") >= start) & (F.col("at") < stop)).drop("pos")
        out = part if out is None else out.unionByName(part)
    return out


def fit_to_count(df: DataFrame, row_id: str, target: int, seed) -> DataFrame:
    """Down-sample the shuffled rows to the target, or repeat whole passes and cut the last one."""
    n = scalar(df, F.count(F.lit(1)))
    rows = shuffled(df, row_id, seed)
    copies = F.greatest(F.floor((F.lit(target) - F.col("pos")) / n) + 1, F.lit(0))
    rows = rows.withColumn("copies", copies).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies")


def split_share(df: DataFrame, row_id: str, share: float, seed) -> Column:
    """Validation flag: the row's hashed uniform falls below the share."""
    return uniform(sample_key(seed, F.col(row_id))) < share


def contiguous_shard(df: DataFrame, row_id: str, shards: int, bucket) -> DataFrame:
    """Shard number of contiguous shards; the first `rows mod shards` shards hold one row more."""
    n = scalar(df, F.count(F.lit(1)))
    rows = ranked(df, [], [F.col(row_id)], bucket, "__p").withColumn("__n", n)
    small, extra = F.floor(F.col("__n") / shards), F.col("__n") % shards
    p = F.col("__p") - 1
    big = extra * (small + 1)
    shard = F.when(p < big, F.floor(p / (small + 1))).otherwise(extra + F.floor((p - big) / F.greatest(small, F.lit(1))))
    return rows.withColumn("shard", shard).drop("__p", "__n")


def sampled_means(pool: DataFrame, k: DataFrame, seeds: int, k_max: int) -> DataFrame:
    """Mean of k sampled rewards per (method, node, seed) next to the pool mean.

    Without replacement where the pool is large enough, else with. pool: node_id, id, r; k: node_id, method, k
    with k <= k_max, so only the first k_max rows of a seeded order are needed (pruned before the shuffle).
    """
    ref = pool.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("ref"))
    seeded = pool.withColumn("seed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(seeds - 1).cast("bigint"))))
    key = F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("id").cast("string")))
    first = first_k(seeded, ["node_id", "seed"], [key, F.col("id")], k_max, "i")
    want = k.join(ref, "node_id")
    plain = want.where("k <= n").join(first, "node_id").where("i <= k").groupBy("method", "node_id", "seed").agg(F.avg("r").alias("mean"), F.first("ref").alias("ref"))
    again = want.where("k > n").withColumn("seed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(seeds - 1).cast("bigint")))).withColumn(
        "t", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("k")))
    )
    pick = F.floor(uniform(F.md5(F.concat_ws("|", F.col("seed").cast("string"), "node_id", F.col("t").cast("string")))) * F.col("n")) + 1
    redrawn = again.withColumn("i", pick.cast("int")).join(first, ["node_id", "seed", "i"]).groupBy("method", "node_id", "seed").agg(F.avg("r").alias("mean"), F.first("ref").alias("ref"))
    return plain.unionByName(redrawn)
