"""Group statistics, ranks and quantiles that survive hot groups.

A plain `Window.partitionBy(group)` sends a whole group to one task. The helpers here keep any single
group splittable: statistics are pre-aggregated map-side and joined back with a salt on hot groups only;
ranks and running sums are computed inside deterministic order buckets and shifted by bucket offsets.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A group is hot when it holds more than 1/HOT_PARTS of all rows, so there are fewer than HOT_PARTS hot
# groups whatever the data: the broadcast list of hot keys has a proven bound.
HOT_PARTS = 1024
SALTS = 64
# Rows of one task where a whole table is sorted by a key.
TASK_ROWS = 1 << 20

# Helper columns of this module all start with this; callers' tables must not hold such names (they are refused, not overwritten).
OWN = "__spread_"


def unclaimed(df: DataFrame, *names: str) -> None:
    """Refuse tables whose columns would be overwritten: helper columns of this module, and `names`."""
    taken = [c for c in df.columns if c.lower().startswith(OWN) or c in names]
    if taken:
        raise ValueError(f"columns {taken} are needed as helper columns: rename them")


def scalar(df: DataFrame, expr: Column) -> Column:
    """One aggregated value of `df` as a scalar sub-query (evaluated once, no join)."""
    return df.agg(expr.alias("v")).scalar()


def add_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Append the columns of a one-row table to every row, through one scalar sub-query."""
    return df.withColumn("__spread_one", one.select(F.struct(*one.columns)).scalar()).select("*", "__spread_one.*").drop("__spread_one")


def keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Add the keys as one struct column, which groups, partitions and joins with null equal to null."""
    return (df.withColumn("__spread_key", F.struct(*keys)), ["__spread_key"]) if keys else (df, [])


def attach_stats(
    df: DataFrame,
    keys: list[str],
    aggs: dict[str, Column],
    row_key: list[str],
    salts: int = SALTS,
    how: str = "inner",
) -> DataFrame:
    """Add per-group aggregates to every row; null keys are a group of their own.

    Groups above the hot threshold are joined on (key, salt): their one statistics row is copied to each
    salt while their rows spread over the salts by a hash of the unique row key.
    """
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__spread_n"), *[c.alias(n) for n, c in aggs.items()])
    return join_stats(df, stats, keys, row_key, None, salts, how, "__spread_n").drop("__spread_n")


def join_stats(df, stats, keys, row_key, sizes=None, salts=SALTS, how="inner", size="__n"):
    """Join rows with one-row-per-key `stats` that carries the group size in the column `size`, which the result keeps.

    Hot keys are read from `sizes` (keys, size), by default `stats` itself; pass a stored table where `stats`
    is a long derivation, so that it is computed once.
    """
    unclaimed(df, size)
    sizes = stats.select(*keys, size) if sizes is None else sizes
    total = scalar(sizes, F.sum(size))
    is_hot = F.col(size) * HOT_PARTS > total
    hot = sizes.where(is_hot).select(*keys, F.lit(True).alias("__spread_hot"))
    hot, key = keyed(hot, keys)
    rows, _ = keyed(df, keys)
    rows = rows.join(F.broadcast(hot.drop(*keys)), key, "left").withColumn(
        "__spread_salt",
        F.when(F.col("__spread_hot"), F.pmod(F.xxhash64(*row_key), F.lit(salts))).otherwise(F.lit(0)).cast("int"),
    )
    copies, _ = keyed(stats, keys)
    copies = copies.drop(*keys).withColumn(
        "__spread_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(salts - 1)).otherwise(F.lit(0))))
    )
    return rows.drop("__spread_hot").join(copies, [*key, "__spread_salt"], how).drop("__spread_salt", "__spread_key")


def in_tasks(df: DataFrame, keys: list[str], rows: int = TASK_ROWS) -> DataFrame:
    """Spread rows by `keys` over so many tasks that each gets about `rows` of them, where the session's shuffle partitions
    would give more: what a task sorts then does not grow with the table. Smaller tables stay as they are."""
    n = -(-df.count() // rows)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def hash_bucket(key: Column, digits: int = 3) -> Column:
    """Order bucket of an md5 text: its leading hex digits (16**digits even buckets)."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def value_bucket(df: DataFrame, col: Column, parts: int = 256, descending: bool = False):
    """Order bucket for an ascending numeric column: the number of split points at or below the value.

    The split points are `parts` - 1 quantiles of the data itself, so buckets hold about as many rows each, whatever
    outliers or infinities the column has. Nulls fall into the first bucket. One value never spans buckets: where a
    value may repeat without bound, count the distinct values first.

    Returns a function that adds the bucket `__spread_cell`; the split points are one sub-query with one reference, evaluated once.
    """
    c = col.cast("double")

    def add(rows: DataFrame) -> DataFrame:
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        rows = rows.withColumn("__spread_cuts", df.agg(F.percentile_approx(c, shares, F.lit(8 * parts)).alias("s")).scalar())
        steps = F.array(*[F.lit(1 << i) for i in reversed(range((parts - 1).bit_length()))])
        # binary search for the number of split points at or below the value
        cell = F.aggregate(steps, F.lit(0), lambda at, step: F.when(c >= F.try_element_at(F.col("__spread_cuts"), at + step), at + step).otherwise(at))
        return rows.withColumn("__spread_cell", -cell if descending else cell).drop("__spread_cuts")

    return add


def with_bucket(df: DataFrame, bucket) -> DataFrame:
    """Add `__spread_cell` from a bucket column or from a function made by `value_bucket`."""
    return bucket(df) if callable(bucket) and not isinstance(bucket, Column) else df.withColumn("__spread_cell", bucket)


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket,
    sums: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums in `order` within `keys`, computed per (keys, bucket) plus offsets.

    `bucket` must be non-decreasing along `order`. A hot group is split over its buckets; the offsets table
    has one row per (group, bucket).
    """
    unclaimed(df)
    rows, key = keyed(with_bucket(df, bucket), keys)
    per_bucket = rows.groupBy(*key, "__spread_cell").agg(*[F.sum(c).alias(f"__spread_part_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*key).orderBy("__spread_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *key,
        "__spread_cell",
        *[F.coalesce(F.sum(f"__spread_part_{n}").over(before), F.lit(0)).alias(f"__spread_before_{n}") for n in sums],
    )
    inside = Window.partitionBy(*key, "__spread_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    out = out.join(offsets, [*key, "__spread_cell"])
    return out.withColumns({n: F.col(n) + F.col(f"__spread_before_{n}") for n in sums}).drop(
        "__spread_cell", "__spread_key", *[f"__spread_before_{n}" for n in sums]
    )


def last_known(df, keys, order, bucket, value: Column, name: str) -> DataFrame:
    """Last non-null `value` at or before each row in ascending `order` within `keys` (as-of lookup).

    Looked up inside the order bucket first; the value carried in from earlier buckets is joined on.
    """
    unclaimed(df)
    rows, key = keyed(with_bucket(df, bucket).withColumn("__spread_value", value), keys)
    ends = (
        rows.groupBy(*key, "__spread_cell")
        .agg(F.max_by(F.col("__spread_value"), F.when(F.col("__spread_value").isNotNull(), F.struct(*order))).alias("__spread_end"))
    )
    before = Window.partitionBy(*key).orderBy("__spread_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*key, "__spread_cell", F.last("__spread_end", ignorenulls=True).over(before).alias("__spread_carry"))
    inside = Window.partitionBy(*key, "__spread_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn(name, F.last("__spread_value", ignorenulls=True).over(inside)).join(carried, [*key, "__spread_cell"])
    return out.withColumn(name, F.coalesce(F.col(name), F.col("__spread_carry"))).drop("__spread_cell", "__spread_value", "__spread_carry", "__spread_key")


def ranked(df, keys, order, bucket, name="rank") -> DataFrame:
    """row_number in `order` within `keys` that no single task computes alone."""
    return running_sum(df, keys, order, bucket, {name: F.lit(1).cast("bigint")})


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str | None = None) -> DataFrame:
    """First k rows per group. `rank <= constant` lets Spark prune to k rows per group and task
    before the shuffle (window group limit), so hot groups cost k rows per task."""
    unclaimed(df)
    out = df.withColumn("__spread_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        F.col("__spread_rank") <= k
    )
    return out.withColumnRenamed("__spread_rank", name) if name else out.drop("__spread_rank")


def value_counts(df: DataFrame, keys: list[str], value: Column, parts: int = 256) -> DataFrame:
    """Distinct values with their multiplicity `c` and the running count `hi` in ascending order."""
    counts = df.select(*keys, value.alias("v")).where(F.col("v").isNotNull()).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    return running_sum(counts, keys, [F.col("v")], value_bucket(counts, F.col("v"), parts), {"hi": F.col("c")})


def exact_quantiles(df: DataFrame, value: Column, probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles (keys, prob, value) from running counts of the distinct values."""
    keys = keys or []
    value = value.cast("double")
    rows = value_counts(df, keys, value, parts=256 if keys else 4096)
    if keys:
        sizes = df.groupBy(*keys).agg(F.count(value).alias("n"), F.count(F.lit(1)).alias("__n"))
        rows = join_stats(rows, sizes, keys, ["v"]).drop("__n")
    else:
        rows = rows.withColumn("n", scalar(df, F.count(value)))
    picks = []
    for p in probs:
        at = F.lit(float(p)) * (F.col("n") - 1)
        frac = at - F.floor(at)
        entry = lambda r, w: F.struct(F.lit(float(p)).alias("prob"), r.alias("r"), w.alias("w"))
        picks += [entry(F.floor(at) + 1, 1 - frac), entry(F.ceil(at) + 1, frac)]
    mine = F.filter(F.array(*picks), lambda e: (e["r"] > F.col("hi") - F.col("c")) & (e["r"] <= F.col("hi")))
    hit = rows.select(*keys, "v", F.explode(mine).alias("e"))
    return hit.groupBy(*keys, F.col("e.prob").alias("prob")).agg(F.sum(F.col("e.w") * F.col("v")).alias("value"))
