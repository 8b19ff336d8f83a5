"""Replay selection and training-batch formation."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import sample_key
from .spread import first_k, join_stats, ranked, value_bucket


def fresh(edges: DataFrame, now: int, max_age: int) -> DataFrame:
    """Edges whose age lies in [0, max_age)."""
    age = F.lit(now) - F.col("iteration")
    return edges.withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") < max_age))


def capped_edges(edges: DataFrame, now: int, max_age: int, cap: int, seed: int = 0) -> DataFrame:
    """Seeded draw of at most `cap` unexpired edges per question."""
    key = [sample_key(seed, F.col("edge_id")), F.col("edge_id")]
    return first_k(fresh(edges, now, max_age), ["question_id"], key, cap)


def sample_edges(edges: DataFrame, now: int, max_age: int, cap: int, target: int, seed: int = 0) -> DataFrame:
    """Seeded draw of at most `cap` edges per question, then of at most `target` overall.

    Both limits are constants: rows are cut to cap per question and task before the shuffle and to target per
    task before the merge.
    """
    capped = capped_edges(edges, now, max_age, cap, seed)
    again = [sample_key(f"{seed}.all", F.col("edge_id")), F.col("edge_id")]
    return capped.orderBy(*again).limit(target)


def default_cap(trees: int, shape: list[int], max_age: int) -> int:
    """max(1, ceil(trees * sum of prefix products of the shape / max age))."""
    total, prod = 0, 1
    for k in shape:
        prod *= k
        total += prod
    return max(1, -(-trees * total // max_age))


def sample_stats(sampled: DataFrame, target: int) -> DataFrame:
    return sampled.agg(
        F.count(F.lit(1)).alias("sampled"),
        F.countDistinct("question_id").alias("questions"),
        F.avg("age").alias("mean_age"),
        F.max("age").alias("max_age"),
        (F.count(F.lit(1)) < target).alias("underfilled"),
    )


def complete_trees(edges: DataFrame, now: int, max_age: int, cap: int, target: int, seed: int = 0) -> DataFrame:
    """Whole trees only: per question in id order up to `cap` edges (the first tree always), then packed in
    shuffled order up to `target`, skipping what does not fit.

    Both steps are greedy over tree sizes. Of the trees of one size s only the first limit/s in order can ever
    be taken, so at most limit * ln(limit) small rows reach the folds however many trees there are.
    """
    trees = fresh(edges, now, max_age).groupBy("question_id", "tree_id").agg(F.count(F.lit(1)).alias("size"))
    first = trees.groupBy("question_id").agg(F.min("tree_id").alias("first_tree"))
    useful = first_k(trees.where(F.col("size") <= cap), ["question_id", "size"], [F.col("tree_id")], cap, "__r")
    useful = useful.where(F.col("__r") * F.col("size") <= cap).drop("__r")
    lead = trees.join(first.withColumnRenamed("first_tree", "tree_id"), ["question_id", "tree_id"])
    useful = useful.unionByName(lead).dropDuplicates(["question_id", "tree_id"])
    entry = F.struct("tree_id", "size")
    per = useful.groupBy("question_id").agg(F.sort_array(F.collect_list(entry)).alias("t"))
    picked = per.select("question_id", F.inline(_pack(F.col("t"), cap, True)))
    shuffled = picked.withColumn("__k", sample_key(seed, F.col("tree_id")))
    order = [F.col("__k"), F.col("tree_id")]
    useful = first_k(shuffled.where(F.col("size") <= target), ["size"], order, target, "__r")
    useful = useful.where(F.col("__r") * F.col("size") <= target)
    # at most target * ln(target) rows of (key, tree, size): one bounded array
    arr = useful.agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", "tree_id", "size"))), lambda x: F.struct(x["tree_id"].alias("tree_id"), x["size"].alias("size"))).alias("t"))
    return arr.select(F.inline(_pack(F.col("t"), target, False)))


def _pack(arr: Column, limit: int, first_always: bool) -> Column:
    kind = "array<struct<tree_id:bigint,size:bigint>>"
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(kind).alias("out"))

    def step(acc, x):
        fits = acc["used"] + x["size"] <= limit
        if first_always:
            fits = fits | (F.size(acc["out"]) == 0)
        return F.struct(
            F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.array_append(acc["out"], F.struct(x["tree_id"].alias("tree_id"), x["size"].alias("size")))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(arr, zero, step)["out"]


def logical_batches(slots: DataFrame, mini: int, keys: list[str], order: str, use_mask: bool = True) -> DataFrame:
    """Consecutive groups of `mini` slots before any zero filtering, with the denominators they imply.

    slots: keys, order column (unique), advantage, n_tokens, n_active. A batch is all_zero without a non-zero
    advantage, zero_active when its non-zero rows have no active token, else trainable.
    """
    rows = with_batch(slots, mini, keys, order)
    real = F.col("advantage") != 0
    active = F.sum(F.when(real, F.col("n_active" if use_mask else "n_tokens")).otherwise(0))
    return rows.groupBy(*keys, "batch").agg(
        F.count(F.lit(1)).alias("slots"),
        F.sum("n_tokens").alias("tokens"),
        F.sum("n_active").alias("active_tokens"),
        F.count_if(real).alias("rows"),
        F.when(F.count_if(real) == 0, "all_zero").when(active <= 0, "zero_active").otherwise("trainable").alias("status"),
    )


def with_batch(slots, mini, keys, order):
    rows = ranked(slots, keys, [F.col(order)], value_bucket(slots, F.col(order)), "__p")
    return rows.withColumn("batch", F.floor((F.col("__p") - 1) / mini)).drop("__p")


def micro_batches(groups: DataFrame, limit: int) -> DataFrame:
    """Parents (batch, tree, parent, size) of a logical batch packed without splitting, in the order of tree and parent as
    texts; a parent larger than the limit stands alone. A logical batch has `mini` slots at most: one small array."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    per = groups.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(text("tree"), text("parent"), "size"))).alias("g"))
    kind = "array<struct<parent:string,size:bigint,micro:int>>"
    zero = F.struct(
        F.lit(0).alias("micro"), F.lit(0).cast("bigint").alias("used"), F.array().cast(kind).alias("out")
    )

    def step(acc, x):
        big = x["size"] > limit
        new = (acc["used"] > 0) & (big | (acc["used"] + x["size"] > limit))
        micro = F.when(new, acc["micro"] + 1).otherwise(acc["micro"])
        put = F.struct(x["parent"].cast("string").alias("parent"), x["size"].alias("size"), micro.cast("int").alias("micro"))
        return F.struct(
            F.when(big, micro + 1).otherwise(micro).cast("int").alias("micro"),
            F.when(big, F.lit(0)).when(new, x["size"]).otherwise(acc["used"] + x["size"]).cast("bigint").alias("used"),
            F.array_append(acc["out"], put).alias("out"),
        )

    return per.select("batch", F.inline(F.aggregate("g", zero, step)["out"]))


def pad_rows(batches: DataFrame, ranks: int) -> DataFrame:
    """Dummy rows that fill each batch to a multiple of the ranks."""
    missing = F.pmod(-F.col("rows"), F.lit(ranks))
    return batches.where(missing > 0).select("*", F.explode(F.sequence(F.lit(1), missing.cast("int"))).alias("dummy"))


def balanced_shards(df: DataFrame, length: str, row_id: str, shards: int) -> DataFrame:
    """Equal row counts and similar token sums: rows by falling length are dealt in a snake over the shards."""
    base = df.agg(F.max(row_id).alias("v")).scalar() + 1
    order = -F.col(length) * base + F.col(row_id)
    rows = df.withColumn("__o", order)
    rows = ranked(rows, [], [F.col("__o")], value_bucket(rows, F.col("__o"), parts=4096), "__p")
    p = F.col("__p") - 1
    lap, i = F.floor(p / shards), p % shards
    return rows.withColumn("shard", F.when(lap % 2 == 0, i).otherwise(shards - 1 - i)).drop("__o", "__p")


def objective_weights(edges: DataFrame) -> DataFrame:
    """Per edge: 1/(trees * segments of the tree) and 1/trees * 1/parents of the tree * m / sum m of the parent."""
    tree = edges.groupBy("tree_id").agg(F.count(F.lit(1)).alias("__n"))
    parent = edges.groupBy("tree_id", "parent_id").agg(F.count(F.lit(1)).alias("__n"), F.sum("multiplicity").alias("__m"))
    n_parents = parent.groupBy("tree_id").agg(F.count(F.lit(1)).alias("__p"))
    trees = tree.agg(F.count(F.lit(1)).alias("v")).scalar()
    tree = tree.join(n_parents, "tree_id").withColumn("__segments", F.col("__n"))
    rows = join_stats(edges, tree, ["tree_id"], ["edge_id"]).drop("__n")
    rows = join_stats(rows, parent, ["tree_id", "parent_id"], ["edge_id"]).drop("__n")
    return rows.withColumns(
        {
            "segment_weight": 1.0 / (trees * F.col("__segments")),
            "node_weight": 1.0 / trees / F.col("__p") * F.col("multiplicity") / F.col("__m"),
        }
    ).drop("__segments", "__p", "__m")


def hierarchical_mean(edges: DataFrame, loss: str) -> DataFrame:
    """Children by multiplicity to parent mean, to tree mean, to batch mean."""
    m = F.col("multiplicity")
    parent = edges.groupBy("tree_id", "parent_id").agg((F.sum(m * F.col(loss)) / F.sum(m)).alias("l"))
    tree = parent.groupBy("tree_id").agg(F.avg("l").alias("l"))
    return tree.agg(F.avg("l").alias("loss"), F.count(F.lit(1)).alias("trees"))


def batch_objective(tokens: DataFrame, batches: DataFrame, reduction: str = "mean") -> DataFrame:
    """Segment and token objective of logical batches (batch, rollout_id) with all slots in the denominators."""
    m = F.col("mask")
    row = tokens.groupBy("rollout_id").agg(F.sum(m * F.col("loss")).alias("s"), F.sum(m).alias("n"))
    one = F.when(F.col("n") > 0, F.col("s") / F.col("n") if reduction == "mean" else F.col("s")).otherwise(0.0)
    rows = batches.join(row.withColumn("row_loss", one), "rollout_id", "left")
    return rows.groupBy("batch").agg(
        (F.coalesce(F.sum("row_loss"), F.lit(0.0)) / F.count(F.lit(1))).alias("segment_mean"),
        (F.coalesce(F.sum("s"), F.lit(0.0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("token_mean"),
        F.count(F.lit(1)).alias("slots"),
    )


def repeat_rows(df: DataFrame, times: int | str, interleave: bool = True) -> DataFrame:
    """Repeat rows a fixed number of times or by a count column; `copy` orders interleaved copies next to
    their row (row_id, copy) and block copies as (copy, row_id)."""
    n = F.lit(times) if isinstance(times, int) else F.col(times)
    out = df.where(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), n.cast("int"))))
    return out.withColumn("layout", F.lit("interleaved" if interleave else "blocks"))


def union_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union of the columns of two batches by key; `conflict` marks shared columns that disagree."""
    shared = [c for c in b.columns if c in a.columns and c != key]
    right = b.select(key, *[F.col(c).alias(f"__r_{c}") if c in shared else F.col(c) for c in b.columns if c != key])
    rows = a.join(right, key)
    clash = F.lit(False)
    for c in shared:
        clash = clash | ~F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return rows.withColumn("conflict", clash).drop(*[f"__r_{c}" for c in shared])


def progress_runs(status: DataFrame, abort_after: int) -> DataFrame:
    """Iterations with the length of the current run without progress and an abort flag (gaps and islands).
    One row per iteration of a run, so the window is bounded by the run length."""
    w = Window.partitionBy("run").orderBy("iteration")
    island = F.sum(F.col("progress").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = status.withColumn("__i", island)
    idle = F.sum((~F.col("progress")).cast("int")).over(
        Window.partitionBy("run", "__i").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    )
    return rows.withColumn("idle", idle).withColumn("abort", F.col("idle") >= abort_after).drop("__i")
