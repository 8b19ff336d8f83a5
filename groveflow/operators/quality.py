"""Data-quality checks. Each returns failing rows (or a split into good and quarantined rows) and counts."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import scratch_path
from .trees import edge_id


def normalise_edges(edges: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """Derive the identity of every edge; rows whose supplied id differs go to quarantine."""
    rows = edges.withColumn("derived_id", edge_id(snapshot))
    wrong = F.col("edge_id").isNotNull() & (F.col("edge_id") != F.col("derived_id"))
    good = rows.where(~F.coalesce(wrong, F.lit(False))).withColumn("edge_id", F.col("derived_id"))
    return good, rows.where(wrong).withColumn("reason", F.lit("edge id differs from its derivation"))


def flag(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add `failures`: names of the rules a row breaks (a null verdict counts as broken)."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]
    return df.withColumn("failures", F.filter(F.array(*broken), lambda x: x.isNotNull()))


def failing(df: DataFrame, rules: dict[str, Column], strict: bool = False) -> DataFrame:
    """Rows that break a rule; `strict` makes the job fail on the first of them instead."""
    out = flag(df, rules).where(F.size("failures") > 0)
    if strict:
        text = F.concat(F.lit("quality check failed: "), F.array_join("failures", ", "))
        return out.withColumn("failures", F.array(F.raise_error(text).cast("string")))
    return out


def failure_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row (rule, failures) per rule, zero included, in one pass."""
    one = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("failures")) for n in rules])
    return one.select(F.inline(pairs))


def inspect(df: DataFrame, rules: dict[str, Column], strict: bool = False, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Failing rows (with `failures`) and counts (rule, failures, rows), from one run over `df`.

    The failing rows are written to `path` (a folder of the shared one by default); the counts are metrics observed while
    they are written. `strict` raises an error with the counts if any rule is broken, once the rows are written.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "failures")
    seen = Observation()
    metrics = [F.count_if(F.array_contains("failures", n)).alias(n) for n in rules]
    flag(df, rules).observe(seen, F.count(F.lit(1)).alias("__rows"), *metrics).where(F.size("failures") > 0).write.mode("overwrite").parquet(path)
    got = seen.get
    counts = [(n, got[n], got["__rows"]) for n in rules]
    broken = ", ".join(f"{n}: {c}" for n, c, _ in counts if c)
    if strict and broken:
        raise ValueError(f"quality check failed: {broken} of {got['__rows']} rows; they are in {path}")
    return spark.read.parquet(path), spark.createDataFrame(counts, "rule string, failures bigint, rows bigint")


def parent_groups(edges: DataFrame) -> DataFrame:
    """One row per parent group with the facts the group rules need."""
    return edges.groupBy("parent_id").agg(
        F.countDistinct("tree_id").alias("trees"),
        F.countDistinct("allocated_k").alias("ks"),
        F.max("allocated_k").alias("allocated"),
        F.count(F.lit(1)).alias("realised"),
        F.count_if("retained").alias("retained"),
        F.max("multiplicity").alias("multiplicity"),
    )


def group_rules() -> dict[str, Column]:
    return {
        "one_tree": F.col("trees") == 1,
        "one_allocated_k": F.col("ks") == 1,
        "realised_equals_allocated": F.col("realised") == F.col("allocated"),
        "retained_within_allocated": F.col("retained") <= F.col("allocated"),
    }


def fresh_rules() -> dict[str, Column]:
    return {
        "realised_equals_allocated": F.col("realised") == F.col("allocated"),
        "multiplicity_one": F.col("multiplicity") == 1,
    }


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def collisions(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key is already known."""
    return new.join(known.select(*keys), keys, "left_semi")


def construction_report(edges: DataFrame, trees: DataFrame) -> DataFrame:
    """Counts of every construction failure of a batch: groups, ids, pruned rows, queue totals, log-probs."""
    groups = failure_counts(parent_groups(edges), group_rules())
    rows = failure_counts(
        edges,
        {
            "has_id": F.col("edge_id").isNotNull(),
            "not_pruned": ~F.col("pruned"),
            "logprobs_aligned": F.col("n_logprobs") == F.col("n_tokens"),
        },
    )
    dup = duplicates(edges, ["edge_id"]).agg(F.count(F.lit(1)).alias("failures")).select(F.lit("unique_ids").alias("rule"), "failures")
    per = edges.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"))
    total = failure_counts(trees.join(per, "tree_id", "left"), {"queue_total": F.col("expected") == F.coalesce("n", F.lit(0))})
    return reduce(DataFrame.unionByName, [groups, rows, dup, total])


def slot_rules() -> dict[str, Column]:
    """Record rules: a slot has no payload, an edge has one; counts equal the payload."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return {
        "slot_without_payload": ~F.col("is_slot") | none("tokens"),
        "edge_with_payload": F.col("is_slot") | ~none("tokens"),
        "token_count": F.col("is_slot") | (F.col("n_tokens") == F.size("tokens")),
        "logprob_count": F.col("is_slot") | (F.size("logps") == F.size("tokens")),
        "mask_count": F.col("is_slot") | (F.col("n_active") == F.size(F.filter("logps", lambda x: x < F.log(F.lit(0.9))))),
    }


def replay_rules(max_age: int, cap: int) -> dict[str, Column]:
    return {
        "has_id": F.col("edge_id").isNotNull(),
        "has_question": F.col("question_id").isNotNull(),
        "has_iteration": F.col("iteration").isNotNull(),
        "has_advantage": F.col("advantage").isNotNull(),
        "age_in_range": (F.col("age") >= 0) & (F.col("age") < max_age),
        "within_cap": F.col("rank") <= cap,
    }


def anomalies(df: DataFrame, cols: list[str], z: float = 6.0, zero: float = 1e-6) -> DataFrame:
    """Per column: NaN and infinite counts, values beyond z deviations, share close to zero."""
    inf = float("inf")
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) < inf), F.col(c)) for c in cols}
    first = df.agg(
        *[F.avg(finite[c]).alias(f"{c}_m") for c in cols], *[F.stddev_samp(finite[c]).alias(f"{c}_s") for c in cols]
    )
    cut = {c: (first.select(f"{c}_m").scalar(), first.select(f"{c}_s").scalar()) for c in cols}
    aggs = []
    for c in cols:
        m, s = cut[c]
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.isnan(c)).alias("nan"),
                F.count_if(F.abs(c) == inf).alias("inf"),
                F.count_if(F.abs(finite[c] - m) > z * s).alias("outliers"),
                F.avg((F.abs(finite[c]) < zero).cast("double")).alias("near_zero"),
            ).alias(c)
        )
    return df.agg(*aggs).select(F.inline(F.array(*cols)))
