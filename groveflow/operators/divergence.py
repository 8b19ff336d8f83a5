"""Pilot likelihoods: pair distances, dispersion bounds, clustering, calibration.

The pilots of a node are bounded by the configured pilot count; nodes are not. Order-dependent steps are folds
over one small array per node, evaluated inside the executor JVM.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import sample_key, tanh_distance, value_gap_bound
from .spread import first_k


def pair_distances(support: DataFrame) -> DataFrame:
    """Distance of pilots i < j, averaged over the continuations that come from i or j.

    Every such continuation has one of the two as its origin, so the origin's row meets the other pilots'
    rows of the same continuation: pilots x continuations rows instead of pairs x continuations. They meet in a window
    inside the node, so rows that are already spread by node move no further.
    """
    own = F.max(F.when(F.col("pilot") == F.col("origin"), F.col("logp"))).over(Window.partitionBy("node_id", "support"))
    rows = support.withColumn("lo", own).where("pilot <> origin AND lo IS NOT NULL")
    pairs = rows.select(
        "node_id", F.least("origin", "pilot").alias("i"), F.greatest("origin", "pilot").alias("j"), tanh_distance(F.col("lo"), F.col("logp")).alias("d")
    )
    return pairs.groupBy("node_id", "i", "j").agg(F.avg("d").alias("tv")).where("tv IS NOT NULL")


def pair_distances_all(support: DataFrame, half: bool = True) -> DataFrame:
    """Legacy distance over all continuations: (half of) the summed absolute probability difference. A continuation's rows
    (one a pilot, bounded by the pilot count) meet in a window inside the node."""
    entry = F.struct(F.col("pilot").alias("j"), F.exp("logp").alias("pj"))
    rows = support.withColumn("all", F.collect_list(entry).over(Window.partitionBy("node_id", "support")))
    rows = rows.select("node_id", F.col("pilot").alias("i"), F.exp("logp").alias("pi"), F.inline(F.filter("all", lambda e: e["j"] > F.col("pilot"))))
    tv = F.sum(F.abs(F.col("pi") - F.col("pj"))) * (0.5 if half else 1.0)
    return rows.groupBy("node_id", "i", "j").agg(tv.alias("tv"))


def softmax_distances(support: DataFrame) -> DataFrame:
    """Half the L1 distance of the normalised likelihood rows of two pilots."""
    row = Window.partitionBy("node_id", "pilot")
    rows = support.withColumn("e", F.exp(F.col("logp") - F.max("logp").over(row)))
    rows = rows.withColumn("z", F.sum("e").over(row)).select("node_id", "pilot", "support", F.log(F.col("e") / F.col("z")).alias("logp"))
    return pair_distances_all(rows)


def dispersion(pairs: DataFrame, sizes: DataFrame, **bound) -> DataFrame:
    """C = sum of squared value bounds over pairs / n^2; at most one pilot gives 0. sizes: (node_id, n)."""
    b = value_gap_bound(F.col("tv"), **bound)
    c = pairs.groupBy("node_id").agg(F.sum(b * b).alias("s"))
    return sizes.join(c, "node_id", "left").select(
        "node_id", "n", F.when(F.col("n") > 1, F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("n"))).otherwise(0.0).alias("c")
    )


def terminal_dispersion(pilots: DataFrame, pairs: DataFrame, **bound) -> DataFrame:
    """Dispersion with finished pilots as atoms: continuing pairs by distance, finished-continuing pairs at
    distance 1, finished pairs with both rewards by squared reward difference; divided by all pilots squared. The last two need
    only counts and moments: sum over pairs of (R_i - R_j)^2 = n sum R^2 - (sum R)^2."""
    fin = F.col("finished")
    p = pilots.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fin).alias("f"), F.count(F.when(fin, F.col("reward"))).alias("known"), F.sum(F.when(fin, F.col("reward"))).alias("r"),
        F.sum(F.when(fin, F.col("reward") * F.col("reward"))).alias("rr"),
    )
    b = value_gap_bound(F.col("tv"), **bound)
    cc = pairs.groupBy("node_id").agg(F.sum(b * b).alias("s"))
    one = value_gap_bound(F.lit(1.0), **bound)
    n2 = F.col("n") * F.col("n")
    live = F.col("n") - F.col("f")
    rows = p.join(cc, "node_id", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    terminal = F.coalesce(F.greatest(F.col("known") * F.col("rr") - F.col("r") * F.col("r"), F.lit(0.0)), F.lit(0.0)) / n2
    cross = F.col("f") * live * one * one / n2
    multi = F.col("n") > 1
    return rows.select(
        "node_id", "n", F.col("f").alias("n_finished"),
        F.when(multi & (live > 1), F.col("s") / (live * live)).otherwise(0.0).alias("continuing"),
        F.when(multi, terminal).otherwise(0.0).alias("terminal"),
        F.when(multi, cross).otherwise(0.0).alias("cross"),
        F.when(multi, F.col("s") / n2 + cross + terminal).otherwise(0.0).alias("c"),
    )


def with_near(pilots: DataFrame, pairs: DataFrame, near: Column) -> DataFrame:
    """Per node the pilots in order (`members`) and the pairs (i, j) of them that are near (bounded by the pilot count squared)."""
    m = pilots.groupBy("node_id").agg(F.sort_array(F.collect_list("pilot")).alias("members"))
    n = pairs.where(near).groupBy("node_id").agg(F.collect_list(F.struct("i", "j")).alias("near"))
    return m.join(n, "node_id", "left").withColumn("near", F.coalesce("near", F.array().cast(n.schema["near"].dataType)))


def star_fold(members: Column, near: Column) -> Column:
    """In order, a member joins the first representative it is near to, else it founds a group.
    Returns struct(reps, group): representatives and the group number of every member."""
    zero = F.struct(F.array().cast("array<bigint>").alias("reps"), F.array().cast("array<int>").alias("group"))

    def step(acc, x):
        # representatives ascend like the members, so the first one is the smallest
        first = F.array_min(F.transform(F.filter(near, lambda e: (e["j"] == x) & F.array_contains(acc["reps"], e["i"])), lambda e: e["i"]))
        reps = F.when(first.isNull(), F.array_append(acc["reps"], x)).otherwise(acc["reps"])
        num = F.when(first.isNull(), F.size(acc["reps"])).otherwise(F.array_position(acc["reps"], first) - 1).cast("int")
        return F.struct(reps.alias("reps"), F.array_append(acc["group"], num).alias("group"))

    return F.aggregate(members, zero, step)


def star_clusters(pilots: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Clusters of near-duplicate pilots around representatives: (node_id, pilot, cluster, is_rep)."""
    m = with_near(pilots, pairs, F.col("tv") < threshold).withColumn("f", star_fold(F.col("members"), F.col("near")))
    rows = m.select("node_id", "f.reps", F.inline(F.arrays_zip(F.col("members").alias("pilot"), F.col("f.group").alias("cluster"))))
    return rows.select("node_id", "pilot", "cluster", F.array_contains("reps", F.col("pilot")).alias("is_rep"))


def cluster_weights(clusters: DataFrame) -> DataFrame:
    """Multiplicity of the cluster and weight of its representative = size / pilots of the node."""
    rows = clusters.withColumns(
        {
            "multiplicity": F.count(F.lit(1)).over(Window.partitionBy("node_id", "cluster")),
            "total": F.count(F.lit(1)).over(Window.partitionBy("node_id")),
        }
    )
    return rows.withColumn("rep_weight", F.when(F.col("is_rep"), F.col("multiplicity") / F.col("total"))).drop("total")


def unique_pilots(pilots: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Survivors after dropping, again and again, the pilot with most near duplicates (larger index on ties)."""
    m = with_near(pilots, pairs, F.col("tv") < threshold)
    known = F.filter("near", lambda e: F.array_contains("members", e["i"]) & F.array_contains("members", e["j"]))

    def drop_one(acc, _):
        left = acc["left"]
        degree = lambda x: F.struct(F.size(F.filter(left, lambda e: (e["i"] == x) | (e["j"] == x))).alias("d"), x.alias("i"))
        ends = F.concat(F.transform(left, lambda e: e["i"]), F.transform(left, lambda e: e["j"]))
        worst = F.array_max(F.transform(ends, degree))["i"]
        fewer = F.filter(left, lambda e: (e["i"] != worst) & (e["j"] != worst))
        return F.when(F.size(left) > 0, F.struct(fewer.alias("left"), F.array_append(acc["gone"], worst).alias("gone"))).otherwise(acc)

    zero = F.struct(known.alias("left"), F.array().cast("array<bigint>").alias("gone"))
    m = m.withColumn("alive", F.when(F.size("near") > 0, F.array_except("members", F.aggregate("members", zero, drop_one)["gone"])).otherwise(F.col("members")))
    return m.select("node_id", F.explode("alive").alias("pilot"))


def predicted_k(kept: DataFrame, pilots: DataFrame) -> DataFrame:
    """Distinct continuing pilots (representatives or survivors) plus finished ones."""
    k = kept.groupBy("node_id").agg(F.count(F.lit(1)).alias("kept"))
    f = pilots.groupBy("node_id").agg(F.count_if("finished").alias("n_finished"))
    return f.join(k, "node_id", "left").select(
        "node_id", "n_finished", (F.coalesce("kept", F.lit(0)) + F.col("n_finished")).alias("predicted_k")
    )


def reuse_candidates(kept: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Seeded uniform draw of at most k survivors per node, never by score."""
    return first_k(kept, ["node_id"], [sample_key(seed, F.col("node_id"), F.col("pilot")), F.col("pilot")], k)


def share_targets(siblings: DataFrame, pairs: DataFrame, radius: float, limit: float) -> DataFrame:
    """A sibling is shared with the first earlier sibling that still expands and lies within the limit; a
    shared sibling is no target. Same fold as the clusters with its own closeness test."""
    m = with_near(siblings, pairs, F.col("tv") + radius <= limit).withColumn("f", star_fold(F.col("members"), F.col("near")))
    rows = m.select("node_id", F.col("f.reps").alias("reps"), F.inline(F.arrays_zip(F.col("members").alias("pilot"), F.col("f.group").alias("g"))))
    rep = F.element_at("reps", F.col("g") + 1)
    return rows.select(
        "node_id", "pilot", F.when(rep == F.col("pilot"), "expand").otherwise("share").alias("action"),
        F.when(rep != F.col("pilot"), rep).alias("target"),
    )


def pruning_trace(pairs: DataFrame, rewards: DataFrame, epsilon: float, duplicate: float, **bound) -> DataFrame:
    """Per pilot pair: distance, value bound, duplicate flag, prune candidate, whether the bound holds."""
    a = rewards.select("node_id", F.col("pilot").alias("i"), F.col("reward").alias("ri"))
    b = rewards.select("node_id", F.col("pilot").alias("j"), F.col("reward").alias("rj"))
    ub = value_gap_bound(F.col("tv"), **bound)
    return pairs.join(a, ["node_id", "i"]).join(b, ["node_id", "j"]).withColumns(
        {
            "bound": ub,
            "gap": F.abs(F.col("ri") - F.col("rj")),
            "duplicate": F.col("tv") < duplicate,
            "prune": ub <= epsilon,
            "holds": F.abs(F.col("ri") - F.col("rj")) <= ub,
        }
    )


def tail_ratio(d_l: Column, d_m: Column, delta: float) -> Column:
    return F.greatest(d_l - d_m, F.lit(0.0)) / (1.0 - d_m + delta)


def first_stable_horizon(horizons: list[int], d_m: dict[int, Column], eta: float) -> Column:
    """Smallest horizon whose change to the next is at most eta, else the last."""
    pick = F.lit(None).cast("int")
    for m, nxt in reversed(list(zip(horizons, horizons[1:]))):
        pick = F.when(F.abs(d_m[nxt] - d_m[m]) <= eta, F.lit(m)).otherwise(pick)
    return F.coalesce(pick, F.lit(horizons[-1]))


def branch_factor_from_perplexity(logps: Column, fallback: int = 2) -> Column:
    total = F.aggregate(logps, F.lit(0.0), lambda a, x: a + x)
    k = F.greatest(F.lit(2), F.ceil(F.exp(-total / F.size(logps))))
    return F.when(F.coalesce(F.size(logps), F.lit(0)) > 0, k).otherwise(F.lit(fallback))


def proxy(method: str, c: str = "c", variance: str = "variance", tv2: str = "tv2", external: str = "external") -> Column:
    """Dispersion proxy of a node by method name; missing columns of a method are an analysis error."""
    from ..functions.numeric import uniform

    return {
        "bound": lambda: F.greatest(F.col(c), F.lit(0.0)),
        "uniform": lambda: F.lit(1.0),
        "random": lambda: 1.0 - uniform(sample_key("proxy", F.col("node_id"))),
        "direct_tv": lambda: F.col(tv2),
        "empirical_variance": lambda: F.greatest(F.col(variance), F.lit(0.0)),
        "external": lambda: F.greatest(F.col(external), F.lit(0.0)),
    }[method]()


def eps_for_depth(depth: Column, table: dict[int, float], default: float) -> Column:
    """Tail epsilon of the nearest configured depth at or below a depth."""
    out = F.lit(float(default))
    for d in sorted(table):
        out = F.when(depth >= d, F.lit(float(table[d]))).otherwise(out)
    return out
