"""Preference pairs and ranking measures. Pairs of an unbounded group are counted, never listed."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import sample_key, sigmoid, stable_id
from ..session import materialise
from .spread import attach_stats, hash_bucket, join_stats, ranked, running_sum, value_bucket, value_counts

# Rows of one task where pairs are counted in the order of their ranks.
RANKED_ROWS = 1 << 18


def sample_pairs(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """At most k accept x reject pairs per question from (question_id, item, accept).

    The a*r pairs of a question are numbered; k evenly spaced numbers from a hashed start are turned back
    into an accept rank and a reject rank. Work is k rows per question however large the question is.
    """
    key = sample_key(seed, F.col("item"))
    side = ranked(
        df.withColumn("__k", key), ["question_id", "accept"], [F.col("__k"), F.col("item")], hash_bucket(F.col("__k"), 2), "r"
    ).drop("__k")
    n = df.groupBy("question_id").agg(F.count_if("accept").alias("a"), F.count_if(~F.col("accept")).alias("b"))
    n = n.withColumn("all", F.col("a") * F.col("b")).where(F.col("all") > 0)
    n = n.withColumn("m", F.least(F.lit(k).cast("bigint"), F.col("all")))
    t = n.withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    start = F.pmod(stable_id(F.concat_ws("|", F.lit(str(seed)), F.col("question_id"))), F.col("all"))
    t = t.withColumn("pick", F.pmod(start + F.col("t") * F.floor(F.col("all") / F.col("m")), F.col("all")))
    t = t.select(
        "question_id", (F.floor(F.col("pick") / F.col("b")) + 1).alias("ra"), (F.pmod("pick", "b") + 1).alias("rb")
    )
    acc = side.where("accept").select("question_id", F.col("r").alias("ra"), F.col("item").alias("accept_item"))
    rej = side.where("NOT accept").select("question_id", F.col("r").alias("rb"), F.col("item").alias("reject_item"))
    return t.join(acc, ["question_id", "ra"]).join(rej, ["question_id", "rb"]).select("question_id", "accept_item", "reject_item")


def opposite_targets(df: DataFrame) -> DataFrame:
    """For a correct rollout the mean score of the wrong ones of its prompt and vice versa, 0 if none;
    `correct` is 0/1, so the strictly worse (better) ones are the other side."""
    aggs = {
        "m0": F.avg(F.when(F.col("correct") == 0, F.col("score"))),
        "m1": F.avg(F.when(F.col("correct") == 1, F.col("score"))),
    }
    rows = attach_stats(df, ["uid"], aggs, ["rollout_id"])
    other = F.coalesce(F.when(F.col("correct") == 1, F.col("m0")).otherwise(F.col("m1")), F.lit(0.0))
    return rows.withColumn("target", other).drop("m0", "m1")


def best_of_n_weight(df: DataFrame) -> DataFrame:
    """n * P(score_j <= score_i)^(n-1) within the prompt, from counts per distinct score."""
    cum = value_counts(df, ["uid"], F.col("score")).select(
        "uid", F.col("v").alias("score"), F.col("c").alias("__n"), F.col("hi").alias("le")
    )
    n = df.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("__n"))
    cum = join_stats(cum.withColumnRenamed("__n", "c"), n, ["uid"], ["score"]).drop("__n").withColumnRenamed("c", "__n")
    cum = cum.withColumn("weight", F.col("n") * F.pow(F.col("le") / F.col("n"), F.col("n") - 1))
    return join_stats(df, cum.drop("le", "n"), ["uid", "score"], ["rollout_id"]).drop("__n")


def detached_loss(df: DataFrame, beta: float = 1.0) -> DataFrame:
    rows = opposite_targets(df)
    sign = F.col("correct") * 2.0 - 1.0
    return rows.withColumn("loss", -F.log(sigmoid(beta * (F.col("score") - F.col("target")) * sign)))


def ranking_accuracy(df: DataFrame) -> DataFrame:
    """Share of (correct, wrong) pairs of a prompt that the score ranks right; 0.5 when all are equal.

    Pairs are counted, not listed: wrong rows at lower scores come from running counts over the distinct
    scores, wrong rows at the same score count when they stand earlier (running counts by position).
    """
    wrong = 1 - F.col("correct")
    tie = running_sum(
        df, ["uid", "score"], [F.col("rollout_id")], value_bucket(df, F.col("rollout_id")), {"tied": wrong}
    )
    level = tie.groupBy("uid", "score").agg(
        F.sum("correct").alias("good"), F.sum(wrong).alias("bad"), F.sum(F.col("correct") * F.col("tied")).alias("tied")
    )
    run = running_sum(level, ["uid"], [F.col("score")], value_bucket(level, F.col("score")), {"upto": F.col("bad")})
    hits = F.sum(F.col("good") * (F.col("upto") - F.col("bad")) + F.col("tied"))
    pairs = F.sum("good") * F.sum("bad")
    return run.groupBy("uid").agg(F.coalesce(hits / F.nullif(pairs, F.lit(0)), F.lit(0.5)).alias("accuracy"))


def gap_sums(df: DataFrame, keys: list[str], value: str, parts: int = 256, weight: str | None = None) -> DataFrame:
    """Sum of the differences of `value` over all pairs of a group (keys, total), from running counts of distinct values.
    `weight`: how many rows a row stands for."""
    levels = df.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("c"))
    v, c = F.col(value), F.col("c")
    run = running_sum(levels, keys, [v], value_bucket(levels, v, parts), {"upto": c, "mass": c * v})
    return run.groupBy(*keys).agg(F.sum(c * (v * (F.col("upto") - c) - (F.col("mass") - c * v))).alias("total"))


def dominance_sums(df: DataFrame, keys: list[str], rank: str, value: str, size: str, parts: int = 256, weight: str | None = None) -> DataFrame:
    """Sum of (value_h - value_l) over the pairs of a group that `rank` and `value` order alike: rank_l < rank_h and
    value_l < value_h. Two-dimensional dominance, without pair rows: (keys, alike).

    rank: 0 .. size - 1 in the group; `weight`: how many rows a row stands for. Two ranks differ first in one binary digit; at that digit's level both stand in the
    block of equal higher digits, the lower in its left half, the higher in its right. So each pair belongs to one block of
    one level, and a block needs only running counts and sums of its left half over the distinct values. A row takes part
    in at most log2(size) levels, those where its block has a right half. Blocks are pre-aggregated by value, and their
    running sums are cut into order buckets, so that the block of a hot group's top level is many tasks' work.
    """
    r, n = F.col(rank), F.col(size)
    levels = F.filter(F.sequence(F.lit(0), F.lit(61)), lambda d: F.call_function("shiftright", n - 1, d) > 0)
    rows = df.where(n > 1).select(*keys, r.alias("r"), n.alias("n"), F.col(value).alias("v"), (F.col(weight) if weight else F.lit(1)).alias("w"), F.explode(levels).alias("digit"))
    block = F.expr("shiftright(r, digit + 1)")
    right = F.expr("shiftright(r, digit) & 1")
    rows = rows.withColumn("block", block).where(F.expr("shiftleft(block, digit + 1) + shiftleft(1L, digit) <= n - 1"))
    inner = [*keys, "digit", "block"]
    cells = rows.groupBy(*inner, "v").agg(F.sum((1 - right) * F.col("w")).alias("left"), F.sum(right * F.col("w")).alias("right"))
    v, left = F.col("v"), F.col("left")
    run = running_sum(cells, inner, [v], value_bucket(df.select(F.col(value).alias("v")), F.col("v"), parts), {"count": left, "mass": left * v})
    # values are distinct in a block, so what the cell itself adds counts as equal: (v - v) * left = 0
    return run.groupBy(*keys).agg(F.sum(F.col("right") * (v * F.col("count") - F.col("mass"))).alias("alike"))


def _alike(group: np.ndarray, value: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the pairs of rows of each group: of (later - earlier) value where the later is larger, and of all differences.

    group: ascending numbers below `groups`. Rows stand for their ranks; two of them differ first in one binary digit, as in
    `dominance_sums`. Values are taken from the group's least and by its range, so that groups do not touch each other's digits.
    """
    alike, total = np.zeros(groups), np.zeros(groups)
    if not len(group):
        return alike, total
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(begin, len(group)))
    start, many = np.repeat(begin, size), np.repeat(size, size)
    at = np.arange(len(group)) - start
    least = np.minimum.reduceat(value, begin)
    width = np.ldexp(1.0, np.frexp(np.maximum.reduceat(value, begin) - least)[1])  # a power of two: no digit is lost
    v = (value - np.repeat(least, size)) / np.repeat(width, size)
    order, digit = np.lexsort((v, group)), 0
    while True:
        order = order[many[order] > 1 << digit]  # groups with a right half at this digit
        if not len(order):
            break
        block = (start + (at >> digit + 1))[order]
        rows = order[np.argsort(block, kind="stable")]
        block, right = np.sort(block), (at[rows] >> digit) & 1
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        each = np.diff(np.append(first, len(block)))
        below = lambda x: np.cumsum(x) - np.repeat((np.cumsum(x) - x)[first], each)  # noqa: E731  running sums inside blocks
        gain = right * (v[rows] * below(1 - right) - below((1 - right) * v[rows]))
        alike += np.bincount(group[rows], gain, groups)
        digit += 1
    net = np.bincount(group, v * (2 * at - (many - 1)), groups)  # later minus earlier, over all pairs
    scale = np.zeros(groups)
    scale[group[begin]] = width
    return alike * scale, (2 * alike - net) * scale


def _pair_sums(batches):
    """The sums of the groups of a task whose rows come in the order of (uid, rank). The first and the last group may go on in
    other tasks: their `total` stays null, and the task's counts of their values follow as cells (seg, v, c)."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts).combine_chunks()
    names = pa.concat_arrays(rows.column("uid").chunks).dictionary_encode("encode")  # a null uid is one like any other
    code, known = names.indices.to_numpy(), rows.column("known").to_numpy()
    groups, acc = len(names.dictionary), rows.column("acc").to_numpy()[known]
    alike, total = _alike(code[known], acc, groups)
    edge = np.zeros(groups, bool)
    edge[[0, -1]] = True
    fields = ["uid", "seg", "v", "c", "alike", "total"]
    kinds = [names.dictionary.type, pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
    none = [pa.nulls(groups, k) for k in kinds]
    yield pa.RecordBatch.from_arrays([names.dictionary, *none[1:4], pa.array(alike), pa.array(total, mask=edge)], names=fields)
    for g in np.flatnonzero(edge):
        values, counts = np.unique(acc[code[known] == g], return_counts=True)
        none = [pa.nulls(len(values), k) for k in kinds]
        uid = names.dictionary.take(pa.array(np.full(len(values), g)))
        yield pa.RecordBatch.from_arrays([uid, pa.array(np.full(len(values), TaskContext.get().partitionId(), np.int64)), pa.array(values), pa.array(counts.astype(np.int64)), *none[4:]], names=fields)


def weighted_ranking_accuracy(df: DataFrame) -> DataFrame:
    """Share of a prompt's pairs that the score ranks like the accuracy, weighted by the pair's difference in accuracy; 0.5
    where no pair differs. (uid, accuracy) from (uid, rollout_id, score, acc) with soft accuracies.

    A pair of equal scores counts as ranked right if the more accurate rollout stands later (by rollout_id). That is the
    order of (score, rollout_id), so the right pairs are those which that order and the accuracy order alike. Rows without
    score or accuracy take no part.

    All rows are sorted by range of (uid, score, rollout_id), about RANKED_ROWS a task, which counts the pairs inside it. At
    most two prompts of a task go on in others; pairs of theirs across tasks come from counts of each task's distinct values.
    """
    score, acc = F.col("score").cast("double"), F.col("acc").cast("double")
    known = score.isNotNull() & acc.isNotNull()
    order = ["uid", "score", "rollout_id"]
    rows = df.select("uid", "rollout_id", F.when(known, score).alias("score"), F.when(known, acc).otherwise(0.0).alias("acc"), known.alias("known"))
    tasks = -(-rows.count() // RANKED_ROWS) or 1
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("uid", "acc", "known")
    kind = df.schema["uid"].dataType.simpleString()
    parts = materialise(rows.mapInArrow(_pair_sums, f"uid {kind}, seg bigint, v double, c bigint, alike double, total double"), "pairs")
    cells = parts.where("c IS NOT NULL").select("uid", "seg", "v", "c", F.lit(tasks).cast("bigint").alias("size"))
    across, gaps = dominance_sums(cells, ["uid"], "seg", "v", "size", weight="c"), gap_sums(cells, ["uid"], "v", weight="c")
    split = parts.where("c IS NULL AND total IS NULL").select("uid", "alike").unionByName(across).unionByName(gaps, allowMissingColumns=True)
    split = split.groupBy("uid").agg(F.sum("alike").alias("alike"), F.sum("total").alias("total"))
    sums = parts.where("total IS NOT NULL").select("uid", "alike", "total").unionByName(split)
    share = F.coalesce(F.col("alike"), F.lit(0.0)) / F.nullif("total", F.lit(0.0))
    return sums.select("uid", F.coalesce(share, F.lit(0.5)).alias("accuracy"))


def action_ranking(df: DataFrame) -> DataFrame:
    """Share of action pairs of a state with (gt_i - gt_j)(pred_i - pred_j) > 0. The actions of a state are the
    branches of one node, so the pair join within a state is bounded by the branch factor."""
    a = df.select("state", F.col("action").alias("i"), F.col("gt").alias("gi"), F.col("pred").alias("pi"))
    b = df.select("state", F.col("action").alias("j"), F.col("gt").alias("gj"), F.col("pred").alias("pj"))
    good = (F.col("gi") - F.col("gj")) * (F.col("pi") - F.col("pj")) > 0
    return a.join(b, "state").where("i < j").groupBy("state").agg(F.avg(good.cast("double")).alias("accuracy"))


def adjacent_preference(df: DataFrame) -> DataFrame:
    """Rows in position order form pairs (1,2), (3,4), ...; the higher score is chosen, the first on ties."""
    rows = ranked(df, [], [F.col("rollout_id")], value_bucket(df, F.col("rollout_id"), parts=1024), "n")
    rows = rows.withColumn("pair_id", F.floor((F.col("n") - 1) / 2))
    order = F.struct("score", -F.col("n"))
    return rows.groupBy("pair_id").agg(
        F.max_by("rollout_id", order).alias("chosen"),
        F.when(F.count(F.lit(1)) > 1, F.min_by("rollout_id", order)).alias("rejected"),
    )


def preference_loss(df: DataFrame, beta: float = 0.1, smoothing: float = 0.0, kind: str = "sigmoid") -> DataFrame:
    """Preference report on stored log-probs: chosen/rejected under the policy and the reference."""
    margin = (F.col("chosen_lp") - F.col("rejected_lp")) - (F.col("chosen_ref") - F.col("rejected_ref"))
    if kind == "sigmoid":
        loss = -F.log(sigmoid(beta * margin)) * (1 - smoothing) - F.log(sigmoid(-beta * margin)) * smoothing
    elif kind == "ipo":
        loss = F.pow(margin - 1 / (2 * beta), F.lit(2.0))
    else:
        raise ValueError(f"unknown loss {kind!r}")
    return df.withColumn("margin", margin).withColumn("loss", loss)


def shortest_gap_pairs(df: DataFrame, fraction: float) -> DataFrame:
    """Sibling pairs by smallest score gap, max(1, round(w*w*f)) of them (all at most). Siblings of a parent
    are bounded by the branch factor."""
    a = df.select("parent", F.col("child").alias("i"), F.col("score").alias("si"))
    b = df.select("parent", F.col("child").alias("j"), F.col("score").alias("sj"))
    width = df.groupBy("parent").agg(F.count(F.lit(1)).alias("w"))
    pairs = a.join(b, "parent").where("i < j").withColumn("gap", F.abs(F.col("si") - F.col("sj"))).join(width, "parent")
    rank = F.row_number().over(Window.partitionBy("parent").orderBy("gap", "i", "j"))
    budget = F.greatest(F.lit(1), F.bround(F.col("w") * F.col("w") * fraction))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= budget)
