"""Advantages per prompt group, per token sequence and per reasoning step.

Group estimators take rollouts (uid, rollout_id, score, ...) and add `advantage`. Token estimators take
(rollout_id, pos, ...) rows; a token sequence is bounded by the response length limit, so it may be one
window partition, whereas a prompt group is not bounded and never is.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, sample_key, uniform
from .registry import ESTIMATORS
from .spread import attach_stats, first_k, join_stats, last_known, running_sum, scalar, value_bucket

KEYS = ["uid"]
ROW = ["rollout_id"]


def _with(df: DataFrame, aggs: dict[str, Column], advantage: Column) -> DataFrame:
    return attach_stats(df, KEYS, aggs, ROW).withColumn("advantage", advantage).drop(*aggs)


def _moments() -> dict[str, Column]:
    return {
        "g_n": F.count("score"),
        "g_mean": F.avg("score"),
        "g_std": F.stddev_samp("score"),
    }


def _cols():
    return F.col("score"), F.col("g_n"), F.col("g_mean"), F.col("g_std")


@ESTIMATORS.add("grpo")
def grpo(df: DataFrame, norm: bool = True, eps: float = 1e-6) -> DataFrame:
    """(s - mean) / (sample std + eps); a singleton uses mean 0 and std 1."""
    s, n, mean, std = _cols()
    m = F.when(n > 1, mean).otherwise(0.0)
    d = F.when(n > 1, std).otherwise(1.0)
    return _with(df, _moments(), (s - m) / (d + eps) if norm else s - m)


@ESTIMATORS.add("grpo_floored")
def grpo_floored(df: DataFrame, norm: bool = True, eps: float = 1e-6) -> DataFrame:
    """As grpo with the variance floored before the root."""
    s, n, mean, std = _cols()
    m = F.when(n > 1, mean).otherwise(0.0)
    d = F.when(n > 1, F.sqrt(F.greatest(std * std, F.lit(eps)))).otherwise(1.0)
    return _with(df, _moments(), (s - m) / (d + eps) if norm else s - m)


@ESTIMATORS.add("grpo_population")
def grpo_population(df: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Population std and no singleton rule."""
    aggs = {"g_mean": F.avg("score"), "g_std": F.stddev_pop("score")}
    return _with(df, aggs, (F.col("score") - F.col("g_mean")) / (F.col("g_std") + eps))


@ESTIMATORS.add("pass_at_k")
def pass_at_k(df: DataFrame, norm: bool = True, eps: float = 1e-6) -> DataFrame:
    """Only the best response gets max - second; a group of one is invalid (null advantage)."""
    best = [F.desc("score"), F.asc("rollout_id")]
    two = (
        first_k(df.select("uid", "rollout_id", "score"), KEYS, best, 2, "__r")
        .groupBy("uid")
        .agg(
            F.max_by("rollout_id", -F.col("__r")).alias("rollout_id"),
            (F.max("score") - F.min("score")).alias("gap"),
        )
        .select("rollout_id", "gap")
    )
    rows = attach_stats(df, KEYS, {"g_n": F.count("score"), "g_std": F.stddev_samp("score")}, ROW)
    gap = F.coalesce(F.col("gap"), F.lit(0.0))
    value = gap / (F.col("g_std") + eps) if norm else gap
    return (
        rows.join(two, "rollout_id", "left")
        .withColumn("advantage", F.when(F.col("g_n") > 1, value))
        .drop("gap", "g_n", "g_std")
    )


@ESTIMATORS.add("rloo")
def rloo(df: DataFrame) -> DataFrame:
    s, n, mean, _ = _cols()
    return _with(df, _moments(), F.when(n > 1, n / (n - 1) * (s - mean)).otherwise(s))


@ESTIMATORS.add("rloo_sum")
def rloo_sum(df: DataFrame) -> DataFrame:
    """(n s - sum) / (n - 1); singleton 0."""
    s, n = F.col("score"), F.col("g_n")
    aggs = {"g_n": F.count("score"), "g_sum": F.sum("score")}
    return _with(df, aggs, F.when(n > 1, (n * s - F.col("g_sum")) / (n - 1)).otherwise(0.0))


@ESTIMATORS.add("rloo_others")
def rloo_others(df: DataFrame) -> DataFrame:
    """s minus the mean of the others, which is 0 when there are none."""
    s, n = F.col("score"), F.col("g_n")
    aggs = {"g_n": F.count("score"), "g_sum": F.sum("score")}
    return _with(df, aggs, s - F.when(n > 1, (F.col("g_sum") - s) / (n - 1)).otherwise(0.0))


@ESTIMATORS.add("opo")
def opo(df: DataFrame) -> DataFrame:
    """Length-weighted baseline; singleton baseline 0."""
    aggs = {
        "g_n": F.count("score"),
        "g_base": F.sum(F.col("n_tokens") * F.col("score")) / F.sum("n_tokens"),
    }
    return _with(df, aggs, F.col("score") - F.when(F.col("g_n") > 1, F.col("g_base")).otherwise(0.0))


@ESTIMATORS.add("gpg")
def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """alpha (s - mean) / f_norm with alpha = rows / non-zero scores over the whole batch."""
    alpha = scalar(df, F.count(F.lit(1)) / F.greatest(F.count_if(F.col("score") != 0), F.lit(1)))
    s, n, mean, _ = _cols()
    return _with(df, _moments(), alpha * (s - F.when(n > 1, mean).otherwise(0.0)) / f_norm)


def whiten(df: DataFrame, x: str, weight: Column, name: str, shift_mean: bool = True, unbiased: bool = True, center: bool = True):
    """(x - mean) / sqrt(var + 1e-8) over weighted rows; a weight is a token count or a 0/1 mask.

    The mean divides by count + 1e-8. `center=False` only divides by the deviation.
    """
    w, v = weight.cast("double"), F.col(x)
    n, s1 = scalar(df, F.sum(w)), scalar(df, F.sum(w * v))
    mean = s1 / (n + 1e-8)
    var = scalar(df.withColumn("__m", mean), F.sum(w * F.pow(v - F.col("__m"), F.lit(2.0)))) / (n + 1e-8)
    if unbiased:
        var = var * n / (n - 1)
    scaled = (v - mean if center else v) / F.sqrt(var + 1e-8)
    return df.withColumn(name, scaled if shift_mean or not center else scaled + mean)


@ESTIMATORS.add("reinforce_baseline")
def reinforce_baseline(df: DataFrame) -> DataFrame:
    """Centre by the group mean, then whiten over all tokens (each response counts its tokens)."""
    s, n, mean, _ = _cols()
    rows = _with(df, _moments(), s - F.when(n > 1, mean).otherwise(0.0))
    return whiten(rows, "advantage", F.col("n_tokens"), "advantage")


def soft_mean_baseline(df: DataFrame, beta: float = 1.0) -> DataFrame:
    """s - (logsumexp(beta s) - ln n) / beta over the whole batch; beta 0 is the mean."""
    s = F.col("score")
    if beta == 0:
        return df.withColumn("advantage", s - scalar(df, F.avg("score")))
    top = scalar(df, F.max(s * beta))
    total = scalar(df.withColumn("__t", top), F.sum(F.exp(s * beta - F.col("__t"))))
    n = scalar(df, F.count("score"))
    return df.withColumn("advantage", s - (F.log(total) + top - F.log(n)) / beta)


def scale_scores(df: DataFrame, subtract_mean: bool = True, bound: float | None = 5.0, eps: float = 2.220446049250313e-16):
    """Scale by the sample std of the batch (plus machine epsilon), optionally centred and clipped."""
    mean, std = scalar(df, F.avg("score")), scalar(df, F.stddev_samp("score"))
    x = (F.col("score") - mean if subtract_mean else F.col("score")) / (std + eps)
    return df.withColumn("advantage", clip(x, -bound, bound) if bound else x)


def resample_by_score(df: DataFrame, method: str = "pow", power: float = 2.0, seed: int = 0) -> DataFrame:
    """As many draws as rows, with replacement, with probability proportional to a score weight.

    Returns (draw, rollout_id). Running integer weights give every row an interval of a line and draw i
    lands on a hashed position; each draw takes the last interval start at or before it. Both steps work
    per bucket of the line with carried offsets, so no task sees all rows.
    """
    s = F.col("score")
    if method == "pow":
        w = F.pow(F.abs(s), F.lit(power))
    elif method == "max_min":
        hi, lo = scalar(df, F.max("score")), scalar(df, F.min("score"))
        w = F.when((s == hi) | (s == lo), 1.0).otherwise(0.0)
    elif method == "max_random":
        w = F.when(s == scalar(df, F.max("score")), 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown method {method!r}")
    whole = "decimal(38,0)"
    rows = df.withColumn("__w", F.greatest(w + 1e-8, F.lit(1e-8)))
    # integer weights: the running sums do not depend on the order of addition
    rows = rows.withColumn("__w", F.greatest(F.round(F.col("__w") * 1e9).cast(whole), F.lit(1).cast(whole)))
    total = scalar(rows, F.sum("__w"))
    line = running_sum(
        rows, [], [F.col("rollout_id")], value_bucket(df, F.col("rollout_id"), parts=4096), {"__hi": F.col("__w")}
    )
    starts = line.select((F.col("__hi") - F.col("__w")).cast(whole).alias("at"), F.lit(None).cast("bigint").alias("draw"), "rollout_id")
    at = uniform(sample_key(seed, F.col("rollout_id"))) * total.cast("double")
    draws = df.select(
        (at - at % 1).cast(whole).alias("at"),
        F.col("rollout_id").alias("draw"),
        F.lit(None).cast("bigint").alias("rollout_id"),
    )
    both = starts.unionByName(draws).withColumn("__kind", F.when(F.col("draw").isNull(), 0).otherwise(1))
    cell = F.least(F.floor(F.col("at").cast("double") / total.cast("double") * 4096), F.lit(4095)).cast("int")
    hit = last_known(both, [], [F.col("at"), F.col("__kind")], cell, F.col("rollout_id"), "picked")
    return hit.where(F.col("draw").isNotNull()).select("draw", F.col("picked").alias("rollout_id"))


# --- token sequences ----------------------------------------------------------------------------------


def _from_end(*keys: str, order: str = "pos"):
    """Running window from the last token backwards (a running frame, not an unbounded-following one)."""
    return Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)


def _discounted(x: Column, gamma: float, window, pos: Column) -> Column:
    """sum over later s of gamma**(s - t) x_s. Valid while gamma**length stays in the double range."""
    if gamma == 1.0:
        return F.sum(x).over(window)
    g = F.lit(float(gamma))
    return F.sum(x * F.pow(g, pos)).over(window) / F.pow(g, pos)


def discounted_returns(tokens: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Return from each token to the end, restarted at masked tokens."""
    seg = Window.partitionBy("rollout_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("__seg", F.sum(1 - F.col("mask")).over(seg))
    ret = _discounted(F.col("reward"), gamma, _from_end("rollout_id", "__seg"), F.col("pos"))
    return rows.withColumn("ret", ret).drop("__seg")


def reinforce(tokens: DataFrame, gamma: float = 1.0) -> DataFrame:
    rows = discounted_returns(tokens, gamma)
    return whiten(rows, "ret", F.col("mask"), "advantage").withColumn("advantage", F.col("advantage") * F.col("mask"))


def remax(tokens: DataFrame, baselines: DataFrame) -> DataFrame:
    """Reward still to come minus the baseline reward of the response's prompt (rollout_id, baseline)."""
    rows = tokens.withColumn("ret", F.sum(F.col("reward") * F.col("mask")).over(_from_end("rollout_id")))
    return rows.join(baselines, "rollout_id").withColumn("advantage", (F.col("ret") - F.col("baseline")) * F.col("mask"))


def gae(tokens: DataFrame, gamma: float = 1.0, lam: float = 0.95, whitened: bool = True) -> DataFrame:
    """Generalised advantage over unmasked tokens; masked tokens pass value and accumulator through.

    Passing through means the recurrence runs over the unmasked tokens alone, so those are renumbered.
    """
    seq = Window.partitionBy("rollout_id").orderBy("pos")
    rows = tokens.where(F.col("mask") == 1).withColumn("__i", F.row_number().over(seq) - 1)
    delta = (
        F.col("reward") + gamma * F.coalesce(F.lead("value").over(seq), F.lit(0.0)) - F.col("value")
    )
    rows = rows.withColumn("__delta", delta)
    adv = _discounted(F.col("__delta"), gamma * lam, _from_end("rollout_id", order="__i"), F.col("__i"))
    rows = rows.withColumn("advantage", adv).withColumn("ret", F.col("advantage") + F.col("value"))
    rows = rows.drop("__i", "__delta")
    return whiten(rows, "advantage", F.lit(1), "advantage") if whitened else rows


def gae_plain(
    tokens: DataFrame, gamma=1.0, lam=0.95, beta=0.0, whiten_rewards=False, mode: str = "whiten"
) -> DataFrame:
    """Variant without pass-through: rewards are -beta KL plus the score at the last token, masked tokens
    contribute no reward but stay in the recurrence; also the plain discounted return `ret`."""
    seq = Window.partitionBy("rollout_id").orderBy("pos")
    r = (F.col("reward") - beta * (F.col("old_lp") - F.col("ref_lp"))) * F.col("mask")
    rows = tokens.withColumn("__r", r)
    if whiten_rewards:
        rows = whiten(rows, "__r", F.col("mask"), "__r", shift_mean=False)
    delta = F.col("__r") + gamma * F.coalesce(F.lead("value").over(seq), F.lit(0.0)) - F.col("value")
    rows = rows.withColumn("__delta", delta)
    back = _from_end("rollout_id")
    rows = rows.withColumns(
        {
            "advantage": _discounted(F.col("__delta"), gamma * lam, back, F.col("pos")),
            "ret": _discounted(F.col("__r"), gamma, back, F.col("pos")),
        }
    ).drop("__delta", "__r")
    if mode == "none":
        return rows
    return whiten(rows, "advantage", F.col("mask"), "advantage", center=mode == "whiten")


def mixed_rloo(tokens: DataFrame, rollouts: DataFrame, dense_coef: float, outcome_coef: float) -> DataFrame:
    """Leave-one-out on dense token rewards and on the final outcome, weighted, summed to the end, whitened.

    Group size is the observed number of responses of the prompt; singletons are left out.
    """
    rows = tokens.join(rollouts.select("rollout_id", "uid", "correct"), "rollout_id")
    one = rows.groupBy("uid", "rollout_id").agg(
        F.avg(F.when(F.col("mask") == 1, F.col("dense"))).alias("mean_dense"), F.first("correct").alias("outcome")
    )
    group = one.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("mean_dense").alias("sd"), F.sum("outcome").alias("so")
    )
    rows = join_stats(rows, group.withColumn("__n", F.col("n")), ["uid"], ["rollout_id", "pos"]).drop("__n")
    rows = rows.where(F.col("n") > 1)
    seq = Window.partitionBy("rollout_id").orderBy("pos")
    last = F.lead("pos").over(seq).isNull()
    n = F.col("n")
    dense = F.when(F.col("mask") == 1, F.col("dense") * n / (n - 1) - F.col("sd") / (n - 1)).otherwise(0.0)
    outcome = F.when(last, F.col("correct") * n / (n - 1) - F.col("so") / (n - 1)).otherwise(0.0)
    rows = rows.withColumn("__r", (dense_coef * dense + outcome_coef * outcome) * F.col("mask"))
    rows = rows.withColumn("ret", F.sum("__r").over(_from_end("rollout_id"))).drop("__r", "n", "sd", "so")
    return whiten(rows, "ret", F.col("mask"), "advantage")


# --- reasoning steps ----------------------------------------------------------------------------------


def step_advantages(steps: DataFrame) -> DataFrame:
    """r_t + V_{t+1} - V_t for steps (rollout_id, step, reward, value); the value after the last step is 0
    and a trailing run of unknown values is filled with the reward still to come."""
    back = _from_end("rollout_id", order="step")
    seq = Window.partitionBy("rollout_id").orderBy("step")
    known_after = F.max(F.when(F.col("value").isNotNull(), F.col("step"))).over(back)
    rows = steps.withColumn("__rest", F.sum("reward").over(back)).withColumn("__known", known_after)
    filled = F.when(F.col("value").isNull() & F.col("__known").isNull(), F.col("__rest")).otherwise(F.col("value"))
    rows = rows.withColumn("filled", filled)
    nxt = F.when(F.lead("step").over(seq).isNull(), 0.0).otherwise(F.lead("filled").over(seq))
    return rows.withColumn("advantage", F.col("reward") + nxt - F.col("filled")).drop("__rest", "__known")


def spread_steps_to_tokens(steps: DataFrame, tokens: DataFrame) -> DataFrame:
    """Give each token the advantage of the step whose [start, end) holds its first character.

    Equality join on the response, then the range test: both sides are bounded by one response.
    """
    inside = (F.col("char_start") >= F.col("step_start")) & (F.col("char_start") < F.col("step_end"))
    return tokens.join(steps, "rollout_id").where(inside)


def cut_points(tokens: DataFrame, threshold: float = 0.9, every: int = 1) -> DataFrame:
    """Positions before uncertain tokens (probability below the threshold), every n-th of them."""
    seq = Window.partitionBy("rollout_id").orderBy("pos")
    rows = tokens.where(F.exp("old_lp") < threshold).withColumn("__i", F.row_number().over(seq) - 1)
    return rows.where(F.col("__i") % every == 0).select("rollout_id", (F.col("pos") - 1).alias("cut"))


def segment_advantages(tokens: DataFrame, cuts: DataFrame, scores: DataFrame) -> DataFrame:
    """Advantage between consecutive known values: cuts (rollout_id, cut, cut_value) plus the score at the
    last token. A cut at -1 is the base; without it the first known value has advantage 0. Unknown tokens
    take the next known advantage; confident tokens (probability > 0.9) get 0; without any cut all are 0."""
    seq = Window.partitionBy("rollout_id").orderBy("pos")
    has_cut = cuts.groupBy("rollout_id").agg(
        F.max(F.when(F.col("cut") == -1, F.col("cut_value"))).alias("base"), F.lit(True).alias("has_cut")
    )
    rows = (
        tokens.join(cuts.withColumnRenamed("cut", "pos"), ["rollout_id", "pos"], "left")
        .join(has_cut, "rollout_id", "left")
        .join(scores, "rollout_id")
    )
    # a cut overwrites the score when both fall on the last token
    last = F.lead("pos").over(seq).isNull()
    rows = rows.withColumn("known", F.coalesce(F.col("cut_value"), F.when(last, F.col("score"))))
    prev = F.last("known", ignorenulls=True).over(seq.rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(
        F.col("known").isNotNull(), F.coalesce(F.col("known") - F.coalesce(prev, F.col("base")), F.lit(0.0))
    )
    rows = rows.withColumn("__a", step)
    nxt = F.last("__a", ignorenulls=True).over(_from_end("rollout_id"))
    adv = F.when(F.col("has_cut").isNull() | (F.exp("old_lp") > 0.9), 0.0).otherwise(nxt)
    return rows.withColumn("advantage", adv).drop("__a", "base", "has_cut", "known")


def monte_carlo_values(df: DataFrame, keys: list[str], reward: Column, empty: float = 0.0) -> DataFrame:
    """Value of a state: mean reward of its rollouts, population deviation and count."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(reward), F.lit(empty)).alias("value"),
        F.coalesce(F.stddev_pop(reward), F.lit(-1.0)).alias("value_std"),
        F.count(reward).alias("n_rollouts"),
    )
