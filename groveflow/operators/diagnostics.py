"""Policy diagnostics over token log-probs (rollout_id, pos, old_lp, rollout_lp, ref_lp, mask, ...)."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..session import materialise
from .registry import DIAGNOSTICS
from .spread import add_row, exact_quantiles, scalar

BOUND = 20.0
EPS = 1e-8


def masked_mean(x: Column, m: Column) -> Column:
    """Aggregate: masked sum over the mask count plus 1e-8."""
    return F.sum(x * m) / (F.sum(m) + EPS)


def prob_mask(lp: Column, threshold: float = 0.9) -> Column:
    """Active iff the log-prob is strictly below ln(threshold)."""
    return lp < math.log(threshold)


def importance_weights(
    tokens: DataFrame, level: str = "token", mode: str = "truncate", upper: float = 2.0, lower: float | None = None, veto: float | None = 1e-4
) -> DataFrame:
    """`weight` between the training and the rollout policy per token, sequence sum or geometric mean.

    A sequence is bounded by the response length, so its sums are one window partition. `raw` is the weight
    before truncation, masking and veto.
    """
    lower = 1.0 / upper if lower is None else lower
    seq = Window.partitionBy("rollout_id")
    r, m = F.col("old_lp") - F.col("rollout_lp"), F.col("mask")
    if level == "token":
        log = r
    elif level == "sequence":
        log = F.sum(r * m).over(seq)
    elif level == "geometric":
        log = F.sum(r * m).over(seq) / (F.sum(m).over(seq) + EPS)
    else:
        raise ValueError(f"unknown level {level!r}")
    rows = tokens.withColumn("log_weight", log).withColumn("raw", F.exp(clip(F.col("log_weight"), -BOUND, BOUND)))
    raw = F.col("raw")
    if mode == "truncate":
        w = F.least(raw, F.lit(upper))
    elif mode == "mask":
        w = F.when((raw >= lower) & (raw <= upper), raw).otherwise(0.0)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if veto is not None:
        bad = F.max(((r < math.log(veto)) & (m == 1)).cast("int")).over(seq)
        w = F.when(bad == 1, 0.0).otherwise(w)
    return rows.withColumn("weight", w * m)


def weight_metrics(rows: DataFrame, upper: float = 2.0, lower: float | None = None) -> DataFrame:
    """Mean, extremes, deviation of clamped weights, effective sample size, sequence means, tails, quantiles."""
    lower = 1.0 / upper if lower is None else lower
    rows = materialise(rows.select("rollout_id", "raw", "mask"), "weights")  # four passes read it
    w, m = F.col("raw"), F.col("mask")
    c = clip(w, lower, upper)
    on = m == 1
    tok = rows.agg(
        masked_mean(w, m).alias("mean"),
        F.max(F.when(on, w)).alias("max"),
        F.min(F.when(on, w)).alias("min"),
        masked_mean((w > upper).cast("double"), m).alias("share_high"),
        masked_mean((w < lower).cast("double"), m).alias("share_low"),
        masked_mean(c, m).alias("__mc"),
        masked_mean(c * c, m).alias("__mc2"),
    )
    tok = tok.withColumns(
        {
            "std": F.sqrt(F.greatest(F.col("__mc2") - F.col("__mc") * F.col("__mc"), F.lit(0.0))),
            "eff_sample_size": F.pow(F.col("__mc") + EPS, F.lit(2.0)) / F.col("__mc2"),
        }
    ).drop("__mc", "__mc2")
    per = rows.groupBy("rollout_id").agg(masked_mean(w, m).alias("s"))
    seq = per.agg(
        F.avg("s").alias("seq_mean"),
        F.stddev_samp("s").alias("seq_std"),
        F.max("s").alias("seq_max"),
        F.min("s").alias("seq_min"),
        F.max(F.abs(F.col("s") - 1)).alias("seq_max_deviation"),
        F.avg((F.col("s") > upper).cast("double")).alias("seq_share_high"),
        F.avg((F.col("s") < lower).cast("double")).alias("seq_share_low"),
    )
    probs = [0.25, 0.5, 0.75, 0.95, 0.99]
    q = exact_quantiles(rows.where(on), w, probs)
    q = q.agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{int(p * 100)}") for p in probs])
    return add_row(add_row(tok, seq), q)


def mismatch_metrics(tokens: DataFrame) -> DataFrame:
    """KL, k3, perplexities and log-perplexity gap of training against rollout policy; sequence then batch."""
    m, o, r = F.col("mask"), F.col("old_lp"), F.col("rollout_lp")
    lr = o - r
    batch = tokens.agg(masked_mean(-lr, m).alias("kl"), masked_mean(F.exp(lr) - lr - 1, m).alias("k3_kl"))
    per = tokens.groupBy("rollout_id").agg(masked_mean(o, m).alias("mo"), masked_mean(r, m).alias("mr"))
    gap = F.col("mr") - F.col("mo")
    seq = per.agg(
        F.avg(F.exp(-F.col("mo"))).alias("training_ppl"),
        F.avg(-F.col("mo")).alias("training_log_ppl"),
        F.avg(F.exp(-F.col("mr"))).alias("rollout_ppl"),
        F.avg(-F.col("mr")).alias("rollout_log_ppl"),
        F.avg(gap).alias("log_ppl_gap"),
        F.avg(F.abs(gap)).alias("log_ppl_abs_gap"),
        F.max(gap).alias("log_ppl_gap_max"),
        F.min(gap).alias("log_ppl_gap_min"),
        F.avg(F.exp(gap)).alias("ppl_ratio"),
    )
    return add_row(seq, batch)


def kl(lp: Column, ref: Column, kind: str = "k1") -> Column:
    """Per-token KL estimate."""
    d = lp - ref
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return 0.5 * d * d
    if kind in ("k3", "low_var_kl"):
        x = clip(-d, -BOUND, BOUND)
        return clip(F.exp(x) - x - 1, -10.0, 10.0)
    if kind == "control_variate":
        x = clip(-d, -10.0, 10.0)
        return F.exp(x) - 1 - x
    raise ValueError(f"unknown estimator {kind!r}")


def kl_shaped_rewards(tokens: DataFrame, beta: float, kind: str = "k1") -> DataFrame:
    k = kl(F.col("old_lp"), F.col("ref_lp"), kind) * F.col("mask")
    return tokens.withColumn("kl", k).withColumn("shaped", F.col("reward") - beta * F.col("kl"))


def mean_kl(tokens: DataFrame, kind: str = "k1") -> DataFrame:
    """Masked mean per sequence, then mean over the batch."""
    m = F.col("mask")
    per = tokens.groupBy("rollout_id").agg(masked_mean(kl(F.col("old_lp"), F.col("ref_lp"), kind), m).alias("k"))
    return per.agg(F.avg("k").alias("kl"))


def aggregate_loss(tokens: DataFrame, loss: Column, norm_length: float) -> DataFrame:
    """The four reductions: token mean, mean of sequence sums, mean of sequence means, summed over a length."""
    m = F.col("mask")
    per = tokens.groupBy("rollout_id").agg(F.sum(loss * m).alias("s"), F.sum(m).alias("n"))
    return per.agg(
        (F.sum("s") / (F.sum("n") + EPS)).alias("token_mean"),
        F.avg("s").alias("seq_mean_token_sum"),
        F.avg(F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("seq_mean_token_mean"),
        (F.sum("s") / norm_length).alias("seq_mean_token_sum_norm"),
    )


@DIAGNOSTICS.add("clip")
def clip_report(tokens: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> DataFrame:
    """Clipped surrogate of the logged policies with dual clip for negative advantages (report only)."""
    m, a = F.col("mask"), F.col("advantage")
    d = clip(F.col("old_lp") - F.col("rollout_lp"), -BOUND, BOUND)
    ratio = F.exp(d)
    l1, l2 = -a * ratio, -a * clip(ratio, 1 - low, 1 + high)
    worst = F.greatest(l1, l2)
    l3 = -a * dual
    rows = tokens.select(
        "rollout_id", m.alias("mask"), F.when(a < 0, F.least(worst, l3)).otherwise(worst).alias("loss"),
        (l2 > l1).cast("double").alias("clipped"), ((worst > l3) & (a < 0)).cast("double").alias("lower"), (-d).alias("kl"),
    )
    return rows.agg(*[masked_mean(F.col(c), F.col("mask")).alias(c) for c in ("loss", "clipped", "lower", "kl")])


def _sequence_ratio(tokens):
    """Per sequence: mean log ratio g of its tokens, and what its tokens' advantages add up to by sign."""
    m, a = F.col("mask"), F.col("advantage")
    d = F.col("old_lp") - F.col("rollout_lp")
    return tokens.groupBy("rollout_id").agg(
        (F.sum(d * m) / F.greatest(F.sum(m), F.lit(1))).alias("g"), F.sum(m).alias("n"), F.sum(d * m).alias("d"),
        F.sum(F.greatest(a, F.lit(0.0)) * m).alias("up"), F.sum(F.greatest(-a, F.lit(0.0)) * m).alias("down"),
        F.sum((a > 0).cast("int") * m).alias("n_up"), F.sum((a < 0).cast("int") * m).alias("n_down"),
    )


@DIAGNOSTICS.add("sequence_ratio")
def sequence_ratio_report(tokens: DataFrame, low: float = 0.0003, high: float = 0.0004) -> DataFrame:
    """Length-normalised sequence ratio with its own clip range. Every token is clipped by its own advantage: with
    one ratio a sequence, sums of the advantages by sign give the token losses. Loss: mean of the sequences' token
    means; clipped share and kl: means over tokens."""
    per = _sequence_ratio(tokens).where("n > 0").withColumn("r", F.exp(F.least(F.col("g"), F.lit(10.0))))
    per = per.withColumn("cr", clip(F.col("r"), 1 - low, 1 + high))
    loss = (F.col("down") * F.greatest("r", "cr") - F.col("up") * F.least("r", "cr")) / F.col("n")
    clipped = F.when(F.col("cr") < F.col("r"), F.col("n_up")).when(F.col("cr") > F.col("r"), F.col("n_down")).otherwise(0)
    return per.agg(
        F.avg(loss).alias("loss"), (F.sum(clipped) / F.sum("n")).alias("clipped"), (-F.sum("d") / F.sum("n")).alias("kl"), F.avg("r").alias("ratio"),
    )


@DIAGNOSTICS.add("geometric_ratio")
def geometric_ratio_report(tokens: DataFrame, low: float = 0.4, high: float = 0.4) -> DataFrame:
    """Geometric mean of token ratios; per token the smaller of the plain and the clipped signed log-ratio."""
    m, a = F.col("mask"), F.col("advantage")
    x = F.col("old_lp") - F.col("rollout_lp")
    cut = clip(x, -low, high)
    sign = F.signum(a)
    kept = sign * F.least(sign * x, sign * cut)
    per = tokens.groupBy("rollout_id").agg(
        F.exp(F.sum(kept * m) / (F.sum(m) + EPS)).alias("r"),
        (F.sum(a * m) / (F.sum(m) + EPS)).alias("a"),
        F.sum(((x != cut) & (a > 0)).cast("int") * m).alias("up"),
        F.sum(((x != cut) & (a < 0)).cast("int") * m).alias("down"),
        F.sum(m).alias("n"),
    )
    share = lambda c: F.sum(c) / (F.sum("n") + EPS)
    return per.agg(
        F.avg(-F.col("a") * F.col("r")).alias("loss"), share("up").alias("clipped"), share("down").alias("clipped_lower"), F.avg("r").alias("ratio")
    )


def covariance(tokens: DataFrame) -> DataFrame:
    """Per-token covariance term of advantage and log-prob around their masked batch means."""
    m = F.col("mask")
    ma, ml = scalar(tokens, masked_mean(F.col("advantage"), m)), scalar(tokens, masked_mean(F.col("old_lp"), m))
    return tokens.withColumn("cov", (F.col("advantage") - ma) * (F.col("old_lp") - ml))


def clip_covariance(tokens: DataFrame, ratio: float, lb: float, ub: float, low=0.2, high=0.2, seed: int = 0) -> DataFrame:
    """Tokens whose covariance lies in (lb, ub) and that are not clipped anyway; a seeded draw of at most
    max(1, int(ratio * tokens)) of them, ranked by hash buckets."""
    from ..functions.numeric import sample_key
    from .spread import hash_bucket, ranked

    a, x = F.col("advantage"), F.exp(F.col("old_lp") - F.col("rollout_lp"))
    origin = -a * clip(x, 1 - low, 1 + high) > -a * x
    rows = covariance(tokens).where((F.col("mask") == 1) & ~origin & (F.col("cov") > lb) & (F.col("cov") < ub))
    n = scalar(tokens, F.greatest(F.floor(F.lit(ratio) * F.sum("mask")), F.lit(1)))
    rows = rows.withColumn("__k", sample_key(seed, F.col("rollout_id"), F.col("pos")))
    rows = ranked(rows, [], [F.col("__k")], hash_bucket(F.col("__k")), "__r")
    return rows.where(F.col("__r") <= n).drop("__k", "__r")


def kl_covariance(tokens: DataFrame, ratio: float) -> DataFrame:
    """The max(1, int(ratio * tokens)) tokens of largest covariance, whatever that number: cut at the distinct
    covariance value where the running count crosses it, ties by position."""
    from .spread import ranked, value_bucket

    m = F.col("mask")
    rows = tokens.where(m == 1)
    ma, ml = scalar(rows, F.avg("advantage")), scalar(rows, F.avg("old_lp"))
    rows = rows.withColumn("cov", (F.col("advantage") - ma) * (F.col("old_lp") - ml)).withColumn("__o", F.round(-F.col("cov"), 9))
    n = scalar(rows, F.greatest(F.floor(F.lit(ratio) * F.count(F.lit(1))), F.lit(1)))
    rows = ranked(rows, [], [F.col("__o"), F.col("rollout_id"), F.col("pos")], value_bucket(rows, F.col("__o"), parts=4096), "__r")
    return rows.where(F.col("__r") <= n).drop("__o", "__r")


@DIAGNOSTICS.add("value")
def value_report(tokens: DataFrame, clip_range: float = 0.5) -> DataFrame:
    """Clipped and unclipped squared error of the value function, half the larger, clip fraction."""
    m = F.col("mask")
    v = F.least(F.greatest(F.col("new_value"), F.col("value") - clip_range), F.col("value") + clip_range)
    e1, e2 = F.pow(F.col("new_value") - F.col("ret"), F.lit(2.0)), F.pow(v - F.col("ret"), F.lit(2.0))
    return tokens.agg(
        (0.5 * masked_mean(F.greatest(e1, e2), m)).alias("loss"), masked_mean((e2 > e1).cast("double"), m).alias("clipped"),
        masked_mean(e1, m).alias("unclipped_error"), masked_mean(e2, m).alias("clipped_error"),
    )


def logprob_parity(records: DataFrame, tolerance: float) -> DataFrame:
    """Largest and mean absolute difference of two log-prob arrays; unequal lengths fail."""
    d = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    total = F.aggregate(d, F.lit(0.0), lambda s, x: s + x)
    same = F.size("a") == F.size("b")
    return records.select(
        "record", F.when(same, F.array_max(d)).alias("max_diff"), F.when(same, total / F.size("a")).alias("mean_diff"),
        (same & (F.coalesce(F.array_max(d), F.lit(0.0)) <= tolerance)).alias("ok"),
    )


def episode_metrics(ep: DataFrame) -> DataFrame:
    """Episode report (leaf, score, n_query, n_tokens, arrays lp, ref_lp, advantage, values over query+response).

    Scores over leaves only; KL and control-variate KL per sequence; critic values without query and last token.
    """
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    vals = F.slice("values", F.col("n_query") + 1, F.greatest(F.size("values") - F.col("n_query") - 1, F.lit(0)))
    kls = F.zip_with("lp", "ref_lp", lambda a, b: a - b)
    cv = F.zip_with("lp", "ref_lp", lambda a, b: kl(a, b, "control_variate"))
    rows = ep.select(
        F.when(F.col("leaf"), F.col("score")).alias("score"), F.size("lp").alias("len"), total("lp").alias("slp"),
        total("advantage").alias("sa"), F.size("advantage").alias("na"), total(kls).alias("kl"), total(cv).alias("cv"),
        total(vals).alias("sv"), F.size(vals).alias("nv"),
    )
    return rows.agg(
        F.avg("score").alias("score_mean"), F.avg("len").alias("length_mean"), (F.sum("sa") / F.sum("na")).alias("advantage_mean"),
        F.avg("slp").alias("logprob_mean"), F.avg(F.col("slp") / F.col("len")).alias("logprob_per_token"),
        F.avg("kl").alias("kl"), F.avg("cv").alias("control_variate_kl"), (F.sum("sv") / F.sum("nv")).alias("value_mean"),
    )


def sequence_control_variate(tokens: DataFrame) -> DataFrame:
    """KL from the ratio of summed log-probs per sequence, log-ratio clamped to 10."""
    m = F.col("mask")
    per = tokens.groupBy("rollout_id").agg(F.sum((F.col("ref_lp") - F.col("old_lp")) * m).alias("d"))
    x = clip(F.col("d"), -10.0, 10.0)
    return per.agg(F.avg(F.exp(x) - 1 - x).alias("kl"))
