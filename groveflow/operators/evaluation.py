"""Evaluation of graded rollouts: pass@n, votes, best-of-n, batch metrics, reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import sample_key, uniform
from .spread import add_row, join_stats, ranked, value_bucket, value_counts


def question_scores(df: DataFrame) -> DataFrame:
    """Per question: any correct, share correct, majority-vote accuracy, distinct answers, unparsed share.

    Input: uid, rollout_id, arrival, answer (null = not parsed, still votable), correct. Equal votes go to the
    answer seen first. Votes are counted per (question, answer) before they meet in one row per question.
    """
    votes = df.groupBy("uid", "answer").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("correct").alias("n_correct"),
        F.min(F.struct(F.col("arrival").alias("t"), "rollout_id")).alias("seen"),
        F.min_by("correct", F.struct("arrival", "rollout_id")).alias("grade"),
    )
    order = F.struct(F.col("n"), -F.col("seen.t"), -F.col("seen.rollout_id"))
    return votes.groupBy("uid").agg(
        F.max((F.col("n_correct") > 0).cast("int")).alias("any_correct"),
        (F.sum("n_correct") / F.sum("n")).alias("share_correct"),
        F.max_by("grade", order).alias("majority_correct"),
        F.count(F.lit(1)).alias("distinct_answers"),
        (F.sum(F.when(F.col("answer").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("unparsed_share"),
    )


def best_worst(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact expectation and deviation of the best and worst of n draws with replacement, n = 2,4,8,..,N.

    With values sorted ascending, the i-th of N is the best of n draws with chance (i/N)^n - ((i-1)/N)^n;
    equal values add up to one difference, so distinct values with counts are enough.
    """
    rows = value_counts(df, keys, F.col(value))
    sizes = df.groupBy(*keys).agg(F.count(value).alias("size"), F.count(F.lit(1)).alias("__n"))
    rows = join_stats(rows, sizes, keys, ["v"]).drop("__n").where(F.col("size") > 1)
    powers = F.transform(
        F.sequence(F.lit(1), F.greatest(F.ceil(F.log2("size")) - 1, F.lit(1)).cast("int")),
        lambda e: F.pow(F.lit(2.0), e).cast("bigint"),
    )
    ns = F.array_distinct(F.concat(F.filter(powers, lambda x: x < F.col("size")), F.array(F.col("size"))))
    rows = rows.withColumn("n", F.explode(ns))
    up = lambda a: F.pow(a / F.col("size"), F.col("n"))
    hi, lo, N, v = F.col("hi"), F.col("hi") - F.col("c"), F.col("size"), F.col("v")
    best = up(hi) - up(lo)
    worst = up(N - lo) - up(N - hi)
    out = rows.groupBy(*keys, "n").agg(
        F.sum(v * best).alias("best_mean"),
        F.sum(v * v * best).alias("b2"),
        F.sum(v * worst).alias("worst_mean"),
        F.sum(v * v * worst).alias("w2"),
    )
    dev = lambda m2, m: F.sqrt(F.greatest(F.col(m2) - F.col(m) * F.col(m), F.lit(0.0)))
    return out.select(
        *keys, "n", "best_mean", dev("b2", "best_mean").alias("best_std"), "worst_mean", dev("w2", "worst_mean").alias("worst_std")
    )


def vote_value(df: DataFrame, keys: list[str], vote: str, value: str, pos: list[str]) -> DataFrame:
    """Value of the first row of the most frequent vote (the vote seen first wins ties)."""
    at = F.struct(*[F.col(p) for p in pos])
    votes = df.groupBy(*keys, vote).agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("seen"), F.min_by(value, at).alias("v")
    )
    minus = F.struct(F.col("n"), *[(-F.col(f"seen.{p}")).alias(p) for p in pos])
    return votes.groupBy(*keys).agg(F.max_by("v", minus).alias("majority_value"))


def majority_draws(df: DataFrame, keys: list[str], vote: str, value: str, row_id: str, n: int, draws: int, seed: int = 42):
    """maj@n by seeded draws of n responses with replacement: mean and deviation over the draws."""
    rows = ranked(
        df.select(*keys, vote, value, row_id), keys, [F.col(row_id)], value_bucket(df, F.col(row_id), parts=256), "i"
    )
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= n)
    picks = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn(
        "k", F.explode(F.sequence(F.lit(1), F.lit(n)))
    )
    key = sample_key(seed, *[F.col(c) for c in keys], F.col("draw"), F.col("k"))
    picks = picks.withColumn("i", F.floor(uniform(key) * F.col("size")) + 1)
    # the row side has unique (keys, i); a prompt's picks spread over its row positions
    got = picks.join(rows, [*keys, "i"])
    per_draw = vote_value(got, [*keys, "draw"], vote, value, ["k"])
    return per_draw.groupBy(*keys).agg(
        F.avg("majority_value").alias("maj_mean"), F.stddev_pop("majority_value").alias("maj_std")
    )


def reduce_metrics(df: DataFrame) -> DataFrame:
    """(name, value) rows: names with `max` keep the maximum, with `min` the minimum, others the mean."""
    out = df.groupBy("name").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.avg("value").alias("mean"))
    name = F.col("name")
    return out.select(
        "name", F.when(name.contains("max"), F.col("hi")).when(name.contains("min"), F.col("lo")).otherwise(F.col("mean")).alias("value")
    )


def batch_metrics(rollouts: DataFrame, tokens: DataFrame, max_len: int) -> DataFrame:
    """One row of batch metrics: scores over answered responses only, lengths over all, explained variance."""
    per = tokens.groupBy("rollout_id").agg(F.count(F.lit(1)).alias("len"), F.sum("reward").alias("seq_reward"))
    rows = rollouts.join(per, "rollout_id", "left").withColumn("len", F.coalesce("len", F.lit(0)))
    done = F.col("len") > 0
    seq = rows.agg(
        F.avg(F.when(done, F.col("score"))).alias("score_mean"),
        F.max(F.when(done, F.col("score"))).alias("score_max"),
        F.min(F.when(done, F.col("score"))).alias("score_min"),
        F.avg(F.when(done, F.col("seq_reward"))).alias("reward_mean"),
        F.avg("len").alias("length_mean"),
        F.max("len").alias("length_max"),
        F.min("len").alias("length_min"),
        F.avg((F.col("len") == max_len).cast("double")).alias("length_clip_ratio"),
        F.avg((~done).cast("double")).alias("aborted_ratio"),
        F.avg("n_tokens").alias("prompt_length_mean"),
    )
    m = F.col("mask") == 1
    keep = lambda c: F.when(m, F.col(c))
    tok = tokens.agg(
        F.avg(keep("advantage")).alias("advantage_mean"),
        F.max(keep("advantage")).alias("advantage_max"),
        F.min(keep("advantage")).alias("advantage_min"),
        F.avg(keep("ret")).alias("return_mean"),
        F.avg(keep("value")).alias("value_mean"),
        (1 - F.var_samp(F.when(m, F.col("ret") - F.col("value"))) / (F.var_samp(keep("ret")) + 1e-5)).alias("explained_var"),
    )
    return add_row(seq, tok)


def token_bins(df: DataFrame, value: Column, lo: float, hi: float, bins: int, keys: list[str]) -> DataFrame:
    """Counts per equal-width bin; values outside fall in bin 0 and bins + 1."""
    return df.groupBy(*keys, F.width_bucket(value, F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def shard_report(df: DataFrame, shard: str, length: str) -> DataFrame:
    """Minimum, maximum and mean of the summed lengths per shard."""
    sums = df.groupBy(shard).agg(F.sum(length).alias("s"))
    return sums.agg(
        F.min("s").alias("min_sum"), F.max("s").alias("max_sum"), F.avg("s").alias("mean_sum"),
        (F.max("s") - F.min("s")).alias("spread"),
    )


def trajectory_counters(df: DataFrame) -> DataFrame:
    """Quality counters over rollouts (uid, answer, finish, correct, text)."""
    per = df.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("answer").isNull()).alias("parse_failed"),
        F.count_if(F.col("finish") == "length").alias("truncated"),
        F.max("correct").alias("hit"),
        F.countDistinct("text").alias("uniq"),
    )
    return per.agg(
        F.sum("parse_failed").alias("parse_failed"),
        F.sum("truncated").alias("truncated"),
        F.avg(F.col("hit").cast("double")).alias("once_hit"),
        F.avg("n").alias("rollouts_per_state"),
        (F.sum("truncated") / F.sum("n")).alias("truncated_share"),
        F.avg(F.col("uniq") / F.col("n")).alias("unique_share"),
    )


def centred_rank(df: DataFrame, col: str, row_id: str, name: str) -> DataFrame:
    """Average rank over the whole table (ties share the mean of their positions), per distinct value."""
    ranks = value_counts(df, [], F.col(col), parts=4096).select(
        F.col("v").alias(col), (F.col("hi") - (F.col("c") - 1) / 2).alias(name), F.col("c").alias("__n")
    )
    sizes = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    return join_stats(df, ranks, [col], [row_id], sizes).drop("__n")
