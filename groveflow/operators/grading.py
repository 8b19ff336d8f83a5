"""Grading as one Column job: rules by data source, graders, reward placement, parse statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .registry import REWARD_RULES


@REWARD_RULES.add("delimited_number")
def delimited_grade(text: Column, gold: Column) -> Column:
    """Exact match after the #### rule; commas dropped, lower case."""
    clean = lambda c: F.lower(F.replace(c, F.lit(","), F.lit("")))
    return F.coalesce((clean(X.delimited_number(text)) == clean(gold)).cast("double"), F.lit(0.0))


@REWARD_RULES.add("boxed")
def boxed_grade(text: Column, gold: Column) -> Column:
    return F.coalesce((X.latex_normal(X.last_boxed(text)) == X.latex_normal(gold)).cast("double"), F.lit(0.0))


@REWARD_RULES.add("answer_line")
def answer_line_grade(text: Column, gold: Column) -> Column:
    """+1 / -1 on the normalised `Answer:` line."""
    return F.when(X.normal_answer(X.answer_line(text)) == X.normal_answer(gold), 1.0).otherwise(-1.0)


@REWARD_RULES.add("strict_boxed")
def strict_boxed_grade(text: Column, gold: Column) -> Column:
    """+1 / -1 on the boxed answer within the last 100 characters, compared as it stands."""
    return F.when(X.last_boxed(F.right(text, F.lit(100))) == gold, 1.0).otherwise(-1.0)


def qa_grade(text: Column, golds: Column, substring: bool = False) -> Column:
    """Exact (or substring) match of the tagged answer with any gold; a quarter score when tags are spammed."""
    answer = X.qa_normal(X.answer_tag(text))
    if substring:
        hit = F.exists(golds, lambda g: F.contains(answer, X.qa_normal(g)))
    else:
        hit = F.exists(golds, lambda g: answer == X.qa_normal(g))
    many = (X.count_of(text, "<answer>") > 10) | (X.count_of(text, "</answer>") > 10)
    return F.when(~F.coalesce(hit, F.lit(False)), 0.0).when(many, 0.25).otherwise(1.0)


REWARD_RULES.add("qa")(lambda text, gold: qa_grade(text, F.array(gold)))


def list_grade(preds: Column, golds: Column, tolerance: float = 1e-3) -> Column:
    """List answers: distinct golds, the last as many predictions, each side matched by the other (text or
    number within the tolerance)."""
    golds = F.array_distinct(golds)
    n = F.size(golds)
    preds = F.slice(preds, F.greatest(F.size(preds) - n + 1, F.lit(1)), n)

    def same(a, b):
        num = lambda c: c.try_cast("double")
        return (X.strip(a) == X.strip(b)) | F.coalesce(F.abs(num(a) - num(b)) <= tolerance, F.lit(False))

    return (
        (F.size(preds) > 0)
        & F.forall(golds, lambda g: F.exists(preds, lambda p: same(p, g)))
        & F.forall(preds, lambda p: F.exists(golds, lambda g: same(p, g)))
    )


def grade(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Route every data source to its rule; rows of unknown sources go to quarantine."""
    source = F.col("data_source")
    score = F.lit(None).cast("double")
    for name, rule in rules.items():
        score = F.when(source == name, REWARD_RULES.pick(rule)(F.col("text"), F.col("gold"))).otherwise(score)
    known = source.isin(list(rules))
    return df.where(known).withColumn("grade", score), df.where(~known).withColumn("reason", F.lit("unknown data source"))


def unfinished_penalty(score: Column, finish: Column, penalty: float) -> Column:
    return F.when(finish == "length", F.lit(penalty)).otherwise(score)


def several_conclusions(text: Column, score: Column, mark: str = "###", limit: int = 2, penalty: float = -2.0) -> Column:
    """Penalty when the text concludes more than once."""
    return F.when(F.size(F.split(text, mark)) > limit, F.lit(penalty)).otherwise(score)


def place_reward(tokens: DataFrame, scores: DataFrame) -> DataFrame:
    """Reward on the last valid token of a response, zero elsewhere."""
    last = tokens.where("mask = 1").groupBy("rollout_id").agg(F.max("pos").alias("__last"))
    rows = tokens.join(last, "rollout_id", "left").join(scores, "rollout_id", "left")
    return rows.withColumn("token_reward", F.when(F.col("pos") == F.col("__last"), F.col("score")).otherwise(0.0)).drop("__last")


def parse_metrics(df: DataFrame, mode: str, parsed: Column) -> DataFrame:
    """Attempts, failures and failure rate by parse mode."""
    out = df.groupBy(mode).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~parsed).alias("failures"))
    return out.withColumn("failure_rate", F.col("failures") / F.col("attempts"))
