"""Row-reshaping jobs: prompts, conversations, preference rows, masks, few-shot prompts, filters."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numeric import sample_key, stable_id
from .spread import attach_stats, first_k, hash_bucket, ranked, value_bucket


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def with_index(df: DataFrame, order: str, name: str = "index") -> DataFrame:
    """Row index from 0 over a stable unique numeric key."""
    out = ranked(df, [], [F.col(order)], value_bucket(df, F.col(order), 1024), "__p")
    return out.withColumn(name, F.col("__p") - 1).drop("__p")


def prompt_rows(
    df: DataFrame, source: Column, question: Column, answer: Column, ability: str, split: str,
    suffix: str = "", system: str | None = None, extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Prompt schema: data_source, prompt messages, ability, reward_model, extra_info. One function serves the
    math, tool, interaction and competition variants through suffix, system prompt and extra fields."""
    content = F.concat(question, F.lit(suffix)) if suffix else question
    turns = [message("user", content)] if system is None else [message("system", F.lit(system)), message("user", content)]
    more = [c.alias(n) for n, c in (extra or {}).items()]
    return df.select(
        source.alias("data_source"), F.array(*turns).alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), answer.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col("index"), question.alias("question"), *more).alias("extra_info"),
    )


def answer_from_fields(fields: list[Column], boxed: list[Column], zero_when: Column | None = None) -> Column:
    """First non-empty field, else the last boxed content of the fallback fields, else the zero rule; null is an error row."""
    clean = lambda c: F.nullif(X.strip(c), F.lit(""))
    options = [clean(f) for f in fields] + [clean(X.last_boxed(b)) for b in boxed]
    if zero_when is not None:
        options.append(F.when(zero_when, F.lit("0")))
    return F.coalesce(*options)


def delimited_solution(df: DataFrame, solution: str) -> DataFrame:
    """Split a solution at #### into reasoning and answer, calculator marks removed."""
    clean = X.strip_calculator(F.col(solution))
    parts = F.split(clean, "####")
    return df.withColumns({"reasoning": X.strip(F.element_at(parts, 1)), "answer": X.strip(F.try_element_at(parts, F.lit(2)))})


def math_fields(df: DataFrame) -> DataFrame:
    """Rename the question, take a missing answer from the solution's last box, make the answer a list."""
    answer = F.coalesce(F.nullif(X.strip(F.col("answer")), F.lit("")), X.last_boxed(F.col("solution")))
    return df.withColumnRenamed("question", "problem").withColumn("answer", F.array(answer))


def search_rows(df: DataFrame, system: str) -> DataFrame:
    """Search-QA prompts: tagged source, system and user message, tool arguments; the ground truth falls back to the
    golden answers."""
    truth = F.coalesce("ground_truth", "golden_answers")
    return df.select(
        F.concat(F.lit("search_"), F.col("source")).alias("data_source"), "doc_id",
        F.array(message("system", F.lit(system)), message("user", F.col("question"))).alias("prompt"),
        F.struct(F.lit("rule").alias("style"), truth.alias("target")).alias("reward_model"),
        F.struct(F.lit(True).alias("need_tools"), F.struct(F.col("doc_id"), F.col("question"), truth.alias("ground_truth")).alias("tools_kwargs")).alias("extra_info"),
    )


def preference_to_sft(df: DataFrame) -> DataFrame:
    """Chosen and rejected responses both become (prompt, response) rows."""
    return df.select("prompt", F.explode(F.array("chosen", "rejected")).alias("response"))


def preference_split(df: DataFrame, order: str, share: float = 0.75) -> DataFrame:
    """First share of the source order is train, the rest test."""
    rows = with_index(df, order)
    n = df.agg(F.count(F.lit(1)).alias("v")).scalar()
    return rows.withColumn("split", F.when(F.col("index") < F.floor(n * share), "train").otherwise("test"))


def loss_mask(messages: DataFrame) -> DataFrame:
    """Per conversation the token list and a 0/1 mask over whitespace tokens: 1 only for assistant tokens after
    the role header. A tokenizer UDF can replace the split. A conversation is bounded by the context window."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    head = F.array(F.concat(F.lit("<"), F.col("role"), F.lit(">")))
    hit = F.when(F.col("role") == "assistant", 1).otherwise(0)
    piece = F.struct(
        "turn", F.concat(head, words).alias("tokens"), F.concat(F.array(F.lit(0)), F.transform(words, lambda w: hit)).alias("mask")
    )
    conv = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return conv.select(
        "conv_id", F.flatten(F.transform("p", lambda x: x["tokens"])).alias("tokens"), F.flatten(F.transform("p", lambda x: x["mask"])).alias("mask")
    )


def conversation(messages: DataFrame) -> DataFrame:
    """Messages of a conversation in turn order."""
    m = F.struct("turn", "role", F.col("text").alias("content"))
    return messages.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(m)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")
    )


def response_mask(tokens: DataFrame, is_eos: Column) -> DataFrame:
    """1 up to and including the first end token."""
    w = Window.partitionBy("rollout_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum(is_eos.cast("int")).over(w) - is_eos.cast("int")
    return tokens.withColumn("response_mask", (seen == 0).cast("int"))


def cut_response(df: DataFrame, limit: int, penalty: float) -> DataFrame:
    """Cut query + response to the limit; a cut response is unfinished and scores the penalty."""
    room = F.greatest(F.lit(limit) - F.size("query"), F.lit(0))
    cut = F.size("response") > room
    return df.withColumns(
        {"response": F.when(cut, F.slice("response", 1, room)).otherwise(F.col("response")), "unfinished": cut,
         "score": F.when(cut, F.lit(penalty)).otherwise(F.col("score"))}
    )


def few_shot(rows: DataFrame, examples: DataFrame, n: int, limit: int, seed: int, tries: int = 10) -> DataFrame:
    """Few-shot prompt per row from (row_id, problem): n seeded examples (ex_id, problem, text) other than itself.

    Examples are numbered in hash order; a try takes n + 1 evenly spaced numbers from a hashed start, so rows and
    examples meet by equality on the number. The first try whose joined text fits the limit wins, else the tail
    of the last try is kept.
    """
    ex = examples.withColumn("__k", sample_key(seed, F.col("ex_id")))
    ex = ranked(ex, [], [F.col("__k"), F.col("ex_id")], hash_bucket(F.col("__k")), "num").select(
        (F.col("num") - 1).alias("num"), F.col("problem").alias("ex_problem"), "text"
    )
    total = examples.agg(F.count(F.lit(1)).alias("v")).scalar()
    t = rows.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("total", total)
    start = F.pmod(stable_id(F.concat_ws("|", F.lit(str(seed)), F.col("try").cast("string"), F.col("row_id").cast("string"))), F.col("total"))
    t = t.withColumn("start", start).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n))))
    t = t.withColumn("num", F.pmod(F.col("start") + F.col("j") * F.greatest(F.floor(F.col("total") / (n + 1)), F.lit(1)), F.col("total")))
    hit = t.join(ex, "num").where(F.col("problem") != F.col("ex_problem"))
    shot = hit.groupBy("row_id", "try").agg(F.slice(F.sort_array(F.collect_list(F.struct("j", "text"))), 1, n).alias("s"))
    joined = shot.withColumn("shots", F.array_join(F.transform("s", lambda x: x["text"]), "\n\n"))
    fits = F.length("shots") <= limit
    best = joined.groupBy("row_id").agg(
        F.min_by("shots", F.when(fits, F.col("try"))).alias("ok"), F.max_by("shots", "try").alias("tail"), F.min(F.when(fits, F.col("try"))).alias("try")
    )
    return best.select("row_id", F.coalesce("ok", F.right("tail", F.lit(limit))).alias("shots"), "try")


TRANSCRIPT = r"(?s)<code>(.*?)</code>|<interpreter>(.*?)</interpreter>|<answer>(.*?)</answer>"


def transcript_messages(text: Column) -> Column:
    """Typed messages of a tool-use transcript in order: assistant code call, tool result, final answer."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)(<code>.*?</code>|<interpreter>.*?</interpreter>|<answer>.*?</answer>)"), F.lit(1))
    kind = lambda b: F.regexp_extract(b, "^<([a-z]+)>", 1)
    role = lambda b: F.when(kind(b) == "interpreter", "tool").otherwise("assistant")
    return F.transform(
        blocks,
        lambda b: F.struct(role(b).alias("role"), kind(b).alias("type"), X.strip(F.regexp_replace(b, "^<[a-z]+>|</[a-z]+>$", "")).alias("content")),
    )


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns whose type is null-only."""
    return df.drop(*[f.name for f in df.schema.fields if f.dataType.typeName() == "void"])


# --- filters ------------------------------------------------------------------------------------------


def varied_groups(df: DataFrame) -> DataFrame:
    """Rows of prompts whose reward varies (population deviation > 0) or that have one response."""
    rows = attach_stats(df, ["uid"], {"g_lo": F.min("score"), "g_hi": F.max("score"), "g_n": F.count(F.lit(1))}, ["rollout_id"])
    return rows.where((F.col("g_hi") > F.col("g_lo")) | (F.col("g_n") == 1)).drop("g_lo", "g_hi", "g_n")


def fill_batch(df: DataFrame, batch: int, per_prompt: int) -> DataFrame:
    """Prompts in order of arrival until the batch is full, then at most batch * per_prompt rows in order.
    The batch size is a constant: top-n per task, then merged."""
    prompts = df.groupBy("uid").agg(F.min(F.struct("arrival", "uid")).alias("first")).orderBy("first").limit(batch)
    rows = df.join(F.broadcast(prompts), "uid")  # at most `batch` rows
    return rows.orderBy("first", "arrival", "rollout_id").limit(batch * per_prompt).drop("first")


def accuracy_filter(df: DataFrame, lo: float, hi: float, limit: int, oversample: int) -> DataFrame:
    """Prompts with mean accuracy in [lo, hi] and no truncated response come first, then the list of prompts is
    cut to 1/oversample; failing prompts may fill the tail."""
    per = df.groupBy("uid").agg(F.avg("correct").alias("acc"), F.max("n_tokens").alias("longest"))
    passed = (F.col("acc") >= lo) & (F.col("acc") <= hi) & (F.col("longest") < limit - 1)
    per = per.withColumn("passed", passed.cast("int"))
    base = per.agg((F.max("uid") + 1).alias("v")).scalar()
    per = per.withColumn("__o", (1 - F.col("passed")) * base + F.col("uid"))
    rows = ranked(per, [], [F.col("__o")], value_bucket(per, F.col("__o"), 1024), "place")
    n = per.agg(F.count(F.lit(1)).alias("v")).scalar()
    return rows.where(F.col("place") <= F.floor(n / oversample)).drop("__o")


def best_turn(df: DataFrame, conv: str, turn: str, score: str, tie: str) -> DataFrame:
    """First row per conversation: the highest turn, and of equal turns the highest score."""
    return first_k(df, [conv], [F.desc(turn), F.desc(score), F.col(tie)], 1)


def dedup_by(df: DataFrame, text: Column, order: str) -> DataFrame:
    """First row per content hash; copies are pruned to one row per task before the shuffle."""
    return first_k(df.withColumn("__h", F.md5(text)), ["__h"], [F.col(order)], 1).drop("__h")
