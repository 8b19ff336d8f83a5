"""Exact branch-budget allocation per queue flush. A flush holds at most `capacity` nodes, so its unit steps
fit one window partition; flushes are independent."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import ranked, value_bucket

FLUSH = ["queue", "flush"]


def batch_flushes(nodes: DataFrame, capacity: int) -> DataFrame:
    """Batch twin of the online queue: every `capacity` nodes of a queue in arrival order are one flush."""
    rows = ranked(nodes, ["queue"], [F.col("seq")], value_bucket(nodes, F.col("seq")), "__p")
    return rows.withColumn("flush", F.floor((F.col("__p") - 1) / capacity)).drop("__p")


def bounds(
    nodes: DataFrame,
    budget: DataFrame,
    n_min: int = 1,
    max_k: int = 12,
    repair_k: int | None = None,
    cap_mode: str = "below_default_only",
    repair: bool = True,
) -> DataFrame:
    """Lower and upper bound per node and the flush budget; a budget above the caps first lifts uncapped
    nodes to the repair cap. `status` tells flushes below their lower bounds (nothing is allocated there)."""
    floor = max(n_min, 1)
    max_k = max(max_k, floor)
    repair_k = max(repair_k or max_k, max_k)
    pk = F.greatest(F.col("predicted_k"), F.lit(floor))
    dk = F.greatest(F.col("default_k"), F.lit(floor))
    if cap_mode == "below_default_only":
        upper, hard = F.when(pk < dk, pk).otherwise(F.lit(max_k)), pk < dk
    elif cap_mode == "predicted_k_for_all_nodes":
        upper, hard = pk, pk < dk
    elif cap_mode == "configured_max_for_all_nodes":
        upper, hard = F.lit(max_k), F.lit(False)
    else:
        raise ValueError(f"unknown cap mode {cap_mode!r}")
    rows = nodes.withColumns(
        {"default_k": dk, "predicted_k": pk, "lower": F.lit(floor).cast("bigint"), "upper": upper.cast("bigint"), "hard": hard}
    ).join(budget, FLUSH)
    w = Window.partitionBy(*FLUSH)
    if repair:
        lift = (F.col("budget") > F.sum("upper").over(w)) & ~F.col("hard") & (F.col("upper") < repair_k)
        rows = rows.withColumn("repaired", lift).withColumn(
            "upper", F.when(F.col("repaired"), F.lit(repair_k).cast("bigint")).otherwise(F.col("upper"))
        )
    else:
        rows = rows.withColumn("repaired", F.lit(False))
    lo, hi = F.sum("lower").over(w), F.sum("upper").over(w)
    status = F.when(F.col("budget") < lo, "below_lower").when(F.col("budget") > hi, "slack").otherwise("ok")
    return rows.withColumns({"status": status, "to_give": F.least("budget", hi) - lo, "slack": F.greatest(F.col("budget") - hi, F.lit(0))})


def give_units(rows: DataFrame, start: Column, stop: Column, priority: list[Column], keep: list[str], quota: str) -> DataFrame:
    """Hand out `quota` units per flush: one candidate row per unit step k in [start, stop), the best by
    `priority` win; the count of won steps per node comes back as `won`. Greedy equals top-N here because
    the priorities of a node's successive units never increase."""
    steps = rows.where(stop > start).withColumn("k", F.explode(F.sequence(start, stop - 1)))
    rank = F.row_number().over(Window.partitionBy(*FLUSH).orderBy(*priority))
    won = steps.withColumn("__r", rank).where(F.col("__r") <= F.col(quota)).groupBy(*FLUSH, "node_id").agg(F.count(F.lit(1)).alias("won"))
    out = rows.join(won, [*FLUSH, "node_id"], "left")
    return out.withColumn("won", F.coalesce("won", F.lit(0)))


def allocate(rows: DataFrame) -> DataFrame:
    """Minimise sum C/k: the next unit goes to the largest gain C/(k(k+1)), equal gains to the lower id."""
    gain = F.col("c") / (F.col("k") * (F.col("k") + 1))
    out = give_units(rows, F.col("lower"), F.col("upper"), [gain.desc(), F.col("node_id"), F.col("k")], [], "to_give")
    ok = F.col("status") != "below_lower"
    return out.withColumn("k", F.when(ok, F.col("lower") + F.col("won"))).drop("won")


def allocation_summary(rows: DataFrame) -> DataFrame:
    """Per flush: objective before and after, pruned, expanded, transferred, slack."""
    ref = F.least(F.greatest("default_k", "lower"), F.col("upper"))
    obj = lambda k: F.sum(F.when(F.col("c") > 0, F.col("c") / k).otherwise(0.0))
    s = rows.groupBy(*FLUSH).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.max("budget").alias("budget"),
        F.sum("k").alias("allocated"),
        F.when(F.sum(ref) == F.max(F.least(F.col("budget"), F.col("budget") - F.col("slack"))), obj(ref)).otherwise(obj(F.col("default_k"))).alias("before"),
        obj(F.col("k")).alias("after"),
        F.sum(F.greatest(F.col("default_k") - F.col("k"), F.lit(0))).alias("pruned"),
        F.sum(F.greatest(F.col("k") - F.col("default_k"), F.lit(0))).alias("expanded"),
        F.max("slack").alias("slack"),
        F.count_if("repaired").alias("repaired"),
    )
    return s.withColumn("transferred", F.least("pruned", "expanded"))


def accounting(rows: DataFrame) -> DataFrame:
    """Per-node accounting columns and invariants of an allocation."""
    d, k = F.col("default_k"), F.col("k")
    return rows.withColumns(
        {
            "cap": F.col("upper"),
            "base": F.col("lower"),
            "saved": F.greatest(d - k, F.lit(0)),
            "additional": F.greatest(k - d, F.lit(0)),
            "unmet": F.greatest(k - d, F.lit(0)),
            "weight": F.sqrt("c"),
            "valid": (k >= F.col("lower")) & (k <= F.col("upper")) & (k == d - F.greatest(d - k, F.lit(0)) + F.greatest(k - d, F.lit(0))),
        }
    )


def accounting_totals(acc: DataFrame, keys: list[str]) -> DataFrame:
    """Accounting totals per tree or queue and derived totals: generated, scored, compute proxy, reuse rate."""
    names = [
        "default_k", "k", "built", "saved", "additional", "pilots_generated", "pilots_reused", "pilots_shortcut",
        "pilots_discarded", "pilot_tokens", "support_tokens", "main_tokens", "proxy_tokens", "generation_requests",
        "scoring_requests", "prefill_tokens", "continuation_tokens",
    ]
    t = acc.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    t = t.withColumns(
        {
            "generated_tokens": F.col("pilot_tokens") + F.col("support_tokens") + F.col("main_tokens"),
            "scored_tokens": F.col("prefill_tokens") + F.col("continuation_tokens"),
            "reuse_rate": F.when(F.col("pilots_generated") > 0, F.col("pilots_reused") / F.col("pilots_generated")).otherwise(0.0),
        }
    )
    return t.withColumn("compute_proxy", F.col("generated_tokens") + F.col("scored_tokens") + F.col("proxy_tokens"))


def continuous(rows: DataFrame) -> DataFrame:
    """clamp(sqrt(C) t, lower, upper) with the t that spends the flush budget, in closed form.

    The total is piecewise linear in t: slope grows by sqrt(C) at lower/sqrt(C) and shrinks at upper/sqrt(C).
    Prefix sums over these events give total and slope; the last event within the budget fixes t. Nodes with
    C = 0 stay at the lower bound and take what is left over in id order.
    """
    root = F.sqrt("c")
    ev = rows.where(F.col("c") > 0).select(
        *FLUSH, "to_give",
        F.inline(F.array(
            F.struct((F.col("lower") / root).alias("t"), root.alias("slope")),
            F.struct((F.col("upper") / root).alias("t"), (-root).alias("slope")),
        )),
    )
    ev = ev.groupBy(*FLUSH, "t").agg(F.sum("slope").alias("slope"), F.max("to_give").alias("to_give"))
    order = Window.partitionBy(*FLUSH).orderBy("t")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("slope", F.sum("slope").over(run)).withColumn("step", F.coalesce(F.lag("slope").over(order) * (F.col("t") - F.lag("t").over(order)), F.lit(0.0)))
    ev = ev.withColumn("spent", F.sum("step").over(run)).where(F.col("spent") <= F.col("to_give") + 1e-12)
    top = ev.groupBy(*FLUSH).agg(F.max_by(F.struct("t", "slope", "spent"), "t").alias("e"))
    rows = rows.join(top, FLUSH, "left")
    t = F.when(F.col("e.slope") > 1e-9, F.col("e.t") + (F.col("to_give") - F.col("e.spent")) / F.col("e.slope")).otherwise(F.col("e.t"))
    raw = F.when(F.col("c") > 0, F.least(F.greatest(root * t, F.col("lower").cast("double")), F.col("upper").cast("double"))).otherwise(F.col("lower").cast("double"))
    rows = rows.withColumn("raw", raw)
    flush = Window.partitionBy(*FLUSH)
    left = F.greatest(F.col("to_give") - F.sum(F.col("raw") - F.col("lower")).over(flush), F.lit(0.0))
    room = F.col("upper") - F.col("raw")
    before = F.coalesce(F.sum(room).over(flush.orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumns({"__left": left, "__before": before})
    extra = F.greatest(F.least(room, F.col("__left") - F.col("__before")), F.lit(0.0))
    return rows.withColumn("raw", F.col("raw") + extra).drop("e", "__left", "__before")


def round_bounded(rows: DataFrame, strategy: str = "largest_remainder", seed: int = 0) -> DataFrame:
    """Round `raw` within bounds to the flush target; units are added by remainder (raw - current) and taken
    back from the smallest remainder, lower id first."""
    from ..functions.numeric import sample_key, uniform

    raw = F.col("raw")
    if strategy == "largest_remainder":
        start = F.floor(raw + 1e-9)
    elif strategy == "nearest_repair":
        start = F.floor(raw + 0.5)
    elif strategy == "stochastic":
        start = F.floor(raw) + (uniform(sample_key(seed, F.col("node_id"))) < raw - F.floor(raw)).cast("int")
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    start = F.least(F.greatest(start, F.col("lower")), F.col("upper")).cast("bigint")
    rows = rows.withColumn("start", start)
    w = Window.partitionBy(*FLUSH)
    target = F.sum("lower").over(w) + F.col("to_give")
    rows = rows.withColumn("gap", target - F.sum("start").over(w)).withColumns(
        {"add": F.greatest("gap", F.lit(0)), "cut": F.greatest(-F.col("gap"), F.lit(0))}
    )
    rest = F.round(raw - F.col("k"), 9)
    up = give_units(rows, F.col("start"), F.col("upper"), [rest.desc(), F.col("node_id"), F.col("k")], [], "add").withColumnRenamed("won", "up")
    rest = F.round(raw - (F.col("start") - F.col("k")), 9)
    down = give_units(up, F.lit(0).cast("bigint"), F.col("start") - F.col("lower"), [rest.asc(), F.col("node_id"), F.col("k")], [], "cut")
    return down.withColumn("k", F.col("start") + F.col("up") - F.col("won")).drop("start", "gap", "add", "cut", "up", "won")


def scale_to_budget(rows: DataFrame, raw: Column, n_min: int, cap: int) -> DataFrame:
    """Clip a raw integer allocation, then deal or take single units round robin over ids to the budget."""
    start = F.least(F.greatest(raw, F.lit(n_min)), F.lit(cap)).cast("bigint")
    rows = rows.withColumn("start", start)
    gap = F.col("budget") - F.sum("start").over(Window.partitionBy(*FLUSH))
    rows = rows.withColumn("gap", gap).withColumns({"add": F.greatest("gap", F.lit(0)), "cut": F.greatest(-F.col("gap"), F.lit(0))})
    zero = F.lit(0).cast("bigint")
    rows = give_units(rows, zero, F.lit(cap) - F.col("start"), [F.col("k"), F.col("node_id")], [], "add").withColumnRenamed("won", "up")
    rows = give_units(rows, zero, F.col("start") - n_min, [F.col("k"), F.col("node_id")], [], "cut")
    return rows.withColumn("k", F.col("start") + F.col("up") - F.col("won")).drop("start", "gap", "add", "cut", "up", "won")


def queue_budgets(nodes: DataFrame, queues: int, budget: int) -> DataFrame:
    """Deal the nodes of a batch round robin to the queues and split the batch budget in proportion, queue by
    queue on the remainder, rounding half to even. One small array of queue sizes per batch."""
    rows = ranked(nodes, ["batch"], [F.col("seq")], value_bucket(nodes, F.col("seq")), "p")
    rows = rows.withColumn("slot", F.pmod(F.col("p") - 1, F.lit(queues)))
    sizes = rows.groupBy("batch", "slot").agg(F.count(F.lit(1)).alias("n"))
    per = sizes.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("slot", "n"))).alias("q"), F.sum("n").alias("total"))
    step = lambda acc, x: F.struct(
        (acc["left"] - F.bround(acc["left"] * x["n"] / acc["nodes"]).cast("bigint")).alias("left"),
        (acc["nodes"] - x["n"]).alias("nodes"),
        F.array_append(acc["out"], F.struct(x["slot"].alias("slot"), x["n"].alias("n"), F.bround(acc["left"] * x["n"] / acc["nodes"]).cast("bigint").alias("budget"))).alias("out"),
    )
    zero = F.struct(
        F.lit(budget).cast("bigint").alias("left"), F.col("total").alias("nodes"),
        F.array().cast("array<struct<slot:bigint,n:bigint,budget:bigint>>").alias("out"),
    )
    return per.select("batch", F.inline(F.aggregate("q", zero, step)["out"]))
