"""Streaming queries (M1, M3-M10): each streams a table derived from the given ones to its end."""

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import allocation as AL
from ..operators import trees as T
from ..sources import views
from ..streaming import operators as S
from ..streaming import timed as TQ
from ..streaming.replay import ReplayTable
from ..streaming.run import by_batch, each_batch, stream_of, to_table
from .allocation import BOUNDED, FLUSHED
from .registry import ALLOC, EDGES, R, ROLLOUTS, SOURCED, query


def queue_items(spark, path, lanes=4):
    e = views.replay_edges(spark, path)
    items = e.select(
        F.concat(F.lit("day"), F.col("iteration")).alias("snapshot"), F.pmod("edge_id", F.lit(lanes)).cast("int").alias("lane"), F.col("edge_id").alias("node_id"),
        F.col("edge_id").cast("double").alias("at"), F.lit("item").alias("kind"),
    )
    ends = items.select("snapshot", "lane").distinct().select("snapshot", "lane", F.lit(-1).cast("bigint").alias("node_id"), F.lit(0.0).alias("at"), F.lit("end").alias("kind"))
    return items.unionByName(ends)


@query("m01_budget_queue", f"""WITH {EDGES}, p AS (SELECT 'day'||iteration AS snapshot, (edge_id%4)::INT AS lane, edge_id AS node_id, row_number() OVER (PARTITION BY iteration, edge_id%4 ORDER BY edge_id)-1 AS p, count(*) OVER (PARTITION BY iteration, edge_id%4) AS n FROM redges)
  SELECT snapshot, lane, 0 AS queue, (p//8)::INT AS flush, CASE WHEN (p//8+1)*8<=n THEN 'capacity' ELSE 'drain' END AS reason, node_id FROM p""")
def budget_queue(spark, path):
    return to_table(S.budget_queue(stream_of(queue_items(spark, path), "queue"), capacity=8), "flushes")


# the chain of flushes of a lane: a flush ends at its capacity or before its timeout, the next one begins after it
CHAIN = """, n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY snapshot, lane) AS total,
    count(*) OVER (PARTITION BY snapshot, lane ORDER BY at_ms RANGE BETWEEN UNBOUNDED PRECEDING AND {wait} FOLLOWING) AS upto FROM items WINDOW w AS (PARTITION BY snapshot, lane ORDER BY at_ms, node_id)),
  e AS (SELECT *, least(i+{capacity}-1, upto) AS last FROM n),
  chain AS (SELECT snapshot, lane, 1::BIGINT AS i, 0 AS flush FROM n GROUP BY ALL UNION ALL SELECT e.snapshot, e.lane, e.last+1, flush+1 FROM chain JOIN e ON e.snapshot=chain.snapshot AND e.lane=chain.lane AND e.i=chain.i WHERE e.last<e.total),
  flushed AS (SELECT n.*, flush, CASE WHEN e.last=e.i+{capacity}-1 THEN 'capacity' ELSE 'timeout' END AS reason FROM chain JOIN e ON e.snapshot=chain.snapshot AND e.lane=chain.lane AND e.i=chain.i
    JOIN n ON n.snapshot=e.snapshot AND n.lane=e.lane AND n.i BETWEEN e.i AND e.last)"""


def ticked(items, beyond):
    """The items and a last row, of no queue, that moves the watermark `beyond` seconds past all of them."""
    tick = items.agg((F.max("at") + F.make_dt_interval(secs=F.lit(beyond))).alias("at")).withColumn("kind", F.lit("tick"))
    return items.unionByName(tick.withColumns({"snapshot": F.lit("tick"), "lane": F.lit(0), "node_id": F.lit(-1).cast("bigint")}), allowMissingColumns=True)


@query("m01_timed_queue", f"""WITH RECURSIVE {EDGES}, items AS (SELECT 'day'||iteration AS snapshot, (edge_id%4)::INT AS lane, edge_id AS node_id, epoch_ms(ts) AS at_ms FROM redges){CHAIN.format(wait=4 * 3600000 - 1, capacity=4)}
  SELECT snapshot, lane, 0 AS queue, flush, reason, node_id FROM flushed""")
def timed_queue(spark, path):
    """Queues that get no more rows flush when the watermark has passed their timeout."""
    items = views.replay_edges(spark, path).select(
        F.concat(F.lit("day"), F.col("iteration")).alias("snapshot"), F.pmod("edge_id", F.lit(4)).cast("int").alias("lane"), F.col("edge_id").alias("node_id"),
        F.col("ts").cast("timestamp").alias("at"), F.lit("item").alias("kind"),
    )
    return to_table(TQ.timed_queue(stream_of(ticked(items, 5.0 * 3600), "items"), 4, 4.0 * 3600), "timed").drop("flushed_at")


def allocated_flushes(stream, wait):
    """Queue, flush groups and the exact allocation of each flush, in one stream; a micro-batch is a partition of the result."""
    flushes = TQ.flush_groups(TQ.timed_queue(stream, 8, wait, carry=["node", "default_k", "predicted_k", "c"]), ["node", "default_k", "predicted_k", "c"])

    def allocate(df):
        rows = df.select(F.col("lane").cast("bigint").alias("queue"), F.col("flush").cast("bigint").alias("flush"), "reason", F.inline("nodes")).drop("node_id").withColumnRenamed("node", "node_id")
        rows = rows.select("queue", "flush", "reason", "node_id", "default_k", "predicted_k", "c")
        budget = rows.groupBy("queue", "flush").agg((F.sum("default_k") + F.max(F.when(F.col("queue") % 5 == 0, 60).otherwise(0))).alias("budget"))
        bounded = AL.bounds(rows, budget, n_min=1, max_k=12, repair_k=14)
        return AL.allocate(bounded).select("queue", "flush", "reason", "node_id", "k")

    return flushes, allocate


def waiting_nodes(spark, path):
    """Nodes that ask for a budget, one a minute."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("seq") * 60)
    nodes = views.alloc_nodes(spark, path)
    return nodes.select(F.lit("policy").alias("snapshot"), F.col("queue").cast("int").alias("lane"), F.col("seq").alias("node_id"), at.alias("at"), F.lit("item").alias("kind"), F.col("node_id").alias("node"), "default_k", "predicted_k", "c")


@query("m01_allocated_flushes", f"""WITH RECURSIVE {ALLOC}, items AS (SELECT 'policy' AS snapshot, queue::INT AS lane, seq AS node_id, seq*60000 AS at_ms, node_id AS node, default_k, predicted_k, c FROM alloc){CHAIN.format(wait=200 * 60000 - 1, capacity=8)},
  fl AS (SELECT lane::BIGINT AS queue, flush, reason, node AS node_id, default_k, predicted_k, c FROM flushed){BOUNDED[len(FLUSHED):]} SELECT queue, flush::BIGINT AS flush, reason, node_id, k::BIGINT AS k FROM res""")
def stream_allocation(spark, path):
    from ..session import scratch_path

    flushes, allocate = allocated_flushes(stream_of(ticked(waiting_nodes(spark, path), 300.0 * 60), "nodes"), 200.0 * 60)
    out = scratch_path(spark, "allocated")
    each_batch(flushes, "allocated", by_batch(out, allocate))
    return spark.read.schema("queue bigint, flush bigint, reason string, node_id string, k bigint, batch bigint").parquet(out).drop("batch")


@query("m03_replay_lifecycle", f"WITH {EDGES} SELECT edge_id, question_id, iteration, {R('advantage')} AS advantage, 'free' AS status FROM redges WHERE 29-iteration<8")
def replay_lifecycle(spark, path):
    e = views.replay_edges(spark, path).select("edge_id", "question_id", "iteration", "advantage")
    table = ReplayTable(spark, 8, "edge_id bigint, question_id bigint, iteration int, advantage double")
    each_batch(stream_of(e.repartitionByRange(3, "iteration"), "edges", files_per_trigger=1), "replay", table.add)
    return table.read().withColumn("advantage", r6("advantage"))


@query("m03_reserve_commit", f"""WITH {EDGES}, f AS (SELECT * FROM redges WHERE 29-iteration<8), c AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY md5('2|'||edge_id), edge_id) AS r FROM f), s AS (SELECT edge_id FROM c WHERE r<=4 ORDER BY md5('2.all|'||edge_id), edge_id LIMIT 256)
  SELECT edge_id FROM f WHERE edge_id NOT IN (SELECT edge_id FROM s)""")
def reserve_commit(spark, path):
    e = views.replay_edges(spark, path).select("edge_id", "question_id", "iteration", "advantage")
    table = ReplayTable(spark, 8, "edge_id bigint, question_id bigint, iteration int, advantage double")
    table.add(e, 0)
    table.reserve("u1", cap=4, target=256, seed=2)
    table.rollback("u1")
    table.reserve("u2", cap=4, target=256, seed=2)
    table.commit("u2")
    return table.read().select("edge_id")


@query("m04_full_batches", f"""WITH {SOURCED}, g AS (SELECT data_source, uid FROM sourced GROUP BY ALL HAVING stddev_pop(correct)>0 OR count(*)=1), r AS (SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY uid)-1 AS p, count(*) OVER (PARTITION BY data_source) AS n FROM g)
  SELECT data_source AS lane, (p//32)::INT AS batch, uid FROM r WHERE (p//32+1)*32<=n""")
def full_batches(spark, path):
    g = views.rollouts_by_source(spark, path).groupBy(F.col("data_source").alias("lane"), "uid").agg(
        ((F.stddev_pop("correct") > 0) | (F.count(F.lit(1)) == 1)).alias("varied")
    )
    return to_table(S.full_batches(stream_of(g, "groups"), 32), "batches")


@query("m05_running_moments", f"WITH {ROLLOUTS} SELECT pred, count(*) AS n, {R('avg(score)')} AS mean, {R('var_pop(score)')} AS var, {R('stddev_samp(score)')} AS std FROM rollouts GROUP BY 1")
def running_moments(spark, path):
    from ..session import scratch_path

    rows = views.rollouts(spark, path).select("pred", "score").repartition(4, "score")
    out = scratch_path(spark, "moments")
    seen = []

    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{out}/{batch_id}")
        seen.append(batch_id)

    each_batch(S.running_moments(stream_of(rows, "scores", 1), "pred", "score"), "moments", write, "complete")
    last = spark.read.parquet(f"{out}/{max(seen)}")
    return last.withColumns({c: r6(c) for c in ("mean", "var", "std")})


@query("m06_idle_counter", f"""WITH {EDGES}, s AS (SELECT question_id AS run, iteration, max(advantage)>3.5 AS progress FROM redges GROUP BY 1,2),
  i AS (SELECT *, sum(progress::INT) OVER (PARTITION BY run ORDER BY iteration) AS isl FROM s), d AS (SELECT run, iteration, sum((NOT progress)::INT) OVER (PARTITION BY run, isl ORDER BY iteration)::BIGINT AS idle FROM i) SELECT *, idle>=5 AS abort FROM d""")
def idle_counter(spark, path):
    s = views.replay_edges(spark, path).groupBy(F.col("question_id").alias("run"), "iteration").agg((F.max("advantage") > 3.5).alias("progress"))
    return to_table(S.idle_counter(stream_of(s, "status"), 5), "idle")


@query("m06_silent_runs", f"""WITH {EDGES}, s AS (SELECT question_id AS run, iteration, max(advantage)>3.5 AS progress FROM redges GROUP BY 1,2),
  g AS (SELECT *, (iteration-lag(iteration) OVER (PARTITION BY run ORDER BY iteration)>=2)::INT AS gap FROM s), p AS (SELECT *, coalesce(sum(gap) OVER (PARTITION BY run ORDER BY iteration),0) AS life FROM g),
  i AS (SELECT *, sum(progress::INT) OVER (PARTITION BY run, life ORDER BY iteration) AS isl FROM p), d AS (SELECT run, iteration, life, sum((NOT progress)::INT) OVER (PARTITION BY run, life, isl ORDER BY iteration)::BIGINT AS idle FROM i)
  SELECT run, iteration, idle, idle>=5 AS abort, 'counted' AS reason FROM d UNION ALL SELECT run, max(iteration), arg_max(idle, iteration), true, 'silent' FROM d GROUP BY run, life""")
def silent_runs(spark, path):
    """Runs without a row for two days are aborted by a timer and leave the state."""
    at = lambda day: F.timestamp_seconds(F.lit(1704067200) + day * 86400)
    s = views.replay_edges(spark, path).groupBy(F.col("question_id").alias("run"), "iteration").agg((F.max("advantage") > 3.5).alias("progress"))
    tick = s.agg(at(F.max("iteration") + 3).alias("at")).select(F.lit(-1).cast("bigint").alias("run"), F.lit(-1).alias("iteration"), F.lit(None).cast("boolean").alias("progress"), "at")
    return to_table(TQ.idle_runs(stream_of(s.withColumn("at", at(F.col("iteration"))).unionByName(tick), "status"), 5, 2.0 * 86400), "silent")


@query("m08_adaptive_rounds", f"""WITH {ROLLOUTS}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY rollout_id) AS r FROM rollouts), p AS (SELECT uid, (r-1)//3+1 AS round, sum(correct) AS s, count(*) AS c FROM r WHERE r<=15 GROUP BY ALL),
  w AS (SELECT uid, round, sum(s) OVER v AS s, sum(c) OVER v AS n FROM p WINDOW v AS (PARTITION BY uid ORDER BY round)), z AS (SELECT *, 2*1.96::DOUBLE*sqrt(s/n*(1-s/n)/n)<=0.7 AS stop FROM w)
  SELECT uid, coalesce(min(round) FILTER (stop), max(round)) AS rounds, max(round) AS available FROM z GROUP BY 1""")
def adaptive_rounds(spark, path):
    return S.adaptive_rounds(views.rollouts(spark, path), 3, 5, 0.7)


# sentence BLEU of order 2 of the siblings i < j of a parent, then the fold of acceptance along i
ACCEPTED = r"""w AS (SELECT conv_id AS parent, turn AS i, list_filter(string_split_regex(text, '\s+'), lambda x: x<>'') AS w FROM conversations),
  gr AS (SELECT parent, i, 1 AS n, unnest(w) AS g FROM w UNION ALL SELECT parent, i, 2, unnest(list_transform(range(1, len(w)), lambda p: w[p]||' '||w[p+1])) FROM w),
  gc AS (SELECT parent, i, n, g, count(*) AS c FROM gr GROUP BY ALL),
  m AS (SELECT a.parent, a.i, b.i AS j, a.n, sum(least(a.c, b.c)) AS m FROM gc a JOIN gc b ON a.parent=b.parent AND a.n=b.n AND a.g=b.g AND a.i<b.i GROUP BY ALL),
  sc AS (SELECT m.parent, m.i, m.j, avg(ln(m/(len(wa.w)-n+1))) AS logs, any_value(len(wa.w)) AS len, any_value(len(wb.w)) AS ref FROM m JOIN w wa ON wa.parent=m.parent AND wa.i=m.i JOIN w wb ON wb.parent=m.parent AND wb.i=m.j
    GROUP BY ALL HAVING count(*)=2),
  bl AS (SELECT parent, map(list(i||'_'||j), list(exp(logs)*CASE WHEN len>ref THEN 1.0 ELSE exp(1-ref/len) END)) AS b FROM sc GROUP BY 1),
  tr AS (SELECT w.parent, w.i, coalesce(b, MAP {}) AS b, row_number() OVER (PARTITION BY w.parent ORDER BY w.i) AS r FROM w LEFT JOIN bl USING (parent)),
  acc AS (SELECT parent, 0::BIGINT AS r, []::BIGINT[] AS got FROM tr GROUP BY 1
    UNION ALL SELECT tr.parent, tr.r, CASE WHEN tr.i=7 OR coalesce(list_sum(list_transform(got, lambda a: coalesce(b[a||'_'||tr.i], 0.0))), 0.0)/greatest(len(got), 1)<=0.002 THEN list_append(got, tr.i) ELSE got END
      FROM acc JOIN tr ON tr.parent=acc.parent AND tr.r=acc.r+1)"""
ACCEPTANCE = f"WITH RECURSIVE {ACCEPTED} SELECT parent, unnest(got) AS i FROM (SELECT parent, arg_max(got, r) AS got FROM acc GROUP BY 1)"


@query("m09_stream_acceptance", ACCEPTANCE)
def stream_acceptance(spark, path):
    """The same in a stream: the accepted texts' counts are state, arrival is event time."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("turn"))
    texts = views.messages(spark, path).select(F.col("conv_id").alias("parent"), F.col("turn").alias("i"), "text", (F.col("turn") == 7).alias("last"), at.alias("at"))
    return to_table(TQ.diverse_stream(stream_of(texts, "texts"), 0.002, 60.0), "accepted")


@query("m09_diverse_acceptance", ACCEPTANCE)
def diverse_acceptance(spark, path):
    texts = views.messages(spark, path).select(F.col("conv_id").alias("parent"), F.col("turn").alias("i"), "text")
    return T.diverse_acceptance(texts, T.pair_bleu(texts, order=2), 0.002, F.col("i") == 7)


@query("m10_append_rows", "SELECT event_id, event_type FROM events")
def append_rows(spark, path):
    e = views.table(spark, path, "events").select("event_id", "event_type")
    return to_table(stream_of(e.repartitionByRange(2, "event_id"), "events", 1), "appended")
