"""Replay, batch and quality queries."""

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import quality as Q
from ..operators import replay as RP
from ..operators import trees as T
from ..operators.evaluation import shard_report
from ..operators.sampling import contiguous_shard
from ..operators.spread import first_k, value_bucket
from ..session import materialise
from ..sources import views
from .registry import EDGES, NODES, R, ROLLOUTS, TOKENS, query

FRESH = EDGES + ", fresh AS (SELECT *, 29-iteration AS age FROM redges WHERE 29-iteration BETWEEN 0 AND 7)"
SAMPLED = FRESH + """, cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY md5('11|'||edge_id), edge_id) AS r FROM fresh) WHERE r<=32),
  smp AS (SELECT * FROM cap ORDER BY md5('11.all|'||edge_id), edge_id LIMIT 512)"""


def sampled(spark, path):
    return RP.sample_edges(views.replay_edges(spark, path), now=29, max_age=8, cap=32, target=512, seed=11)


@query("w13_replay_sample", f"WITH {SAMPLED} SELECT edge_id, question_id, age FROM smp")
def replay_sample(spark, path):
    return sampled(spark, path).select("edge_id", "question_id", "age")


@query("w13_replay_statistics", f"WITH {SAMPLED} SELECT count(*) AS sampled, count(DISTINCT question_id) AS questions, {R('avg(age)')} AS mean_age, max(age) AS max_age, count(*)<512 AS underfilled FROM smp")
def replay_statistics(spark, path):
    return RP.sample_stats(sampled(spark, path), 512).withColumn("mean_age", r6("mean_age"))


@query("w13_age_histogram", f"WITH {SAMPLED} SELECT age, count(*) AS n FROM smp GROUP BY 1")
def age_histogram(spark, path):
    return sampled(spark, path).groupBy("age").agg(F.count(F.lit(1)).alias("n"))


@query("w14_simple_replay", f"WITH {SAMPLED} SELECT iteration, count(*) AS left_over FROM fresh WHERE edge_id NOT IN (SELECT edge_id FROM cap WHERE r<=6) GROUP BY 1")
def simple_replay(spark, path):
    edges = RP.fresh(views.replay_edges(spark, path), 29, 8)
    used = RP.capped_edges(views.replay_edges(spark, path), 29, 8, cap=6, seed=11)
    return edges.join(used.select("edge_id"), "edge_id", "left_anti").groupBy("iteration").agg(F.count(F.lit(1)).alias("left_over"))


def treed(spark, path):
    return views.replay_edges(spark, path).withColumn("tree_id", F.col("question_id") * 100 + F.col("iteration"))


# per question in tree order up to 8 edges (the first tree always), then all picked trees in hash order up to 512
PACKED = EDGES + """, tz AS (SELECT question_id AS q, question_id*100+iteration AS t, count(*) AS s FROM redges WHERE 29-iteration BETWEEN 0 AND 7 GROUP BY ALL),
  tn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY t) AS r FROM tz),
  pk AS (SELECT q, r, t, s AS used, true AS took, s FROM tn WHERE r=1
    UNION ALL SELECT n.q, n.r, n.t, CASE WHEN pk.used+n.s<=8 THEN pk.used+n.s ELSE pk.used END, pk.used+n.s<=8, n.s FROM pk JOIN tn n ON n.q=pk.q AND n.r=pk.r+1),
  sh AS (SELECT t, s, row_number() OVER (ORDER BY md5('4|'||t), t) AS r FROM pk WHERE took),
  al AS (SELECT 0::BIGINT AS r, 0::BIGINT AS t, 0::HUGEINT AS used, false AS took, 0::BIGINT AS s
    UNION ALL SELECT sh.r, sh.t, CASE WHEN al.used+sh.s<=512 THEN al.used+sh.s ELSE al.used END, al.used+sh.s<=512, sh.s FROM al JOIN sh ON sh.r=al.r+1)"""


@query("w15_complete_trees", f"WITH RECURSIVE {PACKED} SELECT t AS tree_id, s AS size FROM al WHERE took")
def complete_trees(spark, path):
    return RP.complete_trees(treed(spark, path), now=29, max_age=8, cap=8, target=512, seed=4)


def slots(spark, path):
    e = views.replay_edges(spark, path)
    n = F.lit(1) + F.pmod("edge_id", F.lit(7))
    return e.withColumns({"n_tokens": n, "n_active": F.when(F.col("kind") == "error", 0).otherwise(F.floor(n / 2))})


SLOTS = EDGES + ", sl AS (SELECT *, 1+edge_id%7 AS n_tokens, CASE WHEN kind='error' THEN 0 ELSE (1+edge_id%7)//2 END AS n_active, (row_number() OVER (PARTITION BY iteration ORDER BY edge_id)-1)//4 AS batch FROM redges)"
BATCHES = SLOTS + """, lb AS (SELECT iteration, batch, count(*) AS slots, sum(n_tokens)::BIGINT AS tokens, sum(n_active)::BIGINT AS active_tokens, count(*) FILTER (advantage<>0) AS rows,
    CASE WHEN count(*) FILTER (advantage<>0)=0 THEN 'all_zero' WHEN sum(CASE WHEN advantage<>0 THEN n_active ELSE 0 END)<=0 THEN 'zero_active' ELSE 'trainable' END AS status FROM sl GROUP BY 1,2)"""


@query("w16_logical_batches", f"WITH {BATCHES} SELECT * FROM lb")
def logical_batches(spark, path):
    return RP.logical_batches(slots(spark, path), 4, ["iteration"], "edge_id")


@query("w16_padding_rows", f"WITH {BATCHES} SELECT iteration, batch, (3-rows%3)%3 AS dummies FROM lb WHERE rows%3<>0")
def padding(spark, path):
    pad = RP.pad_rows(RP.logical_batches(slots(spark, path), 4, ["iteration"], "edge_id"), 3)
    return pad.groupBy("iteration", "batch").agg(F.count(F.lit(1)).alias("dummies"))


@query("w17_micro_batches", f"""WITH RECURSIVE {EDGES}, sx AS (SELECT *, 1+edge_id%7 AS n_tokens, (row_number() OVER (PARTITION BY iteration ORDER BY edge_id)-1)//64 AS b FROM redges),
  g AS (SELECT iteration||'/'||b AS batch, (question_id%8)::VARCHAR AS tree, question_id::VARCHAR AS parent, sum(n_tokens)::BIGINT AS size FROM sx GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY tree, parent) AS r FROM g),
  w AS (SELECT batch, r, parent, size, 0 AS micro, CASE WHEN size>16 THEN 1 ELSE 0 END AS nm, CASE WHEN size>16 THEN 0 ELSE size END AS used FROM o WHERE r=1
    UNION ALL SELECT batch, r, parent, size, nm+new, nm+new+big, CASE WHEN big=1 THEN 0 WHEN new=1 THEN size ELSE used+size END FROM (
      SELECT o.*, w.nm, w.used, (o.size>16)::INT AS big, (w.used>0 AND w.used+o.size>16)::INT AS new FROM w JOIN o ON o.batch=w.batch AND o.r=w.r+1))
  SELECT batch, parent, size, micro::INT AS micro FROM w""")
def micro_batches(spark, path):
    rows = RP.with_batch(slots(spark, path), 64, ["iteration"], "edge_id")
    g = rows.groupBy(F.concat_ws("/", "iteration", "batch").alias("batch"), F.pmod("question_id", F.lit(8)).alias("tree"), F.col("question_id").alias("parent")).agg(F.sum("n_tokens").alias("size"))
    return RP.micro_batches(g, 16)


BAL = ROLLOUTS + """, bal AS (SELECT *, (row_number() OVER (ORDER BY n_tokens DESC, rollout_id)-1) AS p FROM rollouts),
  sh AS (SELECT *, CASE WHEN (p//8)%2=0 THEN p%8 ELSE 7-p%8 END AS shard, ntile(8) OVER (ORDER BY rollout_id)-1 AS block FROM bal)"""


@query("w19_balanced_shards", f"WITH {BAL} SELECT shard, count(*) AS rows, sum(n_tokens)::BIGINT AS tokens FROM sh GROUP BY 1")
def balanced(spark, path):
    out = RP.balanced_shards(views.rollouts(spark, path), "n_tokens", "rollout_id", 8)
    return out.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"))


@query("w11_contiguous_shards", f"WITH {BAL} SELECT rollout_id, block::BIGINT AS shard FROM sh")
def contiguous(spark, path):
    df = views.rollouts(spark, path)
    return contiguous_shard(df, "rollout_id", 8, value_bucket(df, F.col("rollout_id"), 1024)).select("rollout_id", "shard")


@query("a31_length_imbalance", f"""WITH {BAL}, a AS (SELECT 'balanced' AS layout, shard AS s, sum(n_tokens) AS t FROM sh GROUP BY ALL UNION ALL SELECT 'contiguous', block, sum(n_tokens) FROM sh GROUP BY ALL)
  SELECT layout, min(t)::BIGINT AS min_sum, max(t)::BIGINT AS max_sum, {R('avg(t)')} AS mean_sum, (max(t)-min(t))::BIGINT AS spread FROM a GROUP BY 1""")
def imbalance(spark, path):
    df = views.rollouts(spark, path)
    a = shard_report(RP.balanced_shards(df, "n_tokens", "rollout_id", 8), "shard", "n_tokens").withColumn("layout", F.lit("balanced"))
    b = shard_report(contiguous_shard(df, "rollout_id", 8, value_bucket(df, F.col("rollout_id"), 1024)), "shard", "n_tokens").withColumn("layout", F.lit("contiguous"))
    return a.unionByName(b).withColumn("mean_sum", r6("mean_sum"))


def tree_rows(spark, path):
    n = views.nodes(spark, path).where("parent_id IS NOT NULL")
    return n.withColumns(
        {"edge_id": F.col("node_id"), "multiplicity": F.lit(1) + F.length("text") % 3, "loss": F.sqrt(F.length("node_id") + F.length("text"))}
    )


TROWS = NODES + ", tr AS (SELECT *, node_id AS edge_id, 1+length(text)%3 AS m, sqrt(length(node_id)+length(text)) AS loss FROM nodes WHERE parent_id IS NOT NULL)"


@query("w21_objective_weights", f"""WITH {TROWS}, t AS (SELECT tree_id, count(*) AS seg, count(DISTINCT parent_id) AS par FROM tr GROUP BY 1)
  SELECT edge_id, round(1e6*1.0::DOUBLE/((SELECT count(*) FROM t)*seg),6)+0.0 AS segment_weight, round(1e6*1.0::DOUBLE/(SELECT count(*) FROM t)/par*m/sum(m) OVER (PARTITION BY parent_id),6)+0.0 AS node_weight FROM tr JOIN t USING (tree_id)""")
def objective_weights(spark, path):
    w = RP.objective_weights(tree_rows(spark, path))
    return w.select("edge_id", r6(F.col("segment_weight") * 1e6).alias("segment_weight"), r6(F.col("node_weight") * 1e6).alias("node_weight"))


@query("w21_weight_sums", f"""WITH {TROWS} SELECT tree_id, {R('1.0/(SELECT count(DISTINCT tree_id) FROM tr)')} AS segment_sum, {R('1.0/(SELECT count(DISTINCT tree_id) FROM tr)')} AS node_sum FROM tr GROUP BY 1""")
def weight_sums(spark, path):
    w = RP.objective_weights(tree_rows(spark, path))
    return w.groupBy("tree_id").agg(r6(F.sum("segment_weight")).alias("segment_sum"), r6(F.sum("node_weight")).alias("node_sum"))


@query("w22_hierarchical_mean", f"""WITH {TROWS}, p AS (SELECT tree_id, parent_id, sum(m*loss)/sum(m) AS l FROM tr GROUP BY ALL), t AS (SELECT tree_id, avg(l) AS l FROM p GROUP BY 1) SELECT {R('avg(l)')} AS loss, count(*) AS trees FROM t""")
def hierarchical(spark, path):
    return RP.hierarchical_mean(tree_rows(spark, path), "loss").withColumn("loss", r6("loss"))


@query("w23_batch_objective", f"""WITH {ROLLOUTS}, {TOKENS}, b AS (SELECT rollout_id, (row_number() OVER (ORDER BY rollout_id)-1)//64 AS batch FROM rollouts),
  r AS (SELECT rollout_id, sum(mask*value*sqrt(value)) AS s, sum(mask) AS n FROM tokens GROUP BY 1)
  SELECT batch, {R('coalesce(sum(CASE WHEN n>0 THEN s/n ELSE 0.0 END),0.0)/count(*)')} AS segment_mean, {R('coalesce(sum(s),0.0)/greatest(coalesce(sum(n),0),1)')} AS token_mean, count(*) AS slots FROM b LEFT JOIN r USING (rollout_id) GROUP BY 1""")
def batch_objective(spark, path):
    tok = views.tokens(spark, path).withColumn("loss", F.col("value") * F.sqrt("value"))
    ids = RP.with_batch(views.rollouts(spark, path).select("rollout_id"), 64, [], "rollout_id")
    out = RP.batch_objective(tok, ids)
    return out.withColumns({c: r6(c) for c in ("segment_mean", "token_mean")})


@query("w20_row_algebra", """SELECT event_id AS row_id, k AS copy, value, (event_type='view') AS conflict FROM events, range(1,6) t(k) WHERE k<=user_id%4""")
def row_algebra(spark, path):
    ev = views.table(spark, path, "events")
    a = ev.select(F.col("event_id").alias("row_id"), F.col("event_type").alias("kind"), F.pmod("user_id", F.lit(4)).alias("n"))
    b = ev.select(F.col("event_id").alias("row_id"), F.when(F.col("event_type") == "view", "other").otherwise(F.col("event_type")).alias("kind"), "value")
    rows = RP.repeat_rows(RP.union_columns(a, b, "row_id"), "n")
    return rows.select("row_id", F.col("copy").cast("bigint").alias("copy"), "value", "conflict")


@query("m06_progress_runs", f"""WITH {EDGES}, s AS (SELECT question_id AS run, iteration, max(advantage)>3.5 AS progress FROM redges GROUP BY 1,2),
  i AS (SELECT *, sum(progress::INT) OVER (PARTITION BY run ORDER BY iteration) AS isl FROM s), d AS (SELECT run, iteration, progress, sum((NOT progress)::INT) OVER (PARTITION BY run, isl ORDER BY iteration)::BIGINT AS idle FROM i)
  SELECT *, idle>=5 AS abort FROM d""")
def progress_runs(spark, path):
    s = views.replay_edges(spark, path).groupBy(F.col("question_id").alias("run"), "iteration").agg((F.max("advantage") > 3.5).alias("progress"))
    return RP.progress_runs(s, 5)


# --- quality ------------------------------------------------------------------------------------------


def checked_edges(spark, path):
    """Edges of the customer-order level with the facts the construction rules need."""
    o = views.table(spark, path, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("e"), F.when(k % 500 == 0, k + 1).otherwise(k)).alias("edge_id"), F.col("o_custkey").alias("parent_id"),
        F.pmod("o_custkey", F.lit(50)).alias("tree_id"), (F.lit(8) + F.col("o_custkey") % 3).alias("allocated_k"), (F.col("o_orderstatus") != "P").alias("retained"),
        (F.lit(1) + (k % 100 == 0).cast("int")).alias("multiplicity"), (k % 1000 == 7).alias("pruned"), (k % 7).alias("n_tokens"), F.when(k % 300 == 1, 0).otherwise(k % 7).alias("n_logprobs"),
    )


CHECKED = """ce AS (SELECT 'e'||CASE WHEN o_orderkey%500=0 THEN o_orderkey+1 ELSE o_orderkey END AS edge_id, o_custkey AS parent_id, o_custkey%50 AS tree_id, 8+o_custkey%3 AS allocated_k, o_orderstatus<>'P' AS retained,
   1+(o_orderkey%100=0)::INT AS multiplicity, o_orderkey%1000=7 AS pruned, o_orderkey%7 AS n_tokens, CASE WHEN o_orderkey%300=1 THEN 0 ELSE o_orderkey%7 END AS n_logprobs FROM orders),
  pg AS (SELECT parent_id, count(DISTINCT tree_id) AS trees, count(DISTINCT allocated_k) AS ks, max(allocated_k) AS allocated, count(*) AS realised, count(*) FILTER (retained) AS retained, max(multiplicity) AS multiplicity FROM ce GROUP BY 1)"""


@query("q01_parent_groups", f"""WITH {CHECKED} SELECT parent_id, allocated, realised, retained, concat_ws(',', CASE WHEN realised<>allocated THEN 'realised_equals_allocated' END, CASE WHEN retained>allocated THEN 'retained_within_allocated' END) AS failures
  FROM pg WHERE realised<>allocated OR retained>allocated""")
def parent_groups(spark, path):
    bad = Q.failing(Q.parent_groups(checked_edges(spark, path)), Q.group_rules())
    return bad.select("parent_id", "allocated", "realised", "retained", F.array_join("failures", ",").alias("failures"))


@query("q02_construction_report", f"""WITH {CHECKED}, t AS (SELECT tree_id, count(*) AS n FROM ce GROUP BY 1)
  SELECT 'one_tree' AS rule, count(*) FILTER (trees<>1) AS failures FROM pg UNION ALL SELECT 'one_allocated_k', count(*) FILTER (ks<>1) FROM pg UNION ALL SELECT 'realised_equals_allocated', count(*) FILTER (realised<>allocated) FROM pg
  UNION ALL SELECT 'retained_within_allocated', count(*) FILTER (retained>allocated) FROM pg UNION ALL SELECT 'has_id', 0 UNION ALL SELECT 'not_pruned', count(*) FILTER (pruned) FROM ce UNION ALL SELECT 'logprobs_aligned', count(*) FILTER (n_logprobs<>n_tokens) FROM ce
  UNION ALL SELECT 'unique_ids', count(*) FROM (SELECT edge_id FROM ce GROUP BY 1 HAVING count(*)>1) UNION ALL SELECT 'queue_total', count(*) FILTER (n<>300) FROM t""")
def construction(spark, path):
    e = checked_edges(spark, path)
    trees = e.select("tree_id").distinct().withColumn("expected", F.lit(300))
    return Q.construction_report(e, trees)


@query("q03_replay_rules", f"""WITH {EDGES}, r AS (SELECT *, 29-iteration AS age, row_number() OVER (PARTITION BY question_id ORDER BY edge_id) AS rank FROM redges)
  SELECT 'has_id' AS rule, 0::BIGINT AS failures UNION ALL SELECT 'has_question', 0 UNION ALL SELECT 'has_iteration', 0 UNION ALL SELECT 'has_advantage', 0
  UNION ALL SELECT 'age_in_range', count(*) FILTER (age NOT BETWEEN 0 AND 7) FROM r UNION ALL SELECT 'within_cap', count(*) FILTER (rank>32) FROM r""")
def replay_rules(spark, path):
    from ..operators.spread import ranked

    e = views.replay_edges(spark, path).withColumn("age", F.lit(29) - F.col("iteration"))
    e = ranked(e, ["question_id"], [F.col("edge_id")], value_bucket(e, F.col("edge_id")))
    return Q.failure_counts(e, Q.replay_rules(8, 32))


@query("q04_fresh_sample_rules", f"WITH {CHECKED} SELECT 'realised_equals_allocated' AS rule, count(*) FILTER (realised<>allocated) AS failures FROM pg UNION ALL SELECT 'multiplicity_one', count(*) FILTER (multiplicity<>1) FROM pg")
def fresh_rules(spark, path):
    return Q.failure_counts(Q.parent_groups(checked_edges(spark, path)), Q.fresh_rules())


def records(spark, path):
    """Edges and slots with payload arrays, one per order; some break a rule."""
    e = F.struct("pos", F.col("old_lp").alias("lp"), (F.col("value") * 50).cast("int").alias("t"))
    arr = views.tokens(spark, path).groupBy("rollout_id").agg(F.sort_array(F.collect_list(e)).alias("x"))
    k = F.col("rollout_id")
    return views.rollouts(spark, path).select("rollout_id").join(arr, "rollout_id", "left").select(
        "rollout_id", ((k % 10 == 0) | F.col("x").isNull()).alias("is_slot"),
        F.when((k % 10 == 0) & (k % 30 != 0), None).otherwise(F.transform("x", lambda v: v["t"])).alias("tokens"),
        F.transform(F.when(k % 40 == 1, F.slice("x", 1, 1)).otherwise(F.col("x")), lambda v: v["lp"]).alias("logps"),
        F.coalesce(F.size("x"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.size(F.filter("x", lambda v: v["lp"] < F.log(F.lit(0.9)))), F.lit(0)).alias("n_active"),
    )


@query("q05_record_rules", f"""WITH {TOKENS}, a AS (SELECT rollout_id, count(*) AS n, count(*) FILTER (old_lp<ln(0.9)) AS act, max(CASE WHEN pos=0 THEN (old_lp<ln(0.9))::INT END) AS first_act FROM tokens GROUP BY 1),
  r AS (SELECT o_orderkey AS k, a.* FROM orders LEFT JOIN a ON rollout_id=o_orderkey),
  f AS (SELECT *, k%10=0 OR n IS NULL AS slot, k%30=0 AND n IS NOT NULL AS payload, CASE WHEN k%40=1 THEN least(n,1) ELSE n END AS nl, CASE WHEN k%40=1 THEN first_act ELSE act END AS la FROM r)
  SELECT 'slot_without_payload' AS rule, count(*) FILTER (slot AND payload) AS failures FROM f UNION ALL SELECT 'edge_with_payload', 0 UNION ALL SELECT 'token_count', 0
  UNION ALL SELECT 'logprob_count', count(*) FILTER (NOT slot AND nl<>n) FROM f UNION ALL SELECT 'mask_count', count(*) FILTER (NOT slot AND la<>act) FROM f""")
def record_rules(spark, path):
    return Q.failure_counts(records(spark, path), Q.slot_rules())


def listed(failures, counts):
    """Counts next to the number of listed rows that break the rule."""
    per = failures.select(F.explode("failures").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("listed"))
    return counts.join(per, "rule", "left").withColumn("listed", F.coalesce("listed", F.lit(0)))


@query("q05_rules_and_rows", f"""WITH {TOKENS}, a AS (SELECT rollout_id, count(*) AS n, count(*) FILTER (old_lp<ln(0.9)) AS act, max(CASE WHEN pos=0 THEN (old_lp<ln(0.9))::INT END) AS first_act FROM tokens GROUP BY 1),
  r AS (SELECT o_orderkey AS k, a.* FROM orders LEFT JOIN a ON rollout_id=o_orderkey),
  f AS (SELECT *, k%10=0 OR n IS NULL AS slot, k%30=0 AND n IS NOT NULL AS payload, CASE WHEN k%40=1 THEN least(n,1) ELSE n END AS nl, CASE WHEN k%40=1 THEN first_act ELSE act END AS la FROM r),
  c AS (SELECT 'slot_without_payload' AS rule, count(*) FILTER (slot AND payload) AS failures, count(*) AS rows FROM f UNION ALL SELECT 'edge_with_payload', 0, count(*) FROM f UNION ALL SELECT 'token_count', 0, count(*) FROM f
  UNION ALL SELECT 'logprob_count', count(*) FILTER (NOT slot AND nl<>n), count(*) FROM f UNION ALL SELECT 'mask_count', count(*) FILTER (NOT slot AND la<>act), count(*) FROM f) SELECT *, failures AS listed FROM c""")
def rules_and_rows(spark, path):
    """Failure rows and the counts of all rules from one run over the records."""
    return listed(*Q.inspect(records(spark, path), Q.slot_rules()))


@query("q01_rules_and_rows", f"""WITH {CHECKED}, c AS (SELECT 'one_tree' AS rule, count(*) FILTER (trees<>1) AS failures, count(*) AS rows FROM pg UNION ALL SELECT 'one_allocated_k', count(*) FILTER (ks<>1), count(*) FROM pg
  UNION ALL SELECT 'realised_equals_allocated', count(*) FILTER (realised<>allocated), count(*) FROM pg UNION ALL SELECT 'retained_within_allocated', count(*) FILTER (retained>allocated), count(*) FROM pg) SELECT *, failures AS listed FROM c""")
def group_rules_and_rows(spark, path):
    return listed(*Q.inspect(Q.parent_groups(checked_edges(spark, path)), Q.group_rules()))


@query("q06_complete_groups", f"""WITH {SAMPLED}, g AS (SELECT question_id, iteration, count(*) AS n FROM redges GROUP BY ALL), s AS (SELECT question_id, iteration, count(*) AS n FROM smp GROUP BY ALL)
  SELECT question_id, iteration, s.n AS reserved, g.n AS total FROM s JOIN g USING (question_id, iteration) WHERE s.n<>g.n""")
def complete_groups(spark, path):
    key = ["question_id", "iteration"]
    g = views.replay_edges(spark, path).groupBy(*key).agg(F.count(F.lit(1)).alias("total"))
    s = sampled(spark, path).groupBy(*key).agg(F.count(F.lit(1)).alias("reserved"))
    return s.join(g, key).where("reserved <> total").select(*key, "reserved", "total")


@query("q07_reuse_weights", f"WITH {TROWS}, p AS (SELECT parent_id, sum(m)::BIGINT AS total, min(m) AS low, count(*) AS n FROM tr GROUP BY 1) SELECT 'weights_positive' AS rule, count(*) FILTER (low<=0) AS failures FROM p UNION ALL SELECT 'sums_to_denominator', count(*) FILTER (total<>n*2) FROM p")
def reuse_weight_rules(spark, path):
    p = tree_rows(spark, path).groupBy("parent_id").agg(F.sum("multiplicity").alias("total"), F.min("multiplicity").alias("low"), F.count(F.lit(1)).alias("n"))
    return Q.failure_counts(p, {"weights_positive": F.col("low") > 0, "sums_to_denominator": F.col("total") == F.col("n") * 2})


@query("q08_anomaly_scan", f"""WITH t AS (SELECT CASE WHEN l_linenumber=7 AND l_tax=0 THEN 'nan'::DOUBLE ELSE l_quantity END AS a, CASE WHEN l_discount=0 AND l_tax=0 THEN 'inf'::DOUBLE ELSE l_extendedprice END AS b FROM lineitem),
  f AS (SELECT CASE WHEN isfinite(a) THEN a END AS a, CASE WHEN isfinite(b) THEN b END AS b FROM t), s AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM f)
  SELECT 'a' AS "column", (SELECT count(*) FROM t WHERE isnan(a)) AS nan, (SELECT count(*) FROM t WHERE isinf(a)) AS inf, count(*) FILTER (abs(a-ma)>1.5*sa) AS outliers, {R('avg((abs(a)<2)::INT)')} AS near_zero FROM f, s
  UNION ALL SELECT 'b', (SELECT count(*) FROM t WHERE isnan(b)), (SELECT count(*) FROM t WHERE isinf(b)), count(*) FILTER (abs(b-mb)>1.5*sb), {R('avg((abs(b)<2)::INT)')} FROM f, s""")
def anomaly_scan(spark, path):
    li = views.table(spark, path, "lineitem")
    df = li.select(
        F.when((F.col("l_linenumber") == 7) & (F.col("l_tax") == 0), float("nan")).otherwise(F.col("l_quantity")).alias("a"),
        F.when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), float("inf")).otherwise(F.col("l_extendedprice")).alias("b"),
    )
    return Q.anomalies(df, ["a", "b"], z=1.5, zero=2.0).withColumn("near_zero", r6("near_zero"))


@query("a25_run_manifest", f"""WITH {CHECKED} SELECT tree_id%5 AS run, count(*) AS edges, count(DISTINCT tree_id) AS trees, count(*) FILTER (retained) AS retained, count(*) FILTER (pruned) AS pruned_rows, count(*) FILTER (n_logprobs<>n_tokens) AS misaligned,
  NOT bool_or(pruned) AND NOT bool_or(n_logprobs<>n_tokens) AS valid FROM ce GROUP BY 1""")
def run_manifest(spark, path):
    e = checked_edges(spark, path)
    off = F.col("n_logprobs") != F.col("n_tokens")
    return e.groupBy(F.pmod("tree_id", F.lit(5)).alias("run")).agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct("tree_id").alias("trees"), F.count_if("retained").alias("retained"),
        F.count_if("pruned").alias("pruned_rows"), F.count_if(off).alias("misaligned"), F.every(~F.col("pruned") & ~off).alias("valid"),
    )


@query("w28_identity_collisions", f"""WITH {CHECKED} SELECT edge_id, count(*) AS n FROM ce GROUP BY 1 HAVING count(*)>1""")
def identity_collisions(spark, path):
    return Q.duplicates(checked_edges(spark, path), ["edge_id"])


@query("w28_against_buffer", f"""WITH {CHECKED}, b AS (SELECT edge_id FROM ce WHERE pruned), n AS (SELECT edge_id, tree_id FROM ce WHERE NOT retained) SELECT edge_id, tree_id FROM n WHERE edge_id IN (SELECT edge_id FROM b)""")
def against_buffer(spark, path):
    e = checked_edges(spark, path)
    return Q.collisions(e.where(~F.col("retained")).select("edge_id", "tree_id"), e.where("pruned"), ["edge_id"])


@query("f12_selected_per_question", f"""WITH {ROLLOUTS}, s AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY arrival, rollout_id) AS r FROM rollouts WHERE score>=11.5) SELECT uid, rollout_id FROM s WHERE r<=4""")
def selected(spark, path):
    good = views.rollouts(spark, path).where(F.col("score") >= 11.5)
    return first_k(good, ["uid"], [F.col("arrival"), F.col("rollout_id")], 4).select("uid", "rollout_id")


@query("f14_episode_length_filter", f"""WITH {ROLLOUTS}, {TOKENS}, l AS (SELECT rollout_id, count(*) AS r FROM tokens GROUP BY 1) SELECT count(*) FILTER (n_tokens+coalesce(r,0)<=300) AS kept, count(*) FILTER (n_tokens+coalesce(r,0)>300) AS dropped FROM rollouts LEFT JOIN l USING (rollout_id)""")
def length_filter(spark, path):
    l = views.tokens(spark, path).groupBy("rollout_id").agg(F.count(F.lit(1)).alias("r"))
    ok = F.col("n_tokens") + F.coalesce("r", F.lit(0)) <= 300  # a response without tokens has length 0
    return views.rollouts(spark, path).join(l, "rollout_id", "left").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))
