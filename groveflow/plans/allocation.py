"""Allocation and divergence queries (B rows, A21, A23, A26-A30, J3, J4, J13)."""

from pyspark.sql import functions as F

from ..functions import numeric as X
from ..functions.numeric import r6
from ..operators import allocation as AL
from ..operators import divergence as D
from ..operators.evaluation import centred_rank
from ..operators.spread import exact_quantiles
from ..session import materialise
from ..sources import views
from .registry import ALLOC, PILOTS, R, SUPPORT, U, query

SEED1, SEED2 = U("md5('1|'||node_id)"), U("md5('2|'||node_id)")
FLUSHED = ALLOC + """, fl AS (SELECT *, (row_number() OVER (PARTITION BY queue ORDER BY seq)-1)//8 AS flush FROM alloc)"""
BOUNDED = FLUSHED + """, bud AS (SELECT queue, flush, sum(default_k)+CASE WHEN queue%5=0 THEN 60 ELSE 0 END AS budget FROM fl GROUP BY queue, flush),
  b0 AS (SELECT fl.*, budget, 1 AS lower, CASE WHEN predicted_k<default_k THEN predicted_k ELSE 12 END AS up0, predicted_k<default_k AS hard FROM fl JOIN bud USING (queue, flush)),
  b1 AS (SELECT *, budget>sum(up0) OVER p AND NOT hard AND up0<14 AS repaired FROM b0 WINDOW p AS (PARTITION BY queue, flush)),
  b AS (SELECT *, CASE WHEN repaired THEN 14 ELSE up0 END AS upper FROM b1),
  bb AS (SELECT *, least(budget, sum(upper) OVER p)-sum(lower) OVER p AS to_give, greatest(budget-sum(upper) OVER p,0) AS slack FROM b WINDOW p AS (PARTITION BY queue, flush)),
  st AS (SELECT *, unnest(range(lower, upper)) AS k FROM bb),
  rk AS (SELECT *, row_number() OVER (PARTITION BY queue, flush ORDER BY c/(k*(k+1)) DESC, node_id, k) AS r FROM st),
  won AS (SELECT node_id, count(*) AS won FROM rk WHERE r<=to_give GROUP BY 1),
  res AS (SELECT bb.*, lower+coalesce(won,0) AS k FROM bb LEFT JOIN won USING (node_id))"""


def flushed(spark, path):
    return AL.batch_flushes(views.alloc_nodes(spark, path), 8)


def bounded(spark, path):
    rows = flushed(spark, path)
    extra = F.when(F.col("queue") % 5 == 0, 60).otherwise(0)
    budget = rows.groupBy("queue", "flush").agg((F.sum("default_k") + F.max(extra)).alias("budget"))
    return materialise(AL.bounds(rows, budget, n_min=1, max_k=12, repair_k=14), "bounded")


def allocated(spark, path):
    return AL.allocate(bounded(spark, path))


@query("b01_allocation", f"WITH {BOUNDED} SELECT queue, flush, node_id, k::BIGINT AS k FROM res")
def allocation(spark, path):
    return allocated(spark, path).select("queue", "flush", "node_id", "k")


@query("b02_bounds", f"WITH {BOUNDED} SELECT node_id, lower::BIGINT AS lower, upper::BIGINT AS upper, hard, repaired, slack::BIGINT AS slack, CASE WHEN slack>0 THEN 'slack' ELSE 'ok' END AS status FROM bb")
def bounds(spark, path):
    return bounded(spark, path).select("node_id", "lower", "upper", "hard", "repaired", "slack", "status")


SUMMARY = """s AS (SELECT queue, flush, count(*) AS nodes, max(budget)::BIGINT AS budget, sum(k)::BIGINT AS allocated,
  CASE WHEN sum(least(greatest(default_k,lower),upper))=max(budget-slack) THEN sum(c/least(greatest(default_k,lower),upper)) ELSE sum(c/default_k) END AS before, sum(c/k) AS after,
  sum(greatest(default_k-k,0))::BIGINT AS pruned, sum(greatest(k-default_k,0))::BIGINT AS expanded, max(slack)::BIGINT AS slack, count(*) FILTER (repaired) AS repaired FROM res GROUP BY ALL)"""


@query("b03_summary", f"WITH {BOUNDED}, {SUMMARY} SELECT queue, flush, nodes, budget, allocated, {R('before')} AS before, {R('after')} AS after, pruned, expanded, slack, repaired, least(pruned,expanded) AS transferred FROM s")
def summary(spark, path):
    return AL.allocation_summary(allocated(spark, path)).withColumns({"before": r6("before"), "after": r6("after")})


CONT = BOUNDED + """, ev AS (SELECT queue, flush, lower/sqrt(c) AS t FROM bb WHERE c>0 UNION SELECT queue, flush, upper/sqrt(c) FROM bb WHERE c>0),
  tot AS (SELECT ev.queue, ev.flush, ev.t, any_value(to_give) AS to_give, sum(least(greatest(sqrt(c)*ev.t,lower),upper)-lower) AS spent,
     sum(CASE WHEN lower/sqrt(c)<=ev.t AND upper/sqrt(c)>ev.t THEN sqrt(c) ELSE 0.0 END) AS slope FROM ev JOIN bb ON bb.queue=ev.queue AND bb.flush=ev.flush AND c>0 GROUP BY ALL),
  tt AS (SELECT queue, flush, max(t) AS t FROM tot WHERE spent<=to_give+1e-12 GROUP BY ALL),
  ts AS (SELECT queue, flush, CASE WHEN slope>1e-9 THEN t+(to_give-spent)/slope ELSE t END AS t FROM tt JOIN tot USING (queue, flush, t)),
  r0 AS (SELECT bb.*, CASE WHEN c>0 THEN least(greatest(sqrt(c)*t,lower),upper)::DOUBLE ELSE lower::DOUBLE END AS raw0 FROM bb LEFT JOIN ts USING (queue, flush)),
  r1 AS (SELECT *, greatest(to_give-sum(raw0-lower) OVER p,0.0) AS rest, coalesce(sum(upper-raw0) OVER (PARTITION BY queue, flush ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0.0) AS bef FROM r0 WINDOW p AS (PARTITION BY queue, flush)),
  cont AS (SELECT *, raw0+greatest(least(upper-raw0, rest-bef),0.0) AS raw FROM r1)"""


@query("b04_continuous", f"WITH {CONT} SELECT node_id, {R('raw')} AS raw FROM cont")
def continuous(spark, path):
    return AL.continuous(bounded(spark, path)).select("node_id", r6("raw").alias("raw"))


def _rounding(strategy, start, label):
    sql = f"""WITH {CONT}, a AS (SELECT *, least(greatest({start},lower),upper)::BIGINT AS s0 FROM cont),
      g AS (SELECT *, sum(lower) OVER p+to_give-sum(s0) OVER p AS gap FROM a WINDOW p AS (PARTITION BY queue, flush)),
      up AS (SELECT node_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY queue, flush ORDER BY round(raw-k,9) DESC, node_id, k) AS r FROM (SELECT *, unnest(range(s0, upper)) AS k FROM g WHERE gap>0)) WHERE r<=gap GROUP BY 1),
      dn AS (SELECT node_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY queue, flush ORDER BY round(raw-(s0-k),9), node_id, k) AS r FROM (SELECT *, unnest(range(0, s0-lower)) AS k FROM g WHERE gap<0)) WHERE r<=-gap GROUP BY 1)
      SELECT g.node_id, (s0+coalesce(up.n,0)-coalesce(dn.n,0))::BIGINT AS k FROM g LEFT JOIN up USING (node_id) LEFT JOIN dn USING (node_id)"""

    @query(label, sql)
    def run(spark, path):
        return AL.round_bounded(AL.continuous(bounded(spark, path)), strategy, seed=1).select("node_id", "k")


_rounding("largest_remainder", "floor(raw+1e-9)", "b05_largest_remainder")
_rounding("nearest_repair", "floor(raw+0.5)", "b05_nearest_repair")
_rounding("stochastic", f"floor(raw)+({SEED1}<raw-floor(raw))::INT", "b05_stochastic")

PAIRS = SUPPORT + """, prs AS (SELECT o.node_id, least(o.pilot,p.pilot) AS i, greatest(o.pilot,p.pilot) AS j, avg(abs(tanh((o.logp-p.logp)/2))) AS tv
  FROM support o JOIN support p ON o.node_id=p.node_id AND o.support=p.support AND o.pilot=o.origin AND p.pilot<>p.origin GROUP BY ALL),
  nn AS (SELECT node_id, count(*) AS n FROM pilots WHERE NOT finished GROUP BY 1)"""
BOUND = "least(tv+(1-tv)*0.05,1.0)"
LEMMA = "least(0.9*(tv+(1-tv)*0.05)/((1-0.9)*((1-0.9)+0.9*(tv+(1-tv)*0.05))),1.0)"


def pair_table(spark, path):
    return D.pair_distances(views.support_logps(spark, path))


def live_sizes(spark, path):
    return views.pilots(spark, path).where("NOT finished").groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query("j03_pair_distances", f"WITH {PAIRS} SELECT node_id, i, j, {R('tv')} AS tv FROM prs")
def pair_distances(spark, path):
    return pair_table(spark, path).select("node_id", "i", "j", r6("tv").alias("tv"))


@query("j04_legacy_pair_distances", f"""WITH {SUPPORT} SELECT a.node_id, a.pilot AS i, b.pilot AS j, {R('0.5*sum(abs(exp(a.logp)-exp(b.logp)))')} AS tv
  FROM support a JOIN support b ON a.node_id=b.node_id AND a.support=b.support AND a.pilot<b.pilot GROUP BY ALL""")
def legacy_distances(spark, path):
    return D.pair_distances_all(views.support_logps(spark, path)).select("node_id", "i", "j", r6("tv").alias("tv"))


@query("b06_dispersion", f"WITH {PAIRS} SELECT nn.node_id, n, {R(f'CASE WHEN n>1 THEN coalesce(sum(pow({BOUND},2)),0.0)/(n*n) ELSE 0.0 END')} AS c FROM nn LEFT JOIN prs USING (node_id) GROUP BY nn.node_id, n")
def dispersion(spark, path):
    return D.dispersion(pair_table(spark, path), live_sizes(spark, path), eps_tail=0.05).select("node_id", "n", r6("c").alias("c"))


@query("b07_value_gap_bounds", f"WITH {PAIRS} SELECT node_id, i, j, {R(BOUND)} AS linear, {R(LEMMA)} AS lemma FROM prs")
def gap_bounds(spark, path):
    tv = F.col("tv")
    return pair_table(spark, path).select(
        "node_id", "i", "j", r6(X.value_gap_bound(tv, eps_tail=0.05)).alias("linear"),
        r6(X.value_gap_bound(tv, gamma=0.9, eps_tail=0.05, form="simulation_lemma")).alias("lemma"),
    )


@query("b08_tanh_distance", f"""WITH {PILOTS} SELECT node_id, {R('avg(abs(tanh((a-b)/2)))')} AS d FROM (SELECT node_id, -level AS a, lead(-level) OVER (PARTITION BY node_id ORDER BY pilot) AS b FROM pilots) WHERE b IS NOT NULL GROUP BY 1""")
def tanh_pairs(spark, path):
    from pyspark.sql import Window

    nxt = F.lead(-F.col("level")).over(Window.partitionBy("node_id").orderBy("pilot"))
    rows = views.pilots(spark, path).select("node_id", (-F.col("level")).alias("a"), nxt.alias("b")).where("b IS NOT NULL")
    return rows.groupBy("node_id").agg(r6(F.avg(X.tanh_distance(F.col("a"), F.col("b")))).alias("d"))


@query("b09_softmax_distance", f"""WITH {SUPPORT}, z AS (SELECT *, exp(logp)/sum(exp(logp)) OVER (PARTITION BY node_id, pilot) AS p FROM support)
  SELECT a.node_id, a.pilot AS i, b.pilot AS j, {R('0.5*sum(abs(a.p-b.p))')} AS tv FROM z a JOIN z b ON a.node_id=b.node_id AND a.support=b.support AND a.pilot<b.pilot GROUP BY ALL""")
def softmax_distance(spark, path):
    return D.softmax_distances(views.support_logps(spark, path)).select("node_id", "i", "j", r6("tv").alias("tv"))


@query("b10_segment_statistics", f"""WITH {PILOTS}, a AS (SELECT node_id, list(-level-1 ORDER BY pilot) AS l, list(-level*0.9-1 ORDER BY pilot) AS m FROM pilots GROUP BY 1),
  u AS (SELECT node_id, unnest(l) AS x, unnest(m) AS y FROM a)
  SELECT node_id, {R('avg(abs(tanh((x-y)/2)))')} AS tanh_tv, {R('0.5*(sum(abs(exp(x)-exp(y)))+abs(greatest(1-sum(exp(x)),1e-12)-greatest(1-sum(exp(y)),1e-12)))')} AS legacy_tv,
   {R('ln(greatest(1-sum(exp(x)),1e-12))')} AS residual, {R('avg(x-y)')} AS mean_gap, {R('exp(-avg(x))')} AS perplexity, {R('max(x)+ln(sum(exp(x))/exp(max(x)))')} AS lse FROM u GROUP BY 1""")
def segment_statistics(spark, path):
    entry = F.struct("pilot", (-F.col("level") - 1).alias("x"), (-F.col("level") * 0.9 - 1).alias("y"))
    a = views.pilots(spark, path).groupBy("node_id").agg(F.sort_array(F.collect_list(entry)).alias("s"))
    a = a.select("node_id", F.transform("s", lambda e: e["x"]).alias("l"), F.transform("s", lambda e: e["y"]).alias("m"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    tanh = total(F.zip_with("l", "m", X.tanh_distance)) / F.size("l")
    rl, rm = X.residual_logp(F.col("l")), X.residual_logp(F.col("m"))
    legacy = 0.5 * (total(F.zip_with("l", "m", lambda x, y: F.abs(F.exp(x) - F.exp(y)))) + F.abs(F.exp(rl) - F.exp(rm)))
    return a.select(
        "node_id", r6(tanh).alias("tanh_tv"), r6(legacy).alias("legacy_tv"), r6(rl).alias("residual"),
        r6(total(F.zip_with("l", "m", lambda x, y: x - y)) / F.size("l")).alias("mean_gap"),
        r6(X.perplexity(F.col("l"))).alias("perplexity"), r6(X.log_sum_exp(F.col("l"))).alias("lse"),
    )


STAR = PAIRS + """, ord AS (SELECT node_id, pilot, row_number() OVER (PARTITION BY node_id ORDER BY pilot) AS q FROM pilots WHERE NOT finished),
  fold AS (WITH RECURSIVE f(node_id, q, reps, rep) AS (
     SELECT node_id, q, [pilot], pilot FROM ord WHERE q=1
     UNION ALL SELECT o.node_id, o.q, CASE WHEN h.r IS NULL THEN list_append(f.reps,o.pilot) ELSE f.reps END, coalesce(h.r,o.pilot)
     FROM f JOIN ord o ON o.node_id=f.node_id AND o.q=f.q+1
       LEFT JOIN (SELECT node_id, j, list({'i':i,'tv':tv} ORDER BY i) AS ps FROM prs GROUP BY ALL) m ON m.node_id=o.node_id AND m.j=o.pilot,
       LATERAL (SELECT list_min([x.i FOR x IN coalesce(m.ps,[]) IF list_contains(f.reps,x.i) AND x.tv<0.3]) AS r) h)
   SELECT node_id, q, rep FROM f),
  star AS (SELECT node_id, pilot, rep FROM fold JOIN ord USING (node_id, q))"""


def live(spark, path):
    return views.pilots(spark, path).where("NOT finished")


@query("b25_star_clusters", f"""WITH {STAR}, c AS (SELECT *, count(*) OVER (PARTITION BY node_id, rep) AS multiplicity, count(*) OVER (PARTITION BY node_id) AS total FROM star)
  SELECT node_id, pilot, (dense_rank() OVER (PARTITION BY node_id ORDER BY rep)-1)::INT AS cluster, pilot=rep AS is_rep, multiplicity, CASE WHEN pilot=rep THEN {R('multiplicity/total')} END AS rep_weight FROM c""")
def star_clusters(spark, path):
    rows = D.cluster_weights(D.star_clusters(live(spark, path), pair_table(spark, path), 0.3))
    return rows.withColumn("rep_weight", r6("rep_weight"))


@query("b26_reuse_weights", f"""WITH {STAR}, c AS (SELECT node_id, rep, count(*) AS m FROM star GROUP BY ALL) SELECT node_id, sum(m)::BIGINT AS total_multiplicity, count(*) AS representatives, {R('max(m)/sum(m)')} AS largest_share FROM c GROUP BY 1""")
def reuse_weights(spark, path):
    rows = D.cluster_weights(D.star_clusters(live(spark, path), pair_table(spark, path), 0.3)).where("is_rep")
    return rows.groupBy("node_id").agg(
        F.sum("multiplicity").alias("total_multiplicity"), F.count(F.lit(1)).alias("representatives"), r6(F.max("rep_weight")).alias("largest_share")
    )


# near pairs of a node; the pilot with most of them goes, the larger index on ties, until none is left
GREEDY = PAIRS + """, nr AS (SELECT node_id, list({'i':i,'j':j}) AS ps FROM prs WHERE tv<0.3 GROUP BY 1),
  a0 AS (SELECT p.node_id, list(pilot ORDER BY pilot) AS alive, coalesce(any_value(ps), []) AS ps FROM pilots p LEFT JOIN nr USING (node_id) WHERE NOT finished GROUP BY 1),
  g AS (WITH RECURSIVE f(node_id, alive, ps, k) AS (SELECT node_id, alive, ps, 0 FROM a0
     UNION ALL SELECT node_id, [x FOR x IN alive IF x<>w.i], [p FOR p IN ps IF p.i<>w.i AND p.j<>w.i], k+1
     FROM (SELECT *, list_max([{'d':len([p FOR p IN ps IF p.i=x OR p.j=x]),'i':x} FOR x IN alive]) AS w FROM f WHERE len(ps)>0))
   SELECT node_id, arg_max(alive,k) AS alive FROM f GROUP BY 1)"""


@query("b11_unique_pilots", f"WITH {GREEDY} SELECT node_id, unnest(alive) AS pilot FROM g")
def unique_pilots(spark, path):
    return D.unique_pilots(live(spark, path), pair_table(spark, path), 0.3)


@query("b12_predicted_k", f"""WITH {STAR}, r AS (SELECT node_id, count(*) AS k FROM star WHERE pilot=rep GROUP BY 1), f AS (SELECT node_id, count(*) FILTER (finished) AS n_finished FROM pilots GROUP BY 1)
  SELECT node_id, n_finished, coalesce(k,0)+n_finished AS predicted_k FROM f LEFT JOIN r USING (node_id)""")
def predicted_k(spark, path):
    reps = D.star_clusters(live(spark, path), pair_table(spark, path), 0.3).where("is_rep")
    return D.predicted_k(reps, views.pilots(spark, path))


@query("b13_reuse_candidates", f"""WITH {STAR}, r AS (SELECT node_id, pilot, row_number() OVER (PARTITION BY node_id ORDER BY md5('9|'||node_id||'|'||pilot), pilot) AS r FROM star WHERE pilot=rep)
  SELECT node_id, pilot FROM r WHERE r<=2""")
def reuse_candidates(spark, path):
    reps = D.star_clusters(live(spark, path), pair_table(spark, path), 0.3).where("is_rep")
    return D.reuse_candidates(reps, 2, seed=9).select("node_id", "pilot")


@query("j13_share_targets", f"""WITH {STAR.replace('x.tv<0.3', 'x.tv+0.05<=0.3')} SELECT node_id, pilot, CASE WHEN pilot=rep THEN 'expand' ELSE 'share' END AS action, CASE WHEN pilot<>rep THEN rep END AS target FROM star""")
def share_targets(spark, path):
    return D.share_targets(live(spark, path), pair_table(spark, path), 0.05, X.eta(0.3, 1.0))


@query("b14_perplexity_branching", f"""WITH {PILOTS}, p AS (SELECT node_id, avg(CASE WHEN NOT finished THEN level END) AS m FROM pilots GROUP BY 1)
  SELECT node_id, CASE WHEN m IS NULL THEN 2 ELSE greatest(2, ceil(exp(m/2))) END::BIGINT AS k FROM p""")
def perplexity_branching(spark, path):
    lps = views.pilots(spark, path).groupBy("node_id").agg(F.collect_list(F.when(~F.col("finished"), -F.col("level") / 2)).alias("lp"))
    return lps.select("node_id", D.branch_factor_from_perplexity(F.col("lp")).cast("bigint").alias("k"))


def node_proxies(spark, path):
    pairs = pair_table(spark, path)
    sizes = live_sizes(spark, path)
    disp = D.dispersion(pairs, sizes, eps_tail=0.05)
    tv2 = pairs.groupBy("node_id").agg(F.sum(F.col("tv") * F.col("tv")).alias("s"))
    var = views.pilots(spark, path).groupBy("node_id").agg(F.var_pop("reward").alias("variance"), F.avg("level").alias("external"))
    rows = disp.join(tv2, "node_id", "left").join(var, "node_id")
    return rows.withColumn("tv2", F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("n"))).drop("s")


PROXY = PAIRS + f""", px AS (SELECT nn.node_id, n, CASE WHEN n>1 THEN coalesce(sum(pow({BOUND},2)),0.0)/(n*n) ELSE 0.0 END AS c, coalesce(sum(tv*tv),0.0)/(n*n) AS tv2 FROM nn LEFT JOIN prs USING (node_id) GROUP BY nn.node_id, n),
  pv AS (SELECT node_id, var_pop(reward) AS variance, avg(level) AS external FROM pilots GROUP BY 1)"""


@query("b15_dispersion_proxies", f"""WITH {PROXY} SELECT node_id, {R('c')} AS bound, 1.0::DOUBLE AS uniform, {R("1-" + U("md5('proxy|'||node_id)"))} AS random, {R('tv2')} AS direct_tv, {R('variance')} AS empirical_variance, {R('external')} AS external FROM px JOIN pv USING (node_id)""")
def proxies(spark, path):
    names = ["bound", "uniform", "random", "direct_tv", "empirical_variance", "external"]
    return node_proxies(spark, path).select("node_id", *[r6(D.proxy(m)).alias(m) for m in names])


@query("b16_thresholds", f"""WITH {PAIRS} SELECT n, {R('sqrt(ln(2/0.05)/(2*n))')} AS radius, {R('0.2/1.0')} AS eta, {R('0.2+sqrt(ln(2/0.05)/(2*n))')} AS tau, count(*) AS nodes FROM nn GROUP BY n""")
def thresholds(spark, path):
    rows = live_sizes(spark, path).groupBy("n").agg(F.count(F.lit(1)).alias("nodes"))
    radius = X.confidence_radius(F.col("n"), 0.05)
    return rows.select("n", r6(radius).alias("radius"), r6(F.lit(X.eta(0.2, 1.0))).alias("eta"), r6(X.eta(0.2, 1.0) + radius).alias("tau"), "nodes")


@query("b18_queue_budgets", """WITH r AS (SELECT c_nationkey AS batch, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)-1)%3 AS slot FROM customer),
  s AS (SELECT batch, count(*) FILTER (slot=0) AS n0, count(*) FILTER (slot=1) AS n1, count(*) FILTER (slot=2) AS n2, count(*) AS n FROM r GROUP BY 1),
  a AS (SELECT *, round_even(250*n0/n,0)::BIGINT AS b0 FROM s), b AS (SELECT *, round_even((250-b0)*n1/(n-n0),0)::BIGINT AS b1 FROM a), c AS (SELECT *, 250-b0-b1 AS b2 FROM b)
  SELECT batch, 0::BIGINT AS slot, n0 AS n, b0 AS budget FROM c UNION ALL SELECT batch, 1, n1, b1 FROM c UNION ALL SELECT batch, 2, n2, b2 FROM c""")
def queue_budgets(spark, path):
    nodes = views.alloc_nodes(spark, path).withColumnRenamed("queue", "batch")
    return AL.queue_budgets(nodes, 3, 250)


@query("b19_accounting", f"""WITH {BOUNDED} SELECT node_id, upper::BIGINT AS cap, lower::BIGINT AS base, greatest(default_k-k,0)::BIGINT AS saved, greatest(k-default_k,0)::BIGINT AS additional, greatest(k-default_k,0)::BIGINT AS unmet, {R('sqrt(c)')} AS weight, k BETWEEN lower AND upper AS valid FROM res""")
def accounting(spark, path):
    rows = AL.accounting(allocated(spark, path))
    return rows.select("node_id", "cap", "base", "saved", "additional", "unmet", r6("weight").alias("weight"), "valid")


def _baseline(name, spark_raw, sql_raw):
    sql = f"""WITH {FLUSHED}, bu AS (SELECT *, count(*) OVER p*4 AS budget, sum(c) OVER p AS tc, count(*) OVER p AS nf FROM fl WINDOW p AS (PARTITION BY queue, flush)),
      a AS (SELECT *, least(greatest({sql_raw},1),12)::BIGINT AS s0 FROM bu), g AS (SELECT *, budget-sum(s0) OVER (PARTITION BY queue, flush) AS gap FROM a),
      up AS (SELECT node_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY queue, flush ORDER BY k, node_id) AS r FROM (SELECT *, unnest(range(0, 12-s0)) AS k FROM g WHERE gap>0)) WHERE r<=gap GROUP BY 1),
      dn AS (SELECT node_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY queue, flush ORDER BY k, node_id) AS r FROM (SELECT *, unnest(range(0, s0-1)) AS k FROM g WHERE gap<0)) WHERE r<=-gap GROUP BY 1)
      SELECT g.node_id, (s0+coalesce(up.n,0)-coalesce(dn.n,0))::BIGINT AS k FROM g LEFT JOIN up USING (node_id) LEFT JOIN dn USING (node_id)"""

    @query(f"b20_{name}", sql)
    def run(spark, path):
        rows = flushed(spark, path)
        per = rows.groupBy("queue", "flush").agg((F.count(F.lit(1)) * 4).alias("budget"), F.sum("c").alias("tc"), F.count(F.lit(1)).alias("nf"))
        return AL.scale_to_budget(rows.join(per, ["queue", "flush"]), spark_raw(), 1, 12).select("node_id", "k")


_baseline("fixed", lambda: F.floor(F.col("budget") / F.col("nf")), "budget//nf")
_baseline("random", lambda: 1 + F.floor(X.uniform(X.sample_key(2, F.col("node_id"))) * 12), f"1+floor({SEED2}*12)")
_baseline("proportional", lambda: F.bround(F.col("budget") * F.greatest(F.col("c"), F.lit(1e-9)) / F.greatest(F.col("tc"), F.lit(1e-9))), "round_even(budget*greatest(c,1e-9)/greatest(tc,1e-9),0)")


TERM = PAIRS + f""", tc AS (SELECT node_id, count(*) AS n, count(*) FILTER (finished) AS f FROM pilots GROUP BY 1),
  tt AS (SELECT a.node_id, sum(pow(a.reward-b.reward,2)) AS s FROM pilots a JOIN pilots b ON a.node_id=b.node_id AND a.pilot<b.pilot AND a.finished AND b.finished GROUP BY 1),
  cc AS (SELECT node_id, sum(pow({BOUND},2)) AS s FROM prs GROUP BY 1)"""


@query("b24_terminal_dispersion", f"""WITH {TERM} SELECT tc.node_id, n, f AS n_finished, {R('CASE WHEN n>1 AND n-f>1 THEN coalesce(cc.s,0.0)/((n-f)*(n-f)) ELSE 0.0 END')} AS continuing,
  {R('CASE WHEN n>1 THEN coalesce(tt.s,0.0)/(n*n) ELSE 0.0 END')} AS terminal, {R('CASE WHEN n>1 THEN f*(n-f)/(n*n) ELSE 0.0 END')} AS crossing,
  {R('CASE WHEN n>1 THEN (coalesce(cc.s,0.0)+coalesce(tt.s,0.0)+f*(n-f))/(n*n) ELSE 0.0 END')} AS c FROM tc LEFT JOIN cc USING (node_id) LEFT JOIN tt USING (node_id)""")
def terminal_dispersion(spark, path):
    out = D.terminal_dispersion(views.pilots(spark, path), pair_table(spark, path), eps_tail=0.05)
    return out.select("node_id", "n", "n_finished", r6("continuing").alias("continuing"), r6("terminal").alias("terminal"), r6("cross").alias("crossing"), r6("c").alias("c"))


@query("a21_accounting_totals", f"""WITH {BOUNDED}, a AS (SELECT *, predicted_k AS pg, least(predicted_k,k) AS pr, floor(c*1000)::BIGINT AS mt FROM res)
  SELECT queue, sum(default_k)::BIGINT AS default_k, sum(k)::BIGINT AS k, sum(pg)::BIGINT AS pilots_generated, sum(pr)::BIGINT AS pilots_reused, sum(pg*7+mt+pg*3)::BIGINT AS generated_tokens,
   sum(pg*11+pg*5)::BIGINT AS scored_tokens, sum(pg*7+mt+pg*3+pg*11+pg*5+k)::BIGINT AS compute_proxy, {R('sum(pr)/sum(pg)')} AS reuse_rate FROM a GROUP BY 1""")
def accounting_totals(spark, path):
    pg, k = F.col("predicted_k"), F.col("k")
    rows = AL.accounting(allocated(spark, path)).withColumns(
        {
            "built": k, "pilots_generated": pg, "pilots_reused": F.least(pg, k), "pilots_shortcut": F.lit(0), "pilots_discarded": pg - F.least(pg, k),
            "pilot_tokens": pg * 7, "support_tokens": pg * 3, "main_tokens": F.floor(F.col("c") * 1000), "proxy_tokens": k,
            "generation_requests": pg, "scoring_requests": pg, "prefill_tokens": pg * 11, "continuation_tokens": pg * 5,
        }
    )
    t = AL.accounting_totals(rows, ["queue"])
    return t.select("queue", "default_k", "k", "pilots_generated", "pilots_reused", "generated_tokens", "scored_tokens", "compute_proxy", r6("reuse_rate").alias("reuse_rate"))


TRACE = PAIRS + f""", tr AS (SELECT prs.*, {BOUND} AS bound, abs(a.reward-b.reward) AS gap FROM prs JOIN pilots a ON a.node_id=prs.node_id AND a.pilot=i JOIN pilots b ON b.node_id=prs.node_id AND b.pilot=j)"""


@query("a23_pruning_trace", f"WITH {TRACE} SELECT node_id, i, j, {R('tv')} AS tv, {R('bound')} AS bound, tv<0.3 AS duplicate, bound<=0.4 AS prune, gap<=bound AS holds FROM tr")
def pruning_trace(spark, path):
    t = D.pruning_trace(pair_table(spark, path), views.pilots(spark, path), 0.4, 0.3, eps_tail=0.05)
    return t.select("node_id", "i", "j", r6("tv").alias("tv"), r6("bound").alias("bound"), "duplicate", "prune", "holds")


@query("a23_pruning_summary", f"WITH {TRACE} SELECT count(*) AS pairs, count(DISTINCT node_id) AS nodes, {R('avg((tv<0.3)::INT)')} AS duplicate_rate, {R('avg((bound<=0.4)::INT)')} AS prune_rate, {R('avg((gap<=bound)::INT)')} AS holds_rate, {R('avg(tv)')} AS mean_tv FROM tr")
def pruning_summary(spark, path):
    t = D.pruning_trace(pair_table(spark, path), views.pilots(spark, path), 0.4, 0.3, eps_tail=0.05)
    rate = lambda c: r6(F.avg(F.col(c).cast("int")))
    return t.agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("node_id").alias("nodes"), rate("duplicate").alias("duplicate_rate"),
        rate("prune").alias("prune_rate"), rate("holds").alias("holds_rate"), r6(F.avg("tv")).alias("mean_tv"),
    )


# calibration records: consecutive pilots, distance at horizons 1, 2, 4 and at full length
HORIZONS = [1, 2, 4]
CAL = PILOTS + """, nx AS (SELECT node_id, pilot, level, slope, lead(level) OVER w AS l2, lead(slope) OVER w AS s2 FROM pilots WINDOW w AS (PARTITION BY node_id ORDER BY pilot)),
  cal AS (SELECT node_id, pilot, pilot%3 AS depth, abs(tanh((level-l2)/2+(slope-s2)/3)) AS d_l, abs(tanh((level-l2)/8)) AS d1, abs(tanh((level-l2)/4)) AS d2, abs(tanh((level-l2)/2)) AS d4 FROM nx WHERE l2 IS NOT NULL)"""


def calibration(spark, path):
    from pyspark.sql import Window

    w = Window.partitionBy("node_id").orderBy("pilot")
    p = views.pilots(spark, path).select(
        "node_id", "pilot", (F.col("level") - F.lead("level").over(w)).alias("l"), (F.col("slope") - F.lead("slope").over(w)).alias("s")
    ).where("l IS NOT NULL")
    dist = lambda x: F.abs(F.tanh(x))
    return p.select(
        "node_id", "pilot", (F.col("pilot") % 3).alias("depth"), dist(F.col("l") / 2 + F.col("s") / 3).alias("d_l"),
        dist(F.col("l") / 8).alias("d1"), dist(F.col("l") / 4).alias("d2"), dist(F.col("l") / 2).alias("d4"),
    )


HZ = "hz AS (SELECT h AS horizon, depth, node_id, pilot, d_l, CASE h WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d4 END AS d_m, greatest(d_l-CASE h WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d4 END,0.0)/(1-CASE h WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d4 END+0.001) AS ratio FROM cal, (VALUES (1),(2),(4)) t(h))"


def by_horizon(spark, path):
    pick = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"d{h}").alias("d_m")) for h in HORIZONS])
    rows = calibration(spark, path).select("node_id", "pilot", "depth", "d_l", F.inline(pick))
    return rows.withColumn("ratio", D.tail_ratio(F.col("d_l"), F.col("d_m"), 0.001))


@query("a26_tail_calibration", f"""WITH {CAL}, {HZ}, q AS (SELECT horizon, quantile_cont(ratio,0.9) AS q90, quantile_cont(ratio,0.5) AS q50, corr(d_m,d_l) AS pearson, avg(d_l-d_m) AS mean_gap FROM hz GROUP BY 1)
  SELECT horizon, {R('any_value(q90)')} AS q90, {R('any_value(q50)')} AS q50, {R('any_value(pearson)')} AS pearson, {R('any_value(mean_gap)')} AS mean_gap, {R('avg((d_l<=d_m+(1-d_m)*q90+0.001)::INT)')} AS coverage FROM hz JOIN q USING (horizon) GROUP BY 1""")
def tail_calibration(spark, path):
    rows = materialise(by_horizon(spark, path), "horizons")
    q = exact_quantiles(rows, F.col("ratio"), [0.5, 0.9], ["horizon"]).groupBy("horizon").pivot("prob", [0.5, 0.9]).agg(F.first("value"))
    q = q.select("horizon", F.col("`0.5`").alias("q50"), F.col("`0.9`").alias("q90"))
    # three horizons: the joined table has one row per horizon of the configuration
    out = rows.join(F.broadcast(q), "horizon")
    cover = F.col("d_l") <= F.col("d_m") + (1 - F.col("d_m")) * F.col("q90") + 0.001
    return out.groupBy("horizon").agg(
        r6(F.max("q90")).alias("q90"), r6(F.max("q50")).alias("q50"), r6(F.corr("d_m", "d_l")).alias("pearson"),
        r6(F.avg(F.col("d_l") - F.col("d_m"))).alias("mean_gap"), r6(F.avg(cover.cast("int"))).alias("coverage"),
    )


@query("a26_tail_quantiles_by_depth", f"WITH {CAL}, {HZ} SELECT horizon, depth, {R('quantile_cont(ratio,0.9)')} AS q90 FROM hz GROUP BY ALL")
def tail_by_depth(spark, path):
    rows = materialise(by_horizon(spark, path), "horizons")
    return exact_quantiles(rows, F.col("ratio"), [0.9], ["horizon", "depth"]).select("horizon", "depth", r6("value").alias("q90"))


@query("a26_rank_correlation", f"""WITH {CAL}, r AS (SELECT rank() OVER (ORDER BY round(d4,9))+(count(*) OVER (PARTITION BY round(d4,9))-1)/2 AS a, rank() OVER (ORDER BY round(d_l,9))+(count(*) OVER (PARTITION BY round(d_l,9))-1)/2 AS b FROM cal)
  SELECT {R('corr(a,b)')} AS spearman, count(*) AS pairs FROM r""")
def rank_correlation(spark, path):
    rows = calibration(spark, path).select("node_id", "pilot", F.round("d4", 9).alias("d4"), F.round("d_l", 9).alias("d_l"))
    rows = materialise(rows.withColumn("row", F.struct("node_id", "pilot")), "ranks")
    a = centred_rank(rows, "d4", "row", "ra")
    b = centred_rank(a, "d_l", "row", "rb")
    return b.agg(r6(F.corr("ra", "rb")).alias("spearman"), F.count(F.lit(1)).alias("pairs"))


@query("a27_bound_quality", f"""WITH {PROXY} SELECT {R('corr(c,variance)')} AS pearson, {R('avg(c/(variance+0.001))')} AS mean_ratio, {R('avg((c<variance)::INT)')} AS violation_rate, count(*) AS nodes FROM px JOIN pv USING (node_id)""")
def bound_quality(spark, path):
    rows = node_proxies(spark, path)
    return rows.agg(
        r6(F.corr("c", "variance")).alias("pearson"), r6(F.avg(F.col("c") / (F.col("variance") + 0.001))).alias("mean_ratio"),
        r6(F.avg((F.col("c") < F.col("variance")).cast("int"))).alias("violation_rate"), F.count(F.lit(1)).alias("nodes"),
    )


@query("a28_adaptive_lookahead", f"""WITH {CAL}, h AS (SELECT *, CASE WHEN abs(d2-d1)<=0.05 THEN 1 WHEN abs(d4-d2)<=0.05 THEN 2 ELSE 4 END AS horizon FROM cal),
  r AS (SELECT horizon, greatest(d_l-CASE horizon WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d4 END,0.0) AS res FROM h) SELECT horizon, count(*) AS pairs, {R('avg(res)')} AS residual_mean, {R('quantile_cont(res,0.9)')} AS residual_q90 FROM r GROUP BY 1""")
def lookahead(spark, path):
    d = {h: F.col(f"d{h}") for h in HORIZONS}
    rows = calibration(spark, path).withColumn("horizon", D.first_stable_horizon(HORIZONS, d, 0.05))
    at = F.when(F.col("horizon") == 1, d[1]).when(F.col("horizon") == 2, d[2]).otherwise(d[4])
    rows = materialise(rows.select("horizon", F.greatest(F.col("d_l") - at, F.lit(0.0)).alias("res")), "residuals")
    q = exact_quantiles(rows, F.col("res"), [0.9], ["horizon"]).select("horizon", F.col("value").alias("q"))
    s = rows.groupBy("horizon").agg(F.count(F.lit(1)).alias("pairs"), F.avg("res").alias("m"))
    return s.join(q, "horizon").select("horizon", "pairs", r6("m").alias("residual_mean"), r6("q").alias("residual_q90"))


def _give(rows, weight):
    """Allocation of the flush budget (4 per node, cap 32) by an arbitrary weight."""
    per = rows.groupBy("queue", "flush").agg((F.count(F.lit(1)) * 3).alias("to_give"))
    rows = rows.drop("c").join(per, ["queue", "flush"]).withColumns({"lower": F.lit(1).cast("bigint"), "upper": F.lit(32).cast("bigint"), "c": weight})
    return AL.allocate(rows.withColumn("status", F.lit("ok")))


def _give_sql(name, weight):
    return f"""{name} AS (SELECT node_id, 1+count(*) FILTER (r<=g) AS k FROM (SELECT *, row_number() OVER (PARTITION BY queue, flush ORDER BY w/(k*(k+1)) DESC, node_id, k) AS r FROM
      (SELECT queue, flush, node_id, {weight} AS w, 3*count(*) OVER (PARTITION BY queue, flush) AS g, unnest(range(1,32)) AS k FROM po)) GROUP BY 1)"""


POOL = FLUSHED + """, po AS (SELECT fl.*, v.s2 FROM fl JOIN (SELECT o_custkey, var_pop(ln(o_totalprice)) AS s2 FROM orders GROUP BY 1) v ON seq=o_custkey)"""


def pooled(spark, path):
    var = views.rollouts(spark, path).groupBy(F.col("uid").alias("seq")).agg(F.var_pop("score").alias("s2"))
    return materialise(flushed(spark, path).join(var, "seq"), "pool")


@query("a29_allocation_regret", f"""WITH {POOL}, {_give_sql('ku', '1.0')}, {_give_sql('kc', 'c')}, {_give_sql('ko', 's2')}
  SELECT {R('sum(s2/ku.k)')} AS j_uniform, {R('sum(s2/kc.k)')} AS j_bound, {R('sum(s2/ko.k)')} AS j_measured, {R('sum(s2/kc.k)-sum(s2/ko.k)')} AS regret_bound, {R('sum(s2/ku.k)-sum(s2/ko.k)')} AS regret_uniform
  FROM po JOIN ku USING (node_id) JOIN kc USING (node_id) JOIN ko USING (node_id)""")
def regret(spark, path):
    pool = pooled(spark, path)
    out = pool.select("node_id", "s2")
    for name, w in {"ku": F.lit(1.0), "kc": F.col("keep"), "ko": F.col("s2")}.items():
        k = _give(pool.withColumn("keep", F.col("c")), w).select("node_id", F.col("k").alias(name))
        out = out.join(k, "node_id")
    j = lambda k: F.sum(F.col("s2") / F.col(k))
    return out.agg(
        r6(j("ku")).alias("j_uniform"), r6(j("kc")).alias("j_bound"), r6(j("ko")).alias("j_measured"),
        r6(j("kc") - j("ko")).alias("regret_bound"), r6(j("ku") - j("ko")).alias("regret_uniform"),
    )


@query("a30_value_error", f"""WITH {POOL}, {_give_sql('ku', '1.0')}, {_give_sql('ko', 's2')}, m AS (SELECT node_id, 'uniform' AS method, k FROM ku UNION ALL SELECT node_id, 'measured', k FROM ko),
  pool AS (SELECT node_id, o_orderkey AS id, ln(o_totalprice) AS r, count(*) OVER (PARTITION BY node_id) AS n, avg(ln(o_totalprice)) OVER (PARTITION BY node_id) AS ref FROM po JOIN orders ON seq=o_custkey),
  h AS (SELECT pool.*, seed, row_number() OVER (PARTITION BY node_id, seed ORDER BY md5(seed||'|'||id), id) AS i FROM pool, range(0,4) s(seed)),
  wo AS (SELECT method, node_id, seed, avg(r) AS v, any_value(ref) AS ref FROM h JOIN m USING (node_id) WHERE k<=n AND i<=k GROUP BY ALL),
  wr AS (SELECT m.method, m.node_id, h.seed, avg(r) AS v, any_value(ref) AS ref FROM m JOIN (SELECT DISTINCT node_id, seed, n FROM h) x USING (node_id), LATERAL (SELECT unnest(range(1,m.k+1)) AS t) y
     JOIN h ON h.node_id=m.node_id AND h.seed=x.seed AND h.i=floor({U("md5(x.seed||'|'||m.node_id||'|'||y.t)")}*x.n)+1 WHERE m.k>x.n GROUP BY ALL),
  e AS (SELECT method, pow(v-ref,2) AS e FROM wo UNION ALL SELECT method, pow(v-ref,2) FROM wr)
  SELECT method, count(*) AS samples, {R('avg(e)')} AS mse FROM e GROUP BY 1""")
def value_error(spark, path):
    from ..operators.sampling import sampled_means

    pool = pooled(spark, path)
    k = _give(pool, F.lit(1.0)).select("node_id", F.lit("uniform").alias("method"), "k").unionByName(
        _give(pool, F.col("s2")).select("node_id", F.lit("measured").alias("method"), "k")
    )
    rewards = views.rollouts(spark, path).select(F.col("uid").alias("seq"), F.col("rollout_id").alias("id"), F.col("score").alias("r"))
    rewards = rewards.join(pool.select("seq", "node_id"), "seq").drop("seq")
    out = sampled_means(rewards, materialise(k, "k"), seeds=4, k_max=32)
    err = F.pow(F.col("mean") - F.col("ref"), F.lit(2.0))
    return out.groupBy("method").agg(F.count(F.lit(1)).alias("samples"), r6(F.avg(err)).alias("mse"))


@query("b16_tail_by_depth", f"WITH {CAL}, e AS (SELECT * FROM (VALUES (0,0.01::DOUBLE),(2,0.05::DOUBLE)) t(d,eps)), j AS (SELECT node_id, pilot, depth, (SELECT arg_max(eps,d) FROM e WHERE d<=depth) AS eps FROM cal) SELECT depth, {R('any_value(eps)')} AS eps, count(*) AS pairs FROM j GROUP BY 1")
def tail_eps(spark, path):
    rows = calibration(spark, path).withColumn("eps", D.eps_for_depth(F.col("depth"), {0: 0.01, 2: 0.05}, 0.0))
    return rows.groupBy("depth").agg(r6(F.max("eps")).alias("eps"), F.count(F.lit(1)).alias("pairs"))
