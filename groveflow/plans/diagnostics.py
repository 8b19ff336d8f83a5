"""Policy diagnostic queries."""

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import advantages as A
from ..operators import diagnostics as D
from ..operators.registry import DIAGNOSTICS
from ..sources import views
from .evaluation import VALUED, valued_tokens
from .registry import R, TOKENS, query

ALL6 = lambda df: df.select(*[r6(c).alias(c) for c in df.columns])
MM = lambda x, m="mask": f"(sum(({x})*{m})/(sum({m})+1e-8))"

LOGS = {
    "token": "old_lp-rollout_lp",
    "sequence": "sum((old_lp-rollout_lp)*mask) OVER (PARTITION BY rollout_id)",
    "geometric": "sum((old_lp-rollout_lp)*mask) OVER (PARTITION BY rollout_id)/(sum(mask) OVER (PARTITION BY rollout_id)+1e-8)",
}


def _weights(level, mode):
    cut = "least(raw,1.05)" if mode == "truncate" else "CASE WHEN raw>=1/1.05 AND raw<=1.05 THEN raw ELSE 0.0 END"
    sql = f"""WITH {TOKENS}, l AS (SELECT *, {LOGS[level]} AS lw, max((old_lp-rollout_lp<ln(0.91) AND mask=1)::INT) OVER (PARTITION BY rollout_id) AS bad FROM tokens),
      w AS (SELECT *, exp(least(greatest(lw,-20.0),20.0)) AS raw FROM l) SELECT rollout_id, pos, {R(f'(CASE WHEN bad=1 THEN 0.0 ELSE {cut} END)*mask')} AS weight FROM w"""

    @query(f"a09_weights_{level}_{mode}", sql)
    def run(spark, path):
        rows = D.importance_weights(views.tokens(spark, path), level, mode, upper=1.05, veto=0.91)
        return rows.select("rollout_id", "pos", r6("weight").alias("weight"))


for _l, _m in (("token", "truncate"), ("token", "mask"), ("sequence", "truncate"), ("geometric", "mask")):
    _weights(_l, _m)

Q = lambda p: R(f"quantile_cont(w,{p}) FILTER (mask=1)")


@query("a10_weight_metrics", f"""WITH {TOKENS}, t AS (SELECT rollout_id, mask, exp(old_lp-rollout_lp) AS w, least(greatest(exp(old_lp-rollout_lp),1/1.05),1.05) AS c FROM tokens),
  a AS (SELECT {MM('w')} AS mean, max(w) FILTER (mask=1) AS max, min(w) FILTER (mask=1) AS min, {MM('(w>1.05)::INT')} AS share_high, {MM('(w<1/1.05)::INT')} AS share_low, {MM('c')} AS mc, {MM('c*c')} AS mc2,
    {Q(0.25)} AS p25, {Q(0.5)} AS p50, {Q(0.75)} AS p75, {Q(0.95)} AS p95, {Q(0.99)} AS p99 FROM t),
  p AS (SELECT {MM('w')} AS s FROM t GROUP BY rollout_id), q AS (SELECT avg(s) AS seq_mean, stddev_samp(s) AS seq_std, max(s) AS seq_max, min(s) AS seq_min, max(abs(s-1)) AS seq_max_deviation, avg((s>1.05)::INT) AS seq_share_high, avg((s<1/1.05)::INT) AS seq_share_low FROM p)
  SELECT {', '.join(f'{R(c)} AS {c}' for c in 'mean max min share_high share_low seq_mean seq_std seq_max seq_min seq_max_deviation seq_share_high seq_share_low'.split())},
   {R('sqrt(greatest(mc2-mc*mc,0.0))')} AS std, {R('1.0/(mc2/pow(mc+1e-8,2))')} AS eff_sample_size, p25, p50, p75, p95, p99 FROM a, q""")
def weight_metrics(spark, path):
    rows = D.importance_weights(views.tokens(spark, path), "token", "truncate", upper=1.05, veto=None)
    return ALL6(D.weight_metrics(rows, 1.05))


@query("a11_policy_mismatch", f"""WITH {TOKENS}, p AS (SELECT {MM('old_lp')} AS mo, {MM('rollout_lp')} AS mr FROM tokens GROUP BY rollout_id)
  SELECT {R('avg(exp(-mo))')} AS training_ppl, {R('avg(-mo)')} AS training_log_ppl, {R('avg(exp(-mr))')} AS rollout_ppl, {R('avg(-mr)')} AS rollout_log_ppl, {R('avg(mr-mo)')} AS log_ppl_gap, {R('avg(abs(mr-mo))')} AS log_ppl_abs_gap,
   {R('max(mr-mo)')} AS log_ppl_gap_max, {R('min(mr-mo)')} AS log_ppl_gap_min, {R('avg(exp(mr-mo))')} AS ppl_ratio, {R('(SELECT ' + MM('rollout_lp-old_lp') + ' FROM tokens)')} AS kl,
   {R('(SELECT ' + MM('exp(old_lp-rollout_lp)-(old_lp-rollout_lp)-1') + ' FROM tokens)')} AS k3_kl FROM p""")
def mismatch(spark, path):
    return ALL6(D.mismatch_metrics(views.tokens(spark, path)))


@query("a12_kl_rewards", f"WITH {TOKENS} SELECT rollout_id, pos, {R('reward-0.1*(exp(ref_lp-old_lp)-(ref_lp-old_lp)-1)*mask')} AS shaped FROM tokens")
def kl_rewards(spark, path):
    rows = D.kl_shaped_rewards(views.tokens(spark, path), 0.1, "k3")
    return rows.select("rollout_id", "pos", r6("shaped").alias("shaped"))


KINDS = {"k1": "old_lp-ref_lp", "abs": "abs(old_lp-ref_lp)", "k2": "0.5*pow(old_lp-ref_lp,2)", "k3": "exp(ref_lp-old_lp)-(ref_lp-old_lp)-1"}


@query("a12_mean_kl", f"WITH {TOKENS}, p AS (SELECT " + ", ".join(f"{MM(v)} AS {k}" for k, v in KINDS.items()) + " FROM tokens GROUP BY rollout_id) SELECT " + ", ".join(f"{R(f'avg({k})')} AS {k}" for k in KINDS) + " FROM p")
def mean_kl(spark, path):
    t = views.tokens(spark, path)
    per = t.groupBy("rollout_id").agg(*[D.masked_mean(D.kl(F.col("old_lp"), F.col("ref_lp"), k), F.col("mask")).alias(k) for k in KINDS])
    return per.agg(*[r6(F.avg(k)).alias(k) for k in KINDS])


@query("a13_loss_aggregation", f"""WITH {TOKENS}, p AS (SELECT sum(value*old_lp*mask) AS s, sum(mask) AS n FROM tokens GROUP BY rollout_id)
  SELECT {R('sum(s)/(sum(n)+1e-8)')} AS token_mean, {R('avg(s)')} AS seq_mean_token_sum, {R('avg(s/nullif(n,0))')} AS seq_mean_token_mean, {R('sum(s)/8192')} AS seq_mean_token_sum_norm FROM p""")
def loss_aggregation(spark, path):
    return ALL6(D.aggregate_loss(views.tokens(spark, path), F.col("value") * F.col("old_lp"), 8192.0))


@query("a14_clip_report", f"""WITH {VALUED}, r AS (SELECT mask, advantage AS a, exp(old_lp-rollout_lp) AS r, rollout_lp-old_lp AS kl FROM valued), l AS (SELECT *, -a*r AS l1, -a*least(greatest(r,0.95),1.05) AS l2, -a*3.0 AS l3 FROM r)
  SELECT {R(MM('CASE WHEN a<0 THEN least(greatest(l1,l2),l3) ELSE greatest(l1,l2) END'))} AS loss, {R(MM('(l2>l1)::INT'))} AS clipped, {R(MM('(greatest(l1,l2)>l3 AND a<0)::INT'))} AS lower, {R(MM('kl'))} AS kl FROM l""")
def clip_report(spark, path):
    return ALL6(DIAGNOSTICS.pick("clip")(valued_tokens(spark, path), 0.05, 0.05))


@query("a15_masked_whiten", f"""WITH {TOKENS}, t AS (SELECT rollout_id, pos, mask, value AS x FROM tokens), m AS (SELECT sum(mask)::DOUBLE AS n, {MM('x')} AS mu FROM t),
  v AS (SELECT any_value(mu) AS mu, sum(mask*pow(x-mu,2))/(any_value(n)+1e-8)*any_value(n)/(any_value(n)-1) AS var FROM t, m) SELECT rollout_id, pos, {R('(x-mu)/sqrt(var+1e-8)')} AS white, {R('(x-mu)/sqrt(var+1e-8)+mu')} AS kept_mean FROM t, v""")
def whitened(spark, path):
    t = A.whiten(views.tokens(spark, path), "value", F.col("mask"), "white")
    t = A.whiten(t, "value", F.col("mask"), "kept_mean", shift_mean=False)
    return t.select("rollout_id", "pos", r6("white").alias("white"), r6("kept_mean").alias("kept_mean"))


@query("a32_logprob_parity", f"""WITH {TOKENS} SELECT rollout_id AS record, {R('max(abs(old_lp-rollout_lp))')} AS max_diff, {R('avg(abs(old_lp-rollout_lp))')} AS mean_diff, max(abs(old_lp-rollout_lp))<=0.1 AS ok FROM tokens GROUP BY 1""")
def parity(spark, path):
    e = F.struct("pos", "old_lp", "rollout_lp")
    arr = views.tokens(spark, path).groupBy(F.col("rollout_id").alias("record")).agg(F.sort_array(F.collect_list(e)).alias("x"))
    rec = arr.select("record", F.transform("x", lambda v: v["old_lp"]).alias("a"), F.transform("x", lambda v: v["rollout_lp"]).alias("b"))
    return D.logprob_parity(rec, 0.1).withColumns({c: r6(c) for c in ("max_diff", "mean_diff")})


@query("a37_episode_metrics", f"""WITH {VALUED}, e AS (SELECT rollout_id, count(*) AS len, sum(old_lp) AS slp, sum(advantage) AS sa, sum(old_lp-ref_lp) AS kl, sum(exp(ref_lp-old_lp)-1-(ref_lp-old_lp)) AS cv,
    sum(value) FILTER (pos>=1)-CASE WHEN count(*)>1 THEN max_by(value,pos) ELSE 0 END AS sv, greatest(count(*)-2,0) AS nv FROM valued GROUP BY 1),
  j AS (SELECT e.*, CASE WHEN o_orderstatus<>'P' THEN ln(o_totalprice) END AS score FROM e JOIN orders ON o_orderkey=rollout_id)
  SELECT {R('avg(score)')} AS score_mean, {R('avg(len)')} AS length_mean, {R('sum(sa)/sum(len)')} AS advantage_mean, {R('avg(slp)')} AS logprob_mean, {R('avg(slp/len)')} AS logprob_per_token, {R('avg(kl)')} AS kl, {R('avg(cv)')} AS control_variate_kl, {R('sum(sv)/sum(nv)')} AS value_mean FROM j""")
def episode_metrics(spark, path):
    e = F.struct("pos", "old_lp", "ref_lp", "advantage", "value")
    ep = valued_tokens(spark, path).groupBy("rollout_id").agg(F.sort_array(F.collect_list(e)).alias("x"))
    o = views.table(spark, path, "orders").select(F.col("o_orderkey").alias("rollout_id"), (F.col("o_orderstatus") != "P").alias("leaf"), F.log("o_totalprice").alias("score"))
    pick = lambda f: F.transform("x", lambda v: v[f])
    rows = ep.join(o, "rollout_id").select(
        "leaf", "score", F.lit(1).alias("n_query"), pick("old_lp").alias("lp"), pick("ref_lp").alias("ref_lp"), pick("advantage").alias("advantage"), pick("value").alias("values")
    )
    return ALL6(D.episode_metrics(rows))


@query("a38_control_variate_kl", f"""WITH {TOKENS}, p AS (SELECT sum((ref_lp-old_lp)*mask) AS d FROM tokens GROUP BY rollout_id), c AS (SELECT least(greatest(d,-10.0),10.0) AS x FROM p) SELECT {R('avg(exp(x)-1-x)')} AS kl FROM c""")
def control_variate(spark, path):
    return ALL6(D.sequence_control_variate(views.tokens(spark, path)))


@query("w26_sequence_ratio", f"""WITH {VALUED}, p AS (SELECT rollout_id, exp(sum((old_lp-rollout_lp)*mask)/sum(mask)) AS r FROM valued GROUP BY rollout_id HAVING sum(mask)>0),
  t AS (SELECT v.*, r, -advantage*r AS l1, -advantage*least(greatest(r,1-0.0003),1+0.0004) AS l2 FROM valued v JOIN p USING (rollout_id)),
  s AS (SELECT sum(greatest(l1,l2)*mask)/sum(mask) AS l, any_value(r) AS r FROM t GROUP BY rollout_id)
  SELECT (SELECT {R('avg(l)')} FROM s) AS loss, {R('sum((l2>l1)::INT*mask)/sum(mask)')} AS clipped, {R('-sum((old_lp-rollout_lp)*mask)/sum(mask)')} AS kl, (SELECT {R('avg(r)')} FROM s) AS ratio FROM t""")
def sequence_ratio(spark, path):
    return ALL6(DIAGNOSTICS.pick("sequence_ratio")(valued_tokens(spark, path)))


@query("w26_geometric_ratio", f"""WITH {VALUED}, x AS (SELECT *, old_lp-rollout_lp AS x, least(greatest(old_lp-rollout_lp,-0.02),0.02) AS c FROM valued),
  p AS (SELECT exp(sum(sign(advantage)*least(sign(advantage)*x,sign(advantage)*c)*mask)/(sum(mask)+1e-8)) AS r, {MM('advantage')} AS a, sum((x<>c AND advantage>0)::INT*mask) AS up, sum((x<>c AND advantage<0)::INT*mask) AS down, sum(mask) AS n FROM x GROUP BY rollout_id)
  SELECT {R('avg(-a*r)')} AS loss, {R('sum(up)/(sum(n)+1e-8)')} AS clipped, {R('sum(down)/(sum(n)+1e-8)')} AS clipped_lower, {R('avg(r)')} AS ratio FROM p""")
def geometric_ratio(spark, path):
    return ALL6(DIAGNOSTICS.pick("geometric_ratio")(valued_tokens(spark, path), 0.02, 0.02))


@query("w24_clip_covariance", f"""WITH {VALUED}, m AS (SELECT {MM('advantage')} AS ma, {MM('old_lp')} AS ml, greatest(floor(0.01*sum(mask)),1) AS n FROM valued),
  c AS (SELECT rollout_id, pos, (advantage-ma)*(old_lp-ml) AS cov, n, -advantage*least(greatest(exp(old_lp-rollout_lp),0.8),1.2)>-advantage*exp(old_lp-rollout_lp) AS o FROM valued, m WHERE mask=1),
  r AS (SELECT *, row_number() OVER (ORDER BY md5('6|'||rollout_id||'|'||pos)) AS r FROM c WHERE NOT o AND cov>0.01 AND cov<0.05) SELECT rollout_id, pos, {R('cov')} AS cov FROM r WHERE r<=n""")
def clip_covariance(spark, path):
    out = D.clip_covariance(valued_tokens(spark, path), 0.01, 0.01, 0.05, seed=6)
    return out.select("rollout_id", "pos", r6("cov").alias("cov"))


@query("w25_kl_covariance", f"""WITH {VALUED}, m AS (SELECT avg(advantage) AS ma, avg(old_lp) AS ml, greatest(floor(0.002*count(*)),1) AS n FROM valued WHERE mask=1),
  r AS (SELECT rollout_id, pos, n, row_number() OVER (ORDER BY round(-(advantage-ma)*(old_lp-ml),9), rollout_id, pos) AS r FROM valued, m WHERE mask=1) SELECT rollout_id, pos FROM r WHERE r<=n""")
def kl_covariance(spark, path):
    return D.kl_covariance(valued_tokens(spark, path), 0.002).select("rollout_id", "pos")


@query("w29_value_report", f"""WITH {VALUED}, v AS (SELECT mask, ret, value, sqrt(value)*1.5 AS nv FROM valued), e AS (SELECT mask, pow(nv-ret,2) AS e1, pow(least(greatest(nv,value-0.5),value+0.5)-ret,2) AS e2 FROM v)
  SELECT {R('0.5*' + MM('greatest(e1,e2)'))} AS loss, {R(MM('(e2>e1)::INT'))} AS clipped, {R(MM('e1'))} AS unclipped_error, {R(MM('e2'))} AS clipped_error FROM e""")
def value_report(spark, path):
    t = valued_tokens(spark, path).withColumn("new_value", F.sqrt("value") * 1.5)
    return ALL6(DIAGNOSTICS.pick("value")(t))


@query("f09_probability_mask", f"WITH {TOKENS} SELECT rollout_id, count(*) FILTER (old_lp<ln(0.9)) AS active, count(*) FILTER (old_lp<ln(0.9) AND mask=1 AND rollout_id%10<>0) AS effective FROM tokens GROUP BY 1")
def probability_mask(spark, path):
    on = D.prob_mask(F.col("old_lp"))
    dummy = F.col("rollout_id") % 10 == 0
    return views.tokens(spark, path).groupBy("rollout_id").agg(
        F.count_if(on).alias("active"), F.count_if(on & (F.col("mask") == 1) & ~dummy).alias("effective")
    )


@query("f11_veto", f"WITH {TOKENS} SELECT rollout_id, bool_or(old_lp-rollout_lp<ln(0.91) AND mask=1) AS vetoed FROM tokens GROUP BY 1")
def veto(spark, path):
    w = D.importance_weights(views.tokens(spark, path), "token", "truncate", upper=1e9, veto=0.91)
    return w.groupBy("rollout_id").agg(
        F.max((F.col("old_lp") - F.col("rollout_lp") < F.log(F.lit(0.91))) & (F.col("mask") == 1)).alias("vetoed")
    )


@query("j07_kl_with_reference", f"WITH {TOKENS}, p AS (SELECT rollout_id, sum(old_lp-ref_lp) AS kl FROM tokens GROUP BY 1) SELECT {R('avg(kl)')} AS mean_kl, count(*) AS sequences FROM p")
def kl_with_reference(spark, path):
    t = views.tokens(spark, path)
    actor, ref = t.select("rollout_id", "pos", "old_lp"), t.select("rollout_id", "pos", "ref_lp")
    per = actor.join(ref, ["rollout_id", "pos"]).groupBy("rollout_id").agg(F.sum(F.col("old_lp") - F.col("ref_lp")).alias("kl"))
    return per.agg(r6(F.avg("kl")).alias("mean_kl"), F.count(F.lit(1)).alias("sequences"))


@query("j08_value_prediction_error", f"WITH {TOKENS}, s AS (SELECT rollout_id, avg(value) AS v FROM tokens GROUP BY 1) SELECT o_orderpriority AS grp, {R('avg(pow(v-ln(o_totalprice)/12,2))')} AS squared_error, count(*) AS states FROM s JOIN orders ON o_orderkey=rollout_id GROUP BY 1")
def value_error(spark, path):
    mc = views.tokens(spark, path).groupBy("rollout_id").agg(F.avg("value").alias("v"))
    rows = views.rollouts(spark, path).join(mc, "rollout_id")
    return rows.groupBy(F.col("pred").alias("grp")).agg(r6(F.avg(F.pow(F.col("v") - F.col("score") / 12, F.lit(2.0)))).alias("squared_error"), F.count(F.lit(1)).alias("states"))


@query("w12_rank_by_logprob", f"WITH {TOKENS} SELECT rollout_id, {R('sum(old_lp)')} AS total, rank() OVER (PARTITION BY rollout_id%1000 ORDER BY round(sum(old_lp),9) DESC) AS rank FROM tokens GROUP BY rollout_id")
def rank_by_logprob(spark, path):
    from ..operators.spread import value_counts

    t = views.tokens(spark, path).groupBy("rollout_id").agg(F.sum("old_lp").alias("raw"))
    t = t.withColumn("total", F.round("raw", 9))
    t = t.withColumn("group", F.pmod("rollout_id", F.lit(1000)))
    # rank = 1 + rows with a larger total, from counts per distinct total
    above = value_counts(t, ["group"], -F.col("total")).select("group", (-F.col("v")).alias("total"), (F.col("hi") - F.col("c") + 1).alias("rank"))
    return t.join(above, ["group", "total"]).select("rollout_id", r6("raw").alias("total"), "rank")
