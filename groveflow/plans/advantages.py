"""Advantage queries (V rows of the survey, J17, J18, J19)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import best_of_k, r6, sample_key
from ..operators import advantages as A
from ..operators.registry import ESTIMATORS
from ..sources import views
from .registry import R, ROLLOUTS, TOKENS, U, query

GROUP = f"""WITH {ROLLOUTS}, g AS (SELECT *, count(*) OVER p AS n, avg(score) OVER p AS mean, stddev_samp(score) OVER p AS std,
  stddev_pop(score) OVER p AS stdp, sum(score) OVER p AS total, sum(n_tokens*score) OVER p / sum(n_tokens) OVER p AS lbase
  FROM rollouts WINDOW p AS (PARTITION BY uid))"""


def _group(name, estimator, expr, **params):
    sql = f"{GROUP} SELECT rollout_id, {R(expr)} AS advantage FROM g"

    @query(name, sql)
    def run(spark, path):
        rows = ESTIMATORS.pick(estimator)(views.rollouts(spark, path), **params)
        return rows.select("rollout_id", r6("advantage").alias("advantage"))


_group("v01_grpo", "grpo", "CASE WHEN n>1 THEN (score-mean)/(std+1e-6) ELSE score/(1+1e-6) END")
_group("v01_grpo_centred", "grpo", "CASE WHEN n>1 THEN score-mean ELSE score END", norm=False)
_group("v02_grpo_floored", "grpo_floored",
       "CASE WHEN n>1 THEN (score-mean)/(sqrt(greatest(std*std,1e-6))+1e-6) ELSE score/(1+1e-6) END")
_group("v03_grpo_population", "grpo_population", "(score-mean)/(stdp+1e-8)")
_group("v05_rloo", "rloo", "CASE WHEN n>1 THEN n/(n-1)*(score-mean) ELSE score END")
_group("v06_rloo_sum", "rloo_sum", "CASE WHEN n>1 THEN (n*score-total)/(n-1) ELSE 0.0 END")
_group("v07_rloo_others", "rloo_others", "CASE WHEN n>1 THEN score-(total-score)/(n-1) ELSE score END")
_group("v11_opo", "opo", "score - CASE WHEN n>1 THEN lbase ELSE 0.0 END")
_group("v12_gpg", "gpg",
       "(SELECT count(*)/greatest(count(*) FILTER (score<>0),1) FROM rollouts)*(score-CASE WHEN n>1 THEN mean ELSE 0.0 END)")


@query("v04_pass_at_k", f"""{GROUP}, o AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, rollout_id) AS rn,
    lead(score) OVER (PARTITION BY uid ORDER BY score DESC, rollout_id) AS second FROM g)
  SELECT rollout_id, CASE WHEN n>1 THEN CASE WHEN rn=1 THEN {R('(score-second)/(std+1e-6)')} ELSE 0.0 END END AS advantage FROM o""")
def pass_at_k(spark, path):
    return A.pass_at_k(views.rollouts(spark, path)).select("rollout_id", r6("advantage").alias("advantage"))


@query("v08_reinforce_baseline", f"""{GROUP}, c AS (SELECT rollout_id, n_tokens, score-CASE WHEN n>1 THEN mean ELSE 0.0 END AS a FROM g),
  m AS (SELECT sum(n_tokens)::DOUBLE AS n, sum(n_tokens*a)/(sum(n_tokens)+1e-8) AS mu FROM c),
  v AS (SELECT any_value(mu) AS mu, sum(c.n_tokens*(a-mu)*(a-mu))/(any_value(n)+1e-8)*any_value(n)/(any_value(n)-1) AS var FROM c, m)
  SELECT rollout_id, {R('(a-mu)/sqrt(var+1e-8)')} AS advantage FROM c, v""")
def reinforce_baseline(spark, path):
    return A.reinforce_baseline(views.rollouts(spark, path)).select("rollout_id", r6("advantage").alias("advantage"))


WHITE = """m AS (SELECT sum(mask)::DOUBLE AS n, sum(x*mask)/(sum(mask)+1e-8) AS mu FROM t),
  v AS (SELECT any_value(mu) AS mu, sum(mask*(x-mu)*(x-mu))/(any_value(n)+1e-8)*any_value(n)/(any_value(n)-1) AS var FROM t, m)"""


@query("v09_reinforce", f"""WITH {TOKENS}, s AS (SELECT *, sum(1-mask) OVER (PARTITION BY rollout_id ORDER BY pos) AS seg FROM tokens),
  t AS (SELECT *, sum(reward*pow(0.99,pos)) OVER (PARTITION BY rollout_id, seg ORDER BY pos DESC)/pow(0.99,pos) AS x FROM s), {WHITE}
  SELECT rollout_id, pos, {R('x')} AS ret, {R('(x-mu)/sqrt(var+1e-8)*mask')} AS advantage FROM t, v""")
def reinforce(spark, path):
    rows = A.reinforce(views.tokens(spark, path), gamma=0.99)
    return rows.select("rollout_id", "pos", r6("ret").alias("ret"), r6("advantage").alias("advantage"))


@query("v10_remax", f"""WITH {ROLLOUTS}, {TOKENS}, b AS (SELECT uid, max(score) AS baseline FROM rollouts GROUP BY uid)
  SELECT t.rollout_id, pos, {R('(sum(reward*mask) OVER (PARTITION BY t.rollout_id ORDER BY pos DESC)-baseline)*mask')} AS advantage
  FROM tokens t JOIN rollouts USING (rollout_id) JOIN b USING (uid)""")
def remax(spark, path):
    from ..operators.spread import attach_stats

    rollouts = views.rollouts(spark, path)
    base = attach_stats(rollouts, ["uid"], {"baseline": F.max("score")}, ["rollout_id"]).select("rollout_id", "baseline")
    rows = A.remax(views.tokens(spark, path), base)
    return rows.select("rollout_id", "pos", r6("advantage").alias("advantage"))


@query("v13_gae", f"""WITH {TOKENS}, k AS (SELECT *, row_number() OVER w - 1 AS i, reward+coalesce(lead(value) OVER w,0.0)-value AS delta
    FROM tokens WHERE mask=1 WINDOW w AS (PARTITION BY rollout_id ORDER BY pos)),
  t AS (SELECT *, sum(delta*pow(0.95,i)) OVER (PARTITION BY rollout_id ORDER BY i DESC)/pow(0.95,i) AS x FROM k), {WHITE}
  SELECT rollout_id, pos, {R('x+value')} AS ret, {R('(x-mu)/sqrt(var+1e-8)')} AS advantage FROM t, v""")
def gae(spark, path):
    rows = A.gae(views.tokens(spark, path))
    return rows.select("rollout_id", "pos", r6("ret").alias("ret"), r6("advantage").alias("advantage"))


@query("v14_mixed_rloo", f"""WITH {ROLLOUTS}, {TOKENS}, d AS (SELECT t.*, old_lp-ref_lp AS dense, uid, correct,
    lead(pos) OVER (PARTITION BY rollout_id ORDER BY pos) IS NULL AS fin FROM tokens t JOIN rollouts USING (rollout_id)),
  one AS (SELECT uid, rollout_id, avg(dense) FILTER (mask=1) AS md, any_value(correct) AS o FROM d GROUP BY ALL),
  g AS (SELECT uid, count(*) AS n, sum(md) AS sd, sum(o) AS so FROM one GROUP BY uid HAVING count(*)>1),
  r AS (SELECT d.*, (5.0*CASE WHEN mask=1 THEN dense*n/(n-1)-sd/(n-1) ELSE 0 END
      + 5.0*CASE WHEN fin THEN correct*n/(n-1)-so/(n-1) ELSE 0 END)*mask AS rr FROM d JOIN g USING (uid)),
  t AS (SELECT *, sum(rr) OVER (PARTITION BY rollout_id ORDER BY pos DESC) AS x FROM r), {WHITE}
  SELECT rollout_id, pos, {R('x')} AS ret, {R('(x-mu)/sqrt(var+1e-8)')} AS advantage FROM t, v""")
def mixed_rloo(spark, path):
    tokens = views.tokens(spark, path).withColumn("dense", F.col("old_lp") - F.col("ref_lp"))
    rows = A.mixed_rloo(tokens, views.rollouts(spark, path), 5.0, 5.0)
    return rows.select("rollout_id", "pos", r6("ret").alias("ret"), r6("advantage").alias("advantage"))


@query("v15_soft_mean", f"""WITH {ROLLOUTS}, s AS (SELECT ln(sum(exp(0.5*score)))/0.5-ln(count(*))/0.5 AS b FROM rollouts)
  SELECT rollout_id, {R('score-b')} AS advantage FROM rollouts, s""")
def soft_mean(spark, path):
    rows = A.soft_mean_baseline(views.rollouts(spark, path), beta=0.5)
    return rows.select("rollout_id", r6("advantage").alias("advantage"))


STEPS = f"""{TOKENS}, steps AS (SELECT rollout_id, pos AS step, reward, CASE WHEN mask=1 THEN value END AS value FROM tokens)"""


@query("v16_step_advantage", f"""WITH {STEPS}, s AS (SELECT *, sum(reward) OVER b AS rest, max(CASE WHEN value IS NOT NULL THEN step END) OVER b AS known
    FROM steps WINDOW b AS (PARTITION BY rollout_id ORDER BY step DESC)),
  f AS (SELECT *, CASE WHEN value IS NULL AND known IS NULL THEN rest ELSE value END AS filled FROM s),
  n AS (SELECT *, lead(step) OVER w AS ns, lead(filled) OVER w AS nv FROM f WINDOW w AS (PARTITION BY rollout_id ORDER BY step))
  SELECT rollout_id, step, {R('reward+CASE WHEN ns IS NULL THEN 0.0 ELSE nv END-filled')} AS advantage FROM n""")
def step_advantage(spark, path):
    t = views.tokens(spark, path)
    steps = t.select("rollout_id", F.col("pos").alias("step"), "reward", F.when(F.col("mask") == 1, F.col("value")).alias("value"))
    return A.step_advantages(steps).select("rollout_id", "step", r6("advantage").alias("advantage"))


@query("v17_monte_carlo_value", f"""WITH {ROLLOUTS}, r AS (SELECT uid, CASE WHEN n_tokens>400 THEN -1.0 ELSE score END AS reward FROM rollouts)
  SELECT uid, {R('avg(reward)')} AS value, {R('stddev_pop(reward)')} AS value_std, count(reward) AS n_rollouts FROM r GROUP BY uid""")
def monte_carlo(spark, path):
    reward = F.when(F.col("n_tokens") > 400, -1.0).otherwise(F.col("score"))
    out = A.monte_carlo_values(views.rollouts(spark, path), ["uid"], reward)
    return out.select("uid", r6("value").alias("value"), r6("value_std").alias("value_std"), "n_rollouts")


@query("v18_steps_to_tokens", """WITH turns AS (SELECT conv_id AS rollout_id, turn AS step, length(text)+1 AS n,
    sum(length(text)+1) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS step_end, text, role FROM conversations),
  words AS (SELECT rollout_id, step, unnest(string_split(text,' ')) AS word, generate_subscripts(string_split(text,' '),1) AS i, step_end-n AS base FROM turns),
  tok AS (SELECT rollout_id, (base+sum(length(word)+1) OVER (PARTITION BY rollout_id, step ORDER BY i)-length(word)-1)::BIGINT AS char_start FROM words)
  SELECT t.rollout_id, char_start, step, role FROM tok t JOIN turns s ON t.rollout_id=s.rollout_id AND char_start>=step_end-n AND char_start<step_end""")
def steps_to_tokens(spark, path):
    conv = views.messages(spark, path)
    n = F.length("text") + 1
    seq = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    turns = conv.select(
        F.col("conv_id").alias("rollout_id"), F.col("turn").alias("step"), "role", "text",
        F.sum(n).over(seq).alias("step_end"), (F.sum(n).over(seq) - n).alias("step_start"),
    )
    words = turns.select("rollout_id", "step", "step_start", F.posexplode(F.split("text", " ", -1)).alias("i", "word"))
    here = Window.partitionBy("rollout_id", "step").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("word") + 1
    tok = words.select("rollout_id", (F.col("step_start") + F.sum(size).over(here) - size).alias("char_start"))
    steps = turns.select("rollout_id", "step", "step_start", "step_end", "role")
    return A.spread_steps_to_tokens(steps, tok).select("rollout_id", "char_start", "step", "role")


CUTS = f"""{TOKENS}, u AS (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY pos) - 1 AS i FROM tokens WHERE exp(old_lp)<0.9),
  cuts AS (SELECT rollout_id, pos-1 AS cut FROM u WHERE i%2=0)"""


@query("v19_cut_points", f"WITH {CUTS} SELECT * FROM cuts")
def cut_points(spark, path):
    return A.cut_points(views.tokens(spark, path), every=2)


@query("v20_segment_advantage", f"""WITH {ROLLOUTS}, {CUTS}, c AS (SELECT rollout_id, cut, coalesce(value,0.5) AS cut_value FROM cuts LEFT JOIN tokens t USING (rollout_id)
    WHERE t.pos=cut OR (cut=-1 AND t.pos=0)),
  b AS (SELECT rollout_id, max(cut_value) FILTER (cut=-1) AS base, true AS has_cut FROM c GROUP BY 1),
  k AS (SELECT t.*, base, has_cut, coalesce(cut_value, CASE WHEN lead(t.pos) OVER w IS NULL THEN correct END) AS known
    FROM tokens t LEFT JOIN c ON c.rollout_id=t.rollout_id AND c.cut=t.pos LEFT JOIN b ON b.rollout_id=t.rollout_id JOIN rollouts r ON r.rollout_id=t.rollout_id
    WINDOW w AS (PARTITION BY t.rollout_id ORDER BY t.pos)),
  a AS (SELECT *, CASE WHEN known IS NOT NULL THEN coalesce(known-coalesce(last_value(known IGNORE NULLS)
      OVER (PARTITION BY rollout_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), base),0.0) END AS step FROM k)
  SELECT rollout_id, pos, {R("CASE WHEN has_cut IS NULL OR exp(old_lp)>0.9 THEN 0.0 ELSE last_value(step IGNORE NULLS) OVER (PARTITION BY rollout_id ORDER BY pos DESC) END")} AS advantage FROM a""")
def segment_advantage(spark, path):
    tokens = views.tokens(spark, path)
    cuts = A.cut_points(tokens, every=2).withColumn("pos", F.greatest(F.col("cut"), F.lit(0)))
    cuts = cuts.join(tokens.select("rollout_id", "pos", "value"), ["rollout_id", "pos"]).select(
        "rollout_id", "cut", F.col("value").alias("cut_value")
    )
    scores = views.rollouts(spark, path).select("rollout_id", F.col("correct").cast("double").alias("score"))
    rows = A.segment_advantages(tokens, cuts, scores)
    return rows.select("rollout_id", "pos", r6("advantage").alias("advantage"))


@query("v25_resample", f"""WITH {ROLLOUTS}, w AS (SELECT rollout_id, greatest(round((pow(abs(score),2.0)+1e-8)*1e9)::BIGINT,1) AS w FROM rollouts),
  c AS (SELECT rollout_id, sum(w) OVER (ORDER BY rollout_id)-w AS lo, sum(w) OVER () AS total FROM w),
  d AS (SELECT rollout_id AS draw, floor({U("md5('3|'||rollout_id)")}*(SELECT max(total) FROM c))::HUGEINT AS u FROM rollouts)
  SELECT draw, c.rollout_id FROM d ASOF JOIN c ON d.u>=c.lo""")
def resample(spark, path):
    return A.resample_by_score(views.rollouts(spark, path), seed=3)


@query("v26_scaled_scores", f"""WITH {ROLLOUTS}, m AS (SELECT avg(score) AS mu, stddev_samp(score) AS sd FROM rollouts)
  SELECT rollout_id, {R('least(greatest((score-mu)/(sd+2.220446049250313e-16),-2.0),2.0)')} AS advantage FROM rollouts, m""")
def scaled(spark, path):
    rows = A.scale_scores(views.rollouts(spark, path), bound=2.0)
    return rows.select("rollout_id", r6("advantage").alias("advantage"))


@query("v27_gae_plain", f"""WITH {TOKENS}, r AS (SELECT *, (reward-0.05*(old_lp-ref_lp))*mask AS r FROM tokens),
  d AS (SELECT *, r+0.99*coalesce(lead(value) OVER (PARTITION BY rollout_id ORDER BY pos),0.0)-value AS delta FROM r),
  t AS (SELECT *, sum(delta*pow(0.99*0.95,pos)) OVER b/pow(0.99*0.95,pos) AS x, sum(r*pow(0.99,pos)) OVER b/pow(0.99,pos) AS ret
    FROM d WINDOW b AS (PARTITION BY rollout_id ORDER BY pos DESC)), {WHITE}
  SELECT rollout_id, pos, {R('ret')} AS ret, {R('(x-mu)/sqrt(var+1e-8)')} AS advantage FROM t, v""")
def gae_plain(spark, path):
    rows = A.gae_plain(views.tokens(spark, path), gamma=0.99, lam=0.95, beta=0.05)
    return rows.select("rollout_id", "pos", r6("ret").alias("ret"), r6("advantage").alias("advantage"))


@query("v23_prover_advantage", f"""WITH {ROLLOUTS}, p AS (SELECT uid, avg(correct) AS v FROM rollouts GROUP BY uid)
  SELECT rollout_id, {R('(1-pow(1-correct,4))-(1-pow(1-v,4))')} AS prover_advantage FROM rollouts JOIN p USING (uid)""")
def prover(spark, path):
    from ..operators.spread import attach_stats

    rows = attach_stats(views.rollouts(spark, path), ["uid"], {"v": F.avg("correct")}, ["rollout_id"])
    gain = best_of_k(F.col("correct").cast("double")) - best_of_k(F.col("v"))
    return rows.select("rollout_id", r6(gain).alias("prover_advantage"))
