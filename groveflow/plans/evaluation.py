"""Evaluation and pair queries (A1-A8, A16, A17, A31, A33, A34; J2, J15, J18-J21; W30)."""

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import advantages as A
from ..operators import evaluation as E
from ..operators import pairs as P
from ..operators.spread import attach_stats
from ..sources import views
from .registry import R, ROLLOUTS, SOURCED, TOKENS, U, query


def answers(spark, path):
    """Rollouts with a parsed answer (one priority is unparsable) graded against the prompt's gold answer."""
    digit = F.substring("pred", 1, 1).cast("int")
    return views.rollouts_by_source(spark, path).withColumn(
        "answer", F.when(F.col("pred") != "5-LOW", F.col("pred"))
    ).withColumn("correct", ((digit == F.pmod("uid", F.lit(5)) + 1) & (digit < 5)).cast("int"))


ANSWERS = SOURCED + """, ans AS (SELECT * EXCLUDE (correct), CASE WHEN pred<>'5-LOW' THEN pred END AS answer,
  (substr(pred,1,1)::INT=uid%5+1 AND pred<>'5-LOW')::INT AS correct FROM sourced)"""
VOTES = ANSWERS + """, votes AS (SELECT uid, answer, count(*) AS n, sum(correct) AS nc, min((arrival,rollout_id)) AS seen,
    arg_min(correct,(arrival,rollout_id)) AS grade FROM ans GROUP BY ALL),
  top AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, seen) AS rn FROM votes),
  q AS (SELECT uid, (sum(nc)>0)::INT AS any_correct, sum(nc)/sum(n) AS share_correct, max(grade) FILTER (rn=1) AS majority_correct,
    count(*) AS distinct_answers, coalesce(sum(n) FILTER (answer IS NULL),0)/sum(n) AS unparsed_share FROM top GROUP BY uid)"""


@query("a01_question_scores", f"""WITH {VOTES} SELECT uid, any_correct, {R('share_correct')} AS share_correct, majority_correct,
  distinct_answers, {R('unparsed_share')} AS unparsed_share FROM q""")
def question_scores(spark, path):
    q = E.question_scores(answers(spark, path))
    return q.withColumns({c: r6(c) for c in ("share_correct", "unparsed_share")})


@query("a01_pass_at_n_summary", f"""WITH {VOTES} SELECT {R('avg(any_correct)')} AS pass_at_n, {R('avg(share_correct)')} AS mean_correct,
  {R('avg(majority_correct)')} AS majority, {R('avg(distinct_answers)')} AS distinct_answers, {R('avg(unparsed_share)')} AS unparsed FROM q""")
def pass_summary(spark, path):
    q = E.question_scores(answers(spark, path))
    return q.agg(
        r6(F.avg("any_correct")).alias("pass_at_n"), r6(F.avg("share_correct")).alias("mean_correct"),
        r6(F.avg("majority_correct")).alias("majority"), r6(F.avg("distinct_answers")).alias("distinct_answers"),
        r6(F.avg("unparsed_share")).alias("unparsed"),
    )


@query("a02_mean_std_by_source", f"""WITH {SOURCED}, p AS (SELECT data_source, uid, avg(score) AS m, stddev_pop(score) AS s, count(*) AS n FROM sourced GROUP BY ALL)
  SELECT data_source, count(*) AS prompts, {R('avg(m)')} AS mean_at_n, {R('avg(s)')} AS std_at_n, {R('avg(n)')} AS n FROM p GROUP BY 1""")
def mean_std(spark, path):
    per = views.rollouts_by_source(spark, path).groupBy("data_source", "uid").agg(
        F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.count(F.lit(1)).alias("n")
    )
    return per.groupBy("data_source").agg(
        F.count(F.lit(1)).alias("prompts"), r6(F.avg("m")).alias("mean_at_n"), r6(F.avg("s")).alias("std_at_n"), r6(F.avg("n")).alias("n")
    )


@query("a03_best_worst_at_n", f"""WITH {SOURCED}, r AS (SELECT data_source, uid, score AS v, row_number() OVER (PARTITION BY uid ORDER BY score, rollout_id) AS i,
    count(*) OVER (PARTITION BY uid) AS c FROM sourced),
  e AS (SELECT *, unnest(list_distinct(list_append([x FOR x IN [2,4,8,16,32,64,128,256,512,1024] IF x<c], c))) AS n FROM r WHERE c>1),
  w AS (SELECT data_source, uid, n, sum(v*b) AS bm, sum(v*v*b) AS b2, sum(v*w) AS wm, sum(v*v*w) AS w2 FROM
    (SELECT *, pow(i/c,n)-pow((i-1)/c,n) AS b, pow((c-i+1)/c,n)-pow((c-i)/c,n) AS w FROM e) GROUP BY ALL)
  SELECT data_source, n, count(*) AS prompts, {R('avg(bm)')} AS best_mean, {R('avg(sqrt(greatest(b2-bm*bm,0.0)))')} AS best_std,
    {R('avg(wm)')} AS worst_mean, {R('avg(sqrt(greatest(w2-wm*wm,0.0)))')} AS worst_std FROM w GROUP BY 1,2""")
def best_worst(spark, path):
    per = E.best_worst(views.rollouts_by_source(spark, path), ["data_source", "uid"], "score")
    stats = ["best_mean", "best_std", "worst_mean", "worst_std"]
    return per.groupBy("data_source", "n").agg(F.count(F.lit(1)).alias("prompts"), *[r6(F.avg(c)).alias(c) for c in stats])


@query("a03_majority_draws", f"""WITH {ROLLOUTS}, r AS (SELECT uid, pred, score, row_number() OVER (PARTITION BY uid ORDER BY rollout_id) AS i, count(*) OVER (PARTITION BY uid) AS c FROM rollouts),
  p AS (SELECT uid, c, d AS draw, k FROM (SELECT DISTINCT uid, c FROM r WHERE c>=4), range(1,21) t(d), range(1,5) s(k)),
  h AS (SELECT p.uid, draw, k, pred, score FROM p JOIN r ON r.uid=p.uid AND r.i=floor({U("md5('42|'||p.uid||'|'||draw||'|'||k)")}*p.c)+1),
  v AS (SELECT uid, draw, pred, count(*) AS n, min(k) AS seen, arg_min(score,k) AS val FROM h GROUP BY ALL),
  m AS (SELECT uid, draw, val, row_number() OVER (PARTITION BY uid, draw ORDER BY n DESC, seen) AS rn FROM v)
  SELECT uid, {R('avg(val)')} AS maj_mean, {R('stddev_pop(val)')} AS maj_std FROM m WHERE rn=1 GROUP BY uid""")
def majority_draws(spark, path):
    out = E.majority_draws(views.rollouts(spark, path), ["uid"], "pred", "score", "rollout_id", n=4, draws=20)
    return out.select("uid", r6("maj_mean").alias("maj_mean"), r6("maj_std").alias("maj_std"))


@query("a04_majority_value", f"""WITH {ROLLOUTS}, v AS (SELECT uid, pred, count(*) AS n, min((arrival,rollout_id)) AS seen, arg_min(score,(arrival,rollout_id)) AS val FROM rollouts GROUP BY ALL),
  m AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, seen) AS rn FROM v)
  SELECT uid, {R('val')} AS majority_value FROM m WHERE rn=1""")
def majority_value(spark, path):
    df = views.rollouts(spark, path).withColumnRenamed("arrival", "t")
    out = E.vote_value(df, ["uid"], "pred", "score", ["t", "rollout_id"])
    return out.select("uid", r6("majority_value").alias("majority_value"))


@query("a05_source_test_score", f"""WITH {SOURCED}, p AS (SELECT data_source, uid, avg(score) AS m FROM sourced GROUP BY ALL)
  SELECT data_source, {R('avg(m)')} AS test_score FROM p GROUP BY 1""")
def source_test_score(spark, path):
    per = views.rollouts_by_source(spark, path).groupBy("data_source", "uid").agg(F.avg("score").alias("m"))
    return per.groupBy("data_source").agg(r6(F.avg("m")).alias("test_score"))


def valued_tokens(spark, path):
    """Tokens with return-to-go and a critic advantage."""
    t = A.discounted_returns(views.tokens(spark, path), 1.0)
    return t.withColumn("advantage", F.col("ret") / 10 - F.col("value"))


VALUED = TOKENS + """, seg AS (SELECT *, sum(1-mask) OVER (PARTITION BY rollout_id ORDER BY pos) AS s FROM tokens),
  valued AS (SELECT *, ret/10-value AS advantage FROM (SELECT * EXCLUDE (s), sum(reward) OVER (PARTITION BY rollout_id, s ORDER BY pos DESC) AS ret FROM seg))"""


@query("a06_batch_metrics", f"""WITH {ROLLOUTS}, {VALUED}, per AS (SELECT rollout_id, count(*) AS len, sum(reward) AS sr FROM valued GROUP BY 1),
  s AS (SELECT r.*, coalesce(len,0) AS len, sr FROM rollouts r LEFT JOIN per USING (rollout_id)),
  t AS (SELECT {R('avg(advantage)')} AS advantage_mean, {R('max(advantage)')} AS advantage_max, {R('min(advantage)')} AS advantage_min,
    {R('avg(ret)')} AS return_mean, {R('avg(value)')} AS value_mean, {R('1-var_samp(ret-value)/(var_samp(ret)+1e-5)')} AS explained_var FROM valued WHERE mask=1),
  a AS (SELECT {R('avg(score) FILTER (len>0)')} AS score_mean, {R('max(score) FILTER (len>0)')} AS score_max, {R('min(score) FILTER (len>0)')} AS score_min,
    {R('avg(sr) FILTER (len>0)')} AS reward_mean, {R('avg(len)')} AS length_mean, max(len) AS length_max, min(len) AS length_min,
    {R('avg((len=7)::INT)')} AS length_clip_ratio, {R('avg((len=0)::INT)')} AS aborted_ratio, {R('avg(n_tokens)')} AS prompt_length_mean FROM s)
  SELECT * FROM a, t""")
def batch_metrics(spark, path):
    out = E.batch_metrics(views.rollouts(spark, path), valued_tokens(spark, path), max_len=7)
    return out.select(*[F.col(c) if c in ("length_max", "length_min") else r6(c).alias(c) for c in out.columns])


@query("a07_timing_per_token", f"""WITH {ROLLOUTS}, tk AS (SELECT (rollout_id%30)::INT AS step, sum(n_tokens)::BIGINT AS n FROM rollouts GROUP BY 1),
  tm AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS step, event_type AS stage, sum(value) AS sec FROM events GROUP BY ALL),
  tot AS (SELECT step, sum(sec) AS total FROM tm GROUP BY 1)
  SELECT step, stage, {R('sec*1000/n')} AS ms_per_token, {R('n/(total*8)')} AS tokens_per_gpu_second FROM tm JOIN tk USING (step) JOIN tot USING (step)""")
def timing(spark, path):
    tk = views.rollouts(spark, path).groupBy(F.pmod("rollout_id", F.lit(30)).cast("int").alias("step")).agg(F.sum("n_tokens").alias("n"))
    ev = views.table(spark, path, "events").select(
        F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("step"), F.col("event_type").alias("stage"), "value"
    )
    tm = ev.groupBy("step", "stage").agg(F.sum("value").alias("sec"))
    tot = tm.groupBy("step").agg(F.sum("sec").alias("total"))
    return tm.join(tk, "step").join(tot, "step").select(
        "step", "stage", r6(F.col("sec") * 1000 / F.col("n")).alias("ms_per_token"),
        r6(F.col("n") / (F.col("total") * 8)).alias("tokens_per_gpu_second"),
    )


NAMED = """named AS (SELECT event_type||CASE user_id%3 WHEN 0 THEN '/value_max' WHEN 1 THEN '/value_min' ELSE '/value' END AS name, value FROM events)"""


@query("a08_reduce_metrics", f"""WITH {NAMED} SELECT name, {R("CASE WHEN contains(name,'max') THEN max(value) WHEN contains(name,'min') THEN min(value) ELSE avg(value) END")} AS value FROM named GROUP BY name""")
def reduce_metrics(spark, path):
    ev = views.table(spark, path, "events")
    kind = F.pmod("user_id", F.lit(3))
    tail = F.when(kind == 0, "/value_max").when(kind == 1, "/value_min").otherwise("/value")
    return E.reduce_metrics(ev.select(F.concat("event_type", tail).alias("name"), "value")).select("name", r6("value").alias("value"))


@query("a16_trajectory_counters", f"""WITH {ANSWERS}, p AS (SELECT uid, count(*) AS n, count(*) FILTER (answer IS NULL) AS pf, count(*) FILTER (n_tokens>400) AS tr, max(correct) AS hit, count(DISTINCT pred) AS u FROM ans GROUP BY uid)
  SELECT sum(pf)::BIGINT AS parse_failed, sum(tr)::BIGINT AS truncated, {R('avg(hit)')} AS once_hit, {R('avg(n)')} AS rollouts_per_state, {R('sum(tr)/sum(n)')} AS truncated_share, {R('avg(u/n)')} AS unique_share FROM p""")
def trajectory_counters(spark, path):
    df = answers(spark, path).withColumn("finish", F.when(F.col("n_tokens") > 400, "length").otherwise("stop")).withColumn("text", F.col("pred"))
    out = E.trajectory_counters(df)
    return out.select("parse_failed", "truncated", *[r6(c).alias(c) for c in out.columns[2:]])


def labelled(spark, path):
    docs = views.texts(spark, path).select("doc_id", F.concat_ws("/", "lang", "source").alias("question_id"), "n_chars")
    return docs.join(views.table(spark, path, "labels"), "doc_id")


LABELLED = "lab AS (SELECT doc_id, lang||'/'||source AS question_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"
SIDES = f"""{LABELLED}, side AS (SELECT question_id, doc_id AS item, quality=1 AS accept, row_number() OVER (PARTITION BY lang_q, quality ORDER BY md5('5|'||doc_id), doc_id) AS r FROM (SELECT *, question_id AS lang_q FROM lab)),
  n AS (SELECT question_id, count(*) FILTER (accept) AS a, count(*) FILTER (NOT accept) AS b, a*b AS al, least(8,a*b) AS m FROM side GROUP BY 1 HAVING a*b>0),
  t AS (SELECT question_id, b, ((('0x'||substr(md5('5|'||question_id),1,15))::BIGINT % al) + t * (al//m)) % al AS pick FROM n, range(0,8) s(t) WHERE t<m),
  pairs AS (SELECT t.question_id, x.item AS accept_item, y.item AS reject_item FROM t JOIN side x ON x.question_id=t.question_id AND x.accept AND x.r=pick//b+1
    JOIN side y ON y.question_id=t.question_id AND NOT y.accept AND y.r=pick%b+1)"""


def doc_pairs(spark, path):
    items = labelled(spark, path).select("question_id", F.col("doc_id").alias("item"), (F.col("quality") == 1).alias("accept"))
    return P.sample_pairs(items, k=8, seed=5)


@query("j02_preference_pairs", f"WITH {SIDES} SELECT * FROM pairs")
def preference_pairs(spark, path):
    return doc_pairs(spark, path)


@query("a17_preference_metrics", f"""WITH {SIDES}, l AS (SELECT p.*, ln(1+x.n_chars) AS cs, ln(1+y.n_chars) AS rs, x.n_chars AS cl, y.n_chars AS rl FROM pairs p
    JOIN documents x ON x.doc_id=accept_item JOIN documents y ON y.doc_id=reject_item)
  SELECT count(*) AS pairs, {R('avg(cs)')} AS chosen_score, {R('avg(rs)')} AS rejected_score, {R('avg(cl)')} AS chosen_length, {R('avg(rl)')} AS rejected_length, {R('avg((cs>rs)::INT)')} AS margin_positive FROM l""")
def preference_metrics(spark, path):
    docs = views.texts(spark, path)
    side = lambda p: docs.select(F.col("doc_id").alias(f"{p}_item"), F.col("n_chars").alias(f"{p}_len"), F.log(1 + F.col("n_chars")).alias(f"{p}_s"))
    d = doc_pairs(spark, path).join(side("accept"), "accept_item").join(side("reject"), "reject_item")
    return d.agg(
        F.count(F.lit(1)).alias("pairs"), r6(F.avg("accept_s")).alias("chosen_score"), r6(F.avg("reject_s")).alias("rejected_score"),
        r6(F.avg("accept_len")).alias("chosen_length"), r6(F.avg("reject_len")).alias("rejected_length"),
        r6(F.avg((F.col("accept_s") > F.col("reject_s")).cast("int"))).alias("margin_positive"),
    )


@query("j18_detached_target", f"""WITH {ROLLOUTS}, g AS (SELECT *, avg(score) FILTER (correct=0) OVER p AS m0, avg(score) FILTER (correct=1) OVER p AS m1 FROM rollouts WINDOW p AS (PARTITION BY uid)),
  t AS (SELECT rollout_id, score, correct, coalesce(CASE WHEN correct=1 THEN m0 ELSE m1 END,0.0) AS target FROM g)
  SELECT rollout_id, {R('target')} AS target, {R('-ln(1/(1+exp(-(score-target)*(correct*2-1))))')} AS loss FROM t""")
def detached(spark, path):
    return P.detached_loss(views.rollouts(spark, path)).select("rollout_id", r6("target").alias("target"), r6("loss").alias("loss"))


@query("j18_best_of_n_weight", f"""WITH {ROLLOUTS}, c AS (SELECT rollout_id, count(*) OVER p AS n, count(*) OVER (PARTITION BY uid ORDER BY score) AS le FROM rollouts WINDOW p AS (PARTITION BY uid))
  SELECT rollout_id, {R('n*pow(le/n,n-1)')} AS weight FROM c""")
def bon_weight(spark, path):
    return P.best_of_n_weight(views.rollouts(spark, path)).select("rollout_id", r6("weight").alias("weight"))


@query("j19_ranking_accuracy", f"""WITH {ROLLOUTS}, p AS (SELECT c.uid, avg((w.score<c.score OR (w.score=c.score AND w.rollout_id<c.rollout_id))::INT) AS acc
    FROM rollouts c JOIN rollouts w ON c.uid=w.uid AND c.correct=1 AND w.correct=0 GROUP BY 1)
  SELECT uid, {R('coalesce(acc,0.5)')} AS accuracy FROM (SELECT DISTINCT uid FROM rollouts) LEFT JOIN p USING (uid)""")
def ranking_accuracy(spark, path):
    return P.ranking_accuracy(views.rollouts(spark, path)).select("uid", r6("accuracy").alias("accuracy"))


def soft_rollouts(rollouts, uid="uid"):
    """Rollouts with an accuracy in ninths (of the price's cents) and a coarse score, so that both have ties."""
    cents = F.pmod(F.round(F.exp("score") * 100).cast("bigint"), F.lit(9))
    return rollouts.select(F.col(uid).alias("uid"), "rollout_id", F.round("score", 1).alias("score"), (cents / 8.0).alias("acc"))


@query("j19_weighted_accuracy", f"""WITH s AS (SELECT o_custkey AS uid, o_orderkey AS rollout_id, round(ln(o_totalprice),1) AS score, (round(exp(ln(o_totalprice))*100)::BIGINT%9)/8.0::DOUBLE AS acc FROM orders),
  p AS (SELECT a.uid, sum(((a.score>b.score)=(a.acc>b.acc))::INT*abs(a.acc-b.acc)) AS good, sum(abs(a.acc-b.acc)) AS total FROM s a JOIN s b ON a.uid=b.uid AND a.rollout_id<b.rollout_id GROUP BY 1)
  SELECT uid, {R('coalesce(good/nullif(total,0),0.5)')} AS accuracy FROM (SELECT DISTINCT uid FROM s) LEFT JOIN p USING (uid)""")
def weighted_accuracy(spark, path):
    return P.weighted_ranking_accuracy(soft_rollouts(views.rollouts(spark, path))).select("uid", r6("accuracy").alias("accuracy"))


@query("j19_source_accuracy", f"""WITH {SOURCED}, s AS (SELECT data_source AS uid, rollout_id, round(score,1) AS score, (round(exp(score)*100)::BIGINT%9)/8.0::DOUBLE AS acc FROM sourced),
  p AS (SELECT a.uid, sum(((a.score>b.score)=(a.acc>b.acc))::INT*abs(a.acc-b.acc)) AS good, sum(abs(a.acc-b.acc)) AS total FROM s a JOIN s b ON a.uid=b.uid AND a.rollout_id<b.rollout_id GROUP BY 1)
  SELECT uid AS data_source, {R('coalesce(good/nullif(total,0),0.5)')} AS accuracy FROM (SELECT DISTINCT uid FROM s) LEFT JOIN p USING (uid)""")
def source_accuracy(spark, path):
    """The same over whole sources: a few groups that hold all rows."""
    rows = soft_rollouts(views.rollouts_by_source(spark, path), "data_source")
    return P.weighted_ranking_accuracy(rows).select(F.col("uid").alias("data_source"), r6("accuracy").alias("accuracy"))


@query("j20_action_ranking", f"""WITH {TOKENS} SELECT a.rollout_id AS state, {R('avg(((a.value-b.value)*(a.old_lp-b.old_lp)>0)::INT)')} AS accuracy
  FROM tokens a JOIN tokens b ON a.rollout_id=b.rollout_id AND a.pos<b.pos GROUP BY 1""")
def action_ranking(spark, path):
    t = views.tokens(spark, path).select(F.col("rollout_id").alias("state"), F.col("pos").alias("action"), F.col("value").alias("gt"), F.col("old_lp").alias("pred"))
    return P.action_ranking(t).select("state", r6("accuracy").alias("accuracy"))


@query("j21_adjacent_preference", f"""WITH {ROLLOUTS}, n AS (SELECT *, row_number() OVER (ORDER BY rollout_id) AS n FROM rollouts)
  SELECT (n-1)//2 AS pair_id, arg_max(rollout_id,(score,-n)) AS chosen, CASE WHEN count(*)>1 THEN arg_min(rollout_id,(score,-n)) END AS rejected FROM n GROUP BY 1""")
def adjacent(spark, path):
    return P.adjacent_preference(views.rollouts(spark, path))


@query("w30_preference_report", f"""WITH {SIDES}, l AS (SELECT ln(1+x.n_chars)-ln(1+y.n_chars)-(x.toxic-y.toxic) AS margin FROM pairs JOIN lab x ON x.doc_id=accept_item JOIN lab y ON y.doc_id=reject_item)
  SELECT {R('avg(-ln(1/(1+exp(-0.1*margin)))*0.9-ln(1/(1+exp(0.1*margin)))*0.1)')} AS sigmoid_loss, {R('avg(pow(margin-5.0,2))')} AS ipo_loss,
    {R('avg(-ln(1/(1+exp(-0.1*margin))))')} AS ce_loss, {R('avg((margin>0)::INT)')} AS accuracy FROM l""")
def preference_report(spark, path):
    lab = labelled(spark, path)
    side = lambda p, q: lab.select(F.col("doc_id").alias(f"{p}_item"), F.log(1 + F.col("n_chars")).alias(f"{q}_lp"), F.col("toxic").cast("double").alias(f"{q}_ref"))
    d = doc_pairs(spark, path).join(side("accept", "chosen"), "accept_item").join(side("reject", "rejected"), "reject_item")
    d = P.preference_loss(d, 0.1, 0.1).withColumnRenamed("loss", "smooth")
    d = P.preference_loss(d, 0.1, 0.0, "ipo").withColumnRenamed("loss", "ipo")
    d = P.preference_loss(d, 0.1)
    return d.agg(
        r6(F.avg("smooth")).alias("sigmoid_loss"), r6(F.avg("ipo")).alias("ipo_loss"), r6(F.avg("loss")).alias("ce_loss"),
        r6(F.avg((F.col("margin") > 0).cast("int"))).alias("accuracy"),
    )


@query("j15_candidate_pairs", f"""WITH {TOKENS}, w AS (SELECT rollout_id, count(*) AS w FROM tokens GROUP BY 1),
  p AS (SELECT a.rollout_id AS parent, a.pos AS i, b.pos AS j, abs(a.value-b.value) AS gap, row_number() OVER (PARTITION BY a.rollout_id ORDER BY abs(a.value-b.value), a.pos, b.pos) AS rank, w
    FROM tokens a JOIN tokens b ON a.rollout_id=b.rollout_id AND a.pos<b.pos JOIN w ON w.rollout_id=a.rollout_id)
  SELECT parent, i, j, {R('gap')} AS gap FROM p WHERE rank<=greatest(1,round_even(w*w*0.1::DOUBLE,0))""")
def candidate_pairs(spark, path):
    t = views.tokens(spark, path).select(F.col("rollout_id").alias("parent"), F.col("pos").alias("child"), F.col("value").alias("score"))
    return P.shortest_gap_pairs(t, 0.1).select("parent", "i", "j", r6("gap").alias("gap"))


@query("a33_advantage_histogram", f"""WITH {VALUED}, b AS (SELECT mask, CASE WHEN advantage< -1 THEN 0 WHEN advantage>=2 THEN 31 ELSE floor(30*(advantage+1)/3)+1 END::BIGINT AS bin FROM valued)
  SELECT mask, bin, count(*) AS n FROM b GROUP BY ALL""")
def histogram(spark, path):
    return E.token_bins(valued_tokens(spark, path), F.col("advantage"), -1.0, 2.0, 30, ["mask"])


@query("a34_metric_over_runs", f"""WITH {ROLLOUTS}, m AS (SELECT (arrival//365)::INT AS run, pred, avg(score) AS v FROM rollouts GROUP BY ALL)
  SELECT pred, count(*) AS runs, {R('avg(v)')} AS mean, {R('stddev_samp(v)')} AS std FROM m GROUP BY 1""")
def over_runs(spark, path):
    m = views.rollouts(spark, path).groupBy(F.floor(F.col("arrival") / 365).alias("run"), "pred").agg(F.avg("score").alias("v"))
    return m.groupBy("pred").agg(F.count(F.lit(1)).alias("runs"), r6(F.avg("v")).alias("mean"), r6(F.stddev_samp("v")).alias("std"))


@query("j17_group_stats_on_tokens", f"""WITH {ROLLOUTS}, {TOKENS}, g AS (SELECT rollout_id, score-avg(score) OVER (PARTITION BY uid) AS a FROM rollouts)
  SELECT rollout_id, pos, {R('a*mask')} AS advantage FROM tokens JOIN g USING (rollout_id)""")
def group_to_tokens(spark, path):
    a = attach_stats(
        views.rollouts(spark, path), ["uid"], {"m": F.avg("score")}, ["rollout_id"]
    ).withColumn("advantage", F.col("score") - F.col("m"))
    return views.tokens(spark, path).join(a.select("rollout_id", "advantage"), "rollout_id").select(
        "rollout_id", "pos", r6(F.col("advantage") * F.col("mask")).alias("advantage")
    )
