"""Curation, grading, filter and sampling queries (P, F, G, X, W1-W10, S13-S16)."""

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions.numeric import r6
from ..operators import curation as C
from ..operators import grading as G
from ..operators import sampling as SM
from ..sources import views
from .evaluation import SIDES, doc_pairs
from .registry import R, ROLLOUTS, SOURCED, TOKENS, U, query


def responses(spark, path):
    """Graded text responses made from orders: every answer style in one text, gold wrong for open orders."""
    o = views.table(spark, path, "orders")
    cust = views.table(spark, path, "customer")
    n = F.floor("o_totalprice")
    commas = F.format_number(n, 0)
    text = F.concat(
        F.lit("Step one costs <<2*3=6>> 6.\n\nStep two by <answer>six</answer> checks.\nNot \\boxed{12} but \\boxed{\\frac{1}{"), n, F.lit("}}.\nAnswer: $"), commas,
        F.lit("$ dollars\n<answer>The "), n, F.lit(" Dollars!</answer>\n#### "), commas,
    )
    gold_n = F.when(F.col("o_orderstatus") == "O", n + 1).otherwise(n)
    source = F.col("c_mktsegment")
    gold = F.when(source == "AUTOMOBILE", F.concat(F.lit("\\frac1{"), gold_n, F.lit("}"))).when(
        source == "HOUSEHOLD", F.concat(gold_n, F.lit(" dollars"))
    ).otherwise(gold_n.cast("string"))
    return o.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("uid"), source.alias("data_source"), text.alias("text"), gold.alias("gold"), n.alias("n"), F.col("o_orderstatus").alias("st"), F.length(text).alias("len"),
    )


def lines(arr, *fields):
    """Array of structs as text: fields joined by ':', elements by '|'."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.array_join(F.transform(arr, lambda m: F.concat_ws(":", *[m[f].cast("string") for f in fields])), "|")


RULES = {"BUILDING": "delimited_number", "AUTOMOBILE": "boxed", "MACHINERY": "answer_line", "HOUSEHOLD": "qa"}
GRADED = """gr AS (SELECT o_orderkey AS id, c_mktsegment AS data_source, o_orderstatus AS st, floor(o_totalprice)::BIGINT AS n FROM orders JOIN customer ON o_custkey=c_custkey)"""


@query("g01_grade_by_source", f"WITH {GRADED} SELECT id, data_source, CASE WHEN st<>'O' THEN 1.0 WHEN data_source='MACHINERY' THEN -1.0 ELSE 0.0 END::DOUBLE AS grade FROM gr WHERE data_source<>'FURNITURE'")
def grade_by_source(spark, path):
    good, _ = G.grade(responses(spark, path), RULES)
    return good.select("id", "data_source", "grade")


@query("g01_quarantine", f"WITH {GRADED} SELECT data_source, 'unknown data source' AS reason, count(*) AS n FROM gr WHERE data_source='FURNITURE' GROUP BY 1")
def quarantine(spark, path):
    _, bad = G.grade(responses(spark, path), RULES)
    return bad.groupBy("data_source", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("x_extractions", f"""WITH {GRADED} SELECT id, n::VARCHAR AS last_number, n::VARCHAR AS delimited, '\\frac{{1}}{{'||n||'}}' AS boxed, n::VARCHAR AS answer_line, n||' dollars' AS qa, 2::INT AS answer_tags, 'Step one costs <<2*3=6>> 6.' AS first_line,
   'Step one c...' AS short, 'Step one costs  6.' AS stripped FROM gr""")
def extractions(spark, path):
    t = F.col("text")
    return responses(spark, path).select(
        "id", X.last_number(t).alias("last_number"), X.delimited_number(t).alias("delimited"), X.last_boxed(t).alias("boxed"),
        X.normal_answer(X.answer_line(t)).alias("answer_line"), X.qa_normal(X.answer_tag(t)).alias("qa"), X.count_of(t, "</answer>").cast("int").alias("answer_tags"),
        X.first_line(t).alias("first_line"), X.truncated(t, 10).alias("short"), X.first_line(X.strip_calculator(t)).alias("stripped"),
    )


@query("x08_step_offsets", f"""WITH {GRADED}, f AS (SELECT id, length(n::VARCHAR) AS d, length(format('{{:,}}',n)) AS c FROM gr)
  SELECT id, array_to_string([0, 27, 28, 69, 108+d, 127+d+c, 164+2*(d+c)],',') AS offsets FROM f""")
def step_offsets(spark, path):
    return responses(spark, path).select("id", F.array_join(X.step_offsets(F.col("text")).cast("array<string>"), ",").alias("offsets"))


@query("x06_qa_normal", """WITH l AS (SELECT conv_id, turn, regexp_replace(lower(text), '[!"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]', '', 'g') AS t FROM conversations)
  SELECT conv_id, turn, array_to_string([w FOR w IN string_split_regex(t,'\\s+') IF w NOT IN ('a','an','the','')],' ') AS normal FROM l""")
def qa_normal(spark, path):
    return views.messages(spark, path).select("conv_id", "turn", X.qa_normal(F.col("text")).alias("normal"))


@query("x11_stable_ids", """SELECT doc_id, ('0x'||substr(md5(source||'/'||doc_id),1,15))::BIGINT AS stable_id FROM documents""")
def stable_ids(spark, path):
    return views.texts(spark, path).select("doc_id", N.stable_id(F.concat_ws("/", "source", "doc_id")).alias("stable_id"))


@query("x09_overlong_and_interval", f"""WITH {ROLLOUTS}, p AS (SELECT uid, avg(correct) AS p, count(*) AS n FROM rollouts GROUP BY 1)
  SELECT rollout_id, {R('least(-(n_tokens-(400-100))/100.0*0.5,0.0)')} AS penalty, {R('2*1.96*sqrt(p*(1-p)/n)')} AS interval_length FROM rollouts JOIN p USING (uid)""")
def overlong(spark, path):
    from ..operators.spread import attach_stats

    rows = attach_stats(views.rollouts(spark, path), ["uid"], {"p": F.avg("correct"), "n": F.count(F.lit(1))}, ["rollout_id"])
    return rows.select("rollout_id", r6(N.overlong_penalty(F.col("n_tokens"), 400, 100, 0.5)).alias("penalty"), r6(N.ci_length(F.col("p"), F.col("n"))).alias("interval_length"))


@query("x14_parse_mode", f"""WITH {GRADED} SELECT id, CASE WHEN id%3=0 THEN n::VARCHAR ELSE '\\frac{{1}}{{'||n||'}}' END AS answer FROM gr""")
def parse_mode(spark, path):
    k = F.col("id") % 3 == 0
    prompt = F.when(k, "Write # Answer first").otherwise("Solve")
    text = F.concat(F.col("text"), F.lit("\n# Answer\n"), F.col("n"))
    return responses(spark, path).select("id", X.boxed_or_delimited(prompt, text).alias("answer"))


@query("g03_strict_boxed", f"WITH {GRADED} SELECT id, CASE WHEN st='F' THEN 1.0 ELSE -1.0 END::DOUBLE AS grade FROM gr")
def strict_boxed(spark, path):
    short = F.concat(F.lit("so \\boxed{"), F.col("n"), F.lit("}"))
    gold = F.when(F.col("st") == "F", F.col("n")).otherwise(F.col("n") + 2).cast("string")
    return responses(spark, path).select("id", G.strict_boxed_grade(short, gold).alias("grade"))


@query("g04_qa_substring", f"WITH {GRADED} SELECT id, CASE WHEN st<>'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS grade FROM gr")
def qa_substring(spark, path):
    gold = F.array(F.when(F.col("st") == "O", F.lit("eleven")).otherwise(F.concat(F.col("n"), F.lit(" a Dollar"))), F.lit("nothing"))
    return responses(spark, path).select("id", G.qa_grade(F.col("text"), gold, substring=True).alias("grade"))


@query("g05_list_grade", """WITH l AS (SELECT l_orderkey AS id, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey) AS q FROM lineitem GROUP BY 1), d AS (SELECT id, q, list_distinct(q) AS g FROM l)
  SELECT id, len(list_distinct(list_slice(q, greatest(len(q)-len(g)+1,1), len(q))))=len(g) AS good FROM d""")
def list_grade(spark, path):
    e = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    l = views.table(spark, path, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(e)).alias("x"))
    golds = F.transform("x", lambda v: v["l_quantity"].cast("string"))
    preds = F.transform("x", lambda v: F.concat(v["l_quantity"].cast("string"), F.lit("00001")))
    return l.select("id", G.list_grade(preds, golds).alias("good"))


@query("g06_unfinished_penalty", f"WITH {ROLLOUTS} SELECT rollout_id, CASE WHEN n_tokens>400 THEN -1.0 ELSE correct END::DOUBLE AS reward FROM rollouts")
def unfinished(spark, path):
    finish = F.when(F.col("n_tokens") > 400, "length").otherwise("stop")
    return views.rollouts(spark, path).select("rollout_id", G.unfinished_penalty(F.col("correct").cast("double"), finish, -1.0).alias("reward"))


@query("f13_several_conclusions", f"WITH {GRADED} SELECT id, CASE WHEN id%5=0 THEN -2.0 ELSE 1.0 END::DOUBLE AS score FROM gr")
def conclusions(spark, path):
    t = F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("\n#### again"))).otherwise(F.col("text"))
    return responses(spark, path).select("id", G.several_conclusions(t, F.lit(1.0), "####", 2).alias("score"))


@query("g07_reward_placement", f"""WITH {ROLLOUTS}, {TOKENS}, l AS (SELECT rollout_id, max(pos) AS last FROM tokens WHERE mask=1 GROUP BY 1)
  SELECT rollout_id, pos, {R('CASE WHEN pos=last THEN score ELSE 0.0 END')} AS token_reward FROM tokens LEFT JOIN l USING (rollout_id) JOIN rollouts USING (rollout_id)""")
def reward_placement(spark, path):
    rows = G.place_reward(views.tokens(spark, path), views.rollouts(spark, path).select("rollout_id", "score"))
    return rows.select("rollout_id", "pos", r6("token_reward").alias("token_reward"))


@query("g08_parse_metrics", f"WITH {SOURCED} SELECT data_source, count(*) AS attempts, count(*) FILTER (pred='5-LOW') AS failures, {R('count(*) FILTER (pred=' + chr(39) + '5-LOW' + chr(39) + ')/count(*)')} AS failure_rate FROM sourced GROUP BY 1")
def parse_metrics(spark, path):
    out = G.parse_metrics(views.rollouts_by_source(spark, path), "data_source", F.col("pred") != "5-LOW")
    return out.withColumn("failure_rate", r6("failure_rate"))


# --- projections --------------------------------------------------------------------------------------


def flat_prompts(rows, *more):
    return rows.select(
        "data_source", lines("prompt", "role", "content").alias("prompt"), "ability", F.col("reward_model.style"), F.col("reward_model.ground_truth"),
        F.col("extra_info.split"), F.col("extra_info.index").alias("idx"), F.col("extra_info.question"), *more,
    )


@query("p01_prompt_rows", """SELECT 'bench' AS data_source, 'user:'||text||' Think step by step.' AS prompt, 'math' AS ability, 'rule' AS style, split_part(text,' ',1) AS ground_truth,
  'train' AS split, row_number() OVER (ORDER BY item_id)-1 AS idx, text AS question FROM benchmark""")
def prompt_rows(spark, path):
    b = C.with_index(views.table(spark, path, "benchmark"), "item_id")
    rows = C.prompt_rows(b, F.lit("bench"), F.col("text"), F.split_part("text", F.lit(" "), F.lit(1)), "math", "train", suffix=" Think step by step.")
    return flat_prompts(rows)


@query("p26_tool_prompt_rows", """SELECT 'tool' AS data_source, 'system:Use tools.|user:'||text AS prompt, 'math' AS ability, 'rule' AS style, item_id::VARCHAR AS ground_truth, 'test' AS split,
  row_number() OVER (ORDER BY item_id)-1 AS idx, text AS question, true AS need_tools, item_id::VARCHAR AS tool_truth FROM benchmark""")
def tool_rows(spark, path):
    b = C.with_index(views.table(spark, path, "benchmark"), "item_id")
    key = F.col("item_id").cast("string")
    extra = {"need_tools": F.lit(True), "tools_kwargs": F.struct(key.alias("ground_truth"))}
    rows = C.prompt_rows(b, F.lit("tool"), F.col("text"), key, "math", "test", system="Use tools.", extra=extra)
    return flat_prompts(rows, F.col("extra_info.need_tools"), F.col("extra_info.tools_kwargs.ground_truth").alias("tool_truth"))


@query("p02_answer_fields", f"WITH {GRADED} SELECT id, CASE WHEN id%4=0 THEN n::VARCHAR WHEN id%4=1 THEN '\\frac{{1}}{{'||n||'}}' WHEN id%4=2 THEN '0' END AS answer FROM gr")
def answer_fields(spark, path):
    k = F.col("id") % 4
    first = F.when(k == 0, F.concat(F.lit(" "), F.col("n"))).otherwise(F.lit("  "))
    boxed = F.when(k == 1, F.col("text")).otherwise(F.lit("none"))
    return responses(spark, path).select("id", C.answer_from_fields([first], [boxed], zero_when=k == 2).alias("answer"))


@query("p03_delimited_solution", f"WITH {GRADED} SELECT id, format('{{:,}}',n) AS answer, 'Step one costs  6.' AS first_step FROM gr")
def delimited_solution(spark, path):
    rows = C.delimited_solution(responses(spark, path), "text")
    return rows.select("id", "answer", X.first_line(F.col("reasoning")).alias("first_step"))


@query("p05_joined_steps", "SELECT conv_id, array_to_string(list(text ORDER BY turn), chr(10)) AS steps, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def joined_steps(spark, path):
    c = C.conversation(views.messages(spark, path))
    return c.select("conv_id", F.array_join(F.transform("messages", lambda m: m["content"]), "\n").alias("steps"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


def preference(spark, path):
    docs = views.texts(spark, path)
    side = lambda p: docs.select(F.col("doc_id").alias(f"{p}_item"), F.concat_ws(":", "source", "n_chars").alias(p))
    return doc_pairs(spark, path).join(side("accept"), "accept_item").join(side("reject"), "reject_item").select(
        F.col("question_id").alias("prompt"), F.col("accept").alias("chosen"), F.col("reject").alias("rejected"), (F.col("accept_item") * 1000003 + F.col("reject_item")).alias("seq")
    )


PREF = SIDES + ", pref AS (SELECT question_id AS prompt, x.source||':'||x.n_chars AS chosen, y.source||':'||y.n_chars AS rejected, accept_item*1000003+reject_item AS seq FROM pairs JOIN documents x ON x.doc_id=accept_item JOIN documents y ON y.doc_id=reject_item)"


@query("p06_preference_to_sft", f"WITH {PREF} SELECT prompt, chosen AS response FROM pref UNION ALL SELECT prompt, rejected FROM pref")
def preference_to_sft(spark, path):
    return C.preference_to_sft(preference(spark, path))


@query("p07_preference_split", f"WITH {PREF}, i AS (SELECT *, row_number() OVER (ORDER BY seq)-1 AS i, count(*) OVER () AS n FROM pref) SELECT seq, CASE WHEN i<floor(n*0.75) THEN 'train' ELSE 'test' END AS split FROM i")
def preference_split(spark, path):
    from ..session import materialise

    return C.preference_split(materialise(preference(spark, path), "pairs"), "seq").select("seq", "split")


@query("p09_completion_rows", """SELECT doc_id, replace(regexp_replace(replace(trim(text,' '),' [title]','. '),'\\[.*?\\]','','g'),'  ',' ') AS query, upper(lang[1])||lang[2:]||'|'||source AS choices FROM documents""")
def completion_rows(spark, path):
    first_up = F.concat(F.upper(F.substring("lang", 1, 1)), F.substr("lang", F.lit(2)))
    return views.texts(spark, path).select("doc_id", X.clean_completion(F.col("text")).alias("query"), F.array_join(F.array(first_up, F.col("source")), "|").alias("choices"))


@query("p11_interactive_rows", """SELECT conv_id, 'system:Be helpful.|'||string_agg(role||':'||text, '|' ORDER BY turn) AS prompt, count(*)::INT AS turns, md5('p|'||conv_id) AS id FROM conversations GROUP BY 1""")
def interactive(spark, path):
    c = C.conversation(views.messages(spark, path))
    return c.select(
        "conv_id", lines(F.concat(F.array(C.message("system", F.lit("Be helpful."))), "messages"), "role", "content").alias("prompt"),
        F.size("messages").alias("turns"), N.sample_key("p", F.col("conv_id")).alias("id"),
    )


@query("p12_append_completion", "WITH c AS (SELECT conv_id, list({'role':role,'content':text} ORDER BY turn) AS m FROM conversations GROUP BY 1) SELECT conv_id, list_append(m,{'role':'assistant','content':'done '||conv_id})[-1].content AS last, len(m)::INT+1 AS n FROM c")
def append_completion(spark, path):
    c = C.conversation(views.messages(spark, path))
    m = F.concat("messages", F.array(C.message("assistant", F.concat(F.lit("done "), F.col("conv_id")))))
    return c.select("conv_id", F.element_at(m, -1)["content"].alias("last"), F.size(m).alias("n"))


@query("p13_sft_episodes", """WITH b AS (SELECT item_id, [w FOR w IN string_split_regex(text,'\\s+') IF w<>''] AS w FROM benchmark) SELECT item_id, '[Q] '||w[1]||' [A]' AS query, array_to_string(w,' ') AS response, len(w)::INT AS n, len(w)::DOUBLE AS advantage_sum FROM b""")
def sft_episodes(spark, path):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    b = views.table(spark, path, "benchmark").select("item_id", w.alias("w"))
    return b.select("item_id", F.format_string("[Q] %s [A]", F.element_at("w", 1)).alias("query"), F.array_join("w", " ").alias("response"), F.size("w").alias("n"),
        F.aggregate(F.array_repeat(F.lit(1.0), F.size("w")), F.lit(0.0), lambda a, x: a + x).alias("advantage_sum"))


@query("p14_loss_mask", """WITH t AS (SELECT conv_id, turn, role, len([w FOR w IN string_split_regex(text,'\\s+') IF w<>'']) AS n FROM conversations)
  SELECT conv_id, sum(n+1)::INT AS tokens, sum(CASE WHEN role='assistant' THEN n ELSE 0 END)::INT AS active FROM t GROUP BY 1""")
def loss_mask(spark, path):
    m = C.loss_mask(views.messages(spark, path))
    return m.select("conv_id", F.size("tokens").alias("tokens"), F.size(F.filter("mask", lambda x: x == 1)).alias("active"))


@query("p15_response_mask", f"WITH {TOKENS} SELECT rollout_id, pos, (coalesce(sum((mask=0)::INT) OVER (PARTITION BY rollout_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)=0)::INT AS response_mask FROM tokens")
def response_mask(spark, path):
    return C.response_mask(views.tokens(spark, path), F.col("mask") == 0).select("rollout_id", "pos", "response_mask")


@query("p16_cut_responses", """WITH b AS (SELECT doc_id, [w FOR w IN string_split_regex(text,'\\s+') IF w<>''] AS w FROM documents) SELECT doc_id, least(len(w),100-2)::INT AS n, len(w)>98 AS unfinished, CASE WHEN len(w)>98 THEN -1.0 ELSE 1.0 END::DOUBLE AS score FROM b""")
def cut_responses(spark, path):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    d = views.texts(spark, path).select("doc_id", w.alias("response"), F.array(F.lit("q"), F.lit("r")).alias("query"), F.lit(1.0).alias("score"))
    return C.cut_response(d, 100, -1.0).select("doc_id", F.size("response").alias("n"), "unfinished", "score")


@query("p21_message_segments", """SELECT conv_id, turn, 'text:'||text||'|image:<image>|text:'||role||'|video:<video>' AS segments FROM conversations WHERE text<>''""")
def message_segments(spark, path):
    t = F.concat("text", F.lit("<image>"), F.col("role"), F.lit("<video>"))
    return views.messages(spark, path).where("text <> ''").select("conv_id", "turn", lines(X.spans(t, ["<image>", "<video>"]), "type", "content").alias("segments"))


@query("p22_edge_tokens", f"""WITH {ROLLOUTS}, {TOKENS} SELECT rollout_id, pos, {R('score-11')} AS advantage, {R('CASE WHEN lead(pos) OVER (PARTITION BY rollout_id ORDER BY pos) IS NULL THEN score ELSE 0.0 END')} AS reward FROM tokens JOIN rollouts USING (rollout_id)""")
def edge_tokens(spark, path):
    arr = views.tokens(spark, path).groupBy("rollout_id").agg(F.sort_array(F.collect_list("pos")).alias("ids"))
    e = views.rollouts(spark, path).select("rollout_id", "score", (F.col("score") - 11).alias("adv")).join(arr, "rollout_id")
    rows = e.select("rollout_id", "score", "adv", F.size("ids").alias("n"), F.posexplode("ids").alias("i", "pos"))
    return rows.select("rollout_id", "pos", r6("adv").alias("advantage"), r6(F.when(F.col("i") == F.col("n") - 1, F.col("score")).otherwise(0.0)).alias("reward"))


@query("p23_few_shot", f"""WITH ex AS (SELECT item_id, text, row_number() OVER (ORDER BY md5('8|'||item_id), item_id)-1 AS num, count(*) OVER () AS total FROM benchmark),
  t AS (SELECT b.item_id, b.text AS problem, y AS try, j, (SELECT any_value(total) FROM ex) AS total FROM benchmark b, range(0,10) a(y), range(0,4) c(j)),
  p AS (SELECT *, (('0x'||substr(md5('8|'||try||'|'||item_id),1,15))::BIGINT%total + j*greatest(total//4,1))%total AS num FROM t),
  s AS (SELECT p.item_id, try, array_to_string(list_slice(list(ex.text ORDER BY j),1,3), chr(10)||chr(10)) AS shots FROM p JOIN ex USING (num) WHERE problem<>ex.text GROUP BY ALL)
  SELECT item_id AS row_id, coalesce(arg_min(shots,try) FILTER (length(shots)<=900), right(arg_max(shots,try),900)) AS shots, (min(try) FILTER (length(shots)<=900))::INT AS try FROM s GROUP BY 1""")
def few_shot(spark, path):
    b = views.table(spark, path, "benchmark")
    rows = b.select(F.col("item_id").alias("row_id"), F.col("text").alias("problem"))
    ex = b.select(F.col("item_id").alias("ex_id"), F.col("text").alias("problem"), "text")
    return C.few_shot(rows, ex, 3, 900, seed=8)


@query("p24_transcript_messages", f"""WITH {GRADED} SELECT id, 'assistant:code:print('||n||')|tool:interpreter:'||n||'|assistant:answer:It is '||n AS messages FROM gr""")
def transcripts(spark, path):
    n = F.col("n")
    t = F.concat(F.lit("think <code>\nprint("), n, F.lit(")\n</code> then <interpreter>"), n, F.lit("</interpreter> so <answer> It is "), n, F.lit(" </answer>"))
    return responses(spark, path).select("id", lines(C.transcript_messages(t), "role", "type", "content").alias("messages"))


@query("p25_solved_messages", f"WITH {ROLLOUTS} SELECT rollout_id, 'user:'||uid||':0|assistant:'||pred||':1' AS messages FROM rollouts WHERE correct=1")
def solved(spark, path):
    m = lambda role, c, k: F.struct(F.lit(role).alias("role"), c.alias("content"), F.lit(k).alias("loss_mask"))
    r = views.rollouts(spark, path).where("correct = 1")
    return r.select("rollout_id", lines(F.array(m("user", F.col("uid").cast("string"), 0), m("assistant", F.col("pred"), 1)), "role", "content", "loss_mask").alias("messages"))


@query("p27_drop_null_columns", "SELECT n_nationkey, n_name FROM nation")
def null_columns(spark, path):
    n = views.table(spark, path, "nation").select("n_nationkey", "n_name", F.lit(None).alias("unused"))
    return C.drop_null_columns(n)


# --- filters and sampling -----------------------------------------------------------------------------


@query("f01_long_prompts", "SELECT doc_id FROM documents WHERE n_chars<=2000")
def long_prompts(spark, path):
    return views.texts(spark, path).where("n_chars <= 2000").select("doc_id")


@query("f02_long_questions", "SELECT doc_id FROM documents WHERE length('[Q] '||text||' [A]')<=1500")
def long_questions(spark, path):
    return views.texts(spark, path).where(F.length(F.format_string("[Q] %s [A]", "text")) <= 1500).select("doc_id")


@query("f03_varied_groups", f"WITH {ROLLOUTS}, g AS (SELECT uid FROM rollouts GROUP BY 1 HAVING stddev_pop(correct)>0 OR count(*)=1) SELECT rollout_id FROM rollouts JOIN g USING (uid)")
def varied_groups(spark, path):
    df = views.rollouts(spark, path).withColumn("score", F.col("correct"))
    return C.varied_groups(df).select("rollout_id")


@query("f04_filled_batch", f"""WITH {ROLLOUTS}, g AS (SELECT uid, min((arrival,uid)) AS f FROM rollouts GROUP BY 1 HAVING stddev_pop(correct)>0 OR count(*)=1 ORDER BY f LIMIT 128)
  SELECT rollout_id FROM rollouts JOIN g USING (uid) ORDER BY f, arrival, rollout_id LIMIT 1024""")
def filled_batch(spark, path):
    kept = C.varied_groups(views.rollouts(spark, path).withColumn("score", F.col("correct")))
    return C.fill_batch(kept, 128, 8).select("rollout_id")


@query("f05_accuracy_filter", f"""WITH {ROLLOUTS}, p AS (SELECT uid, (avg(correct) BETWEEN 0.2 AND 0.8 AND max(n_tokens)<450-1)::INT AS passed FROM rollouts GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY passed DESC, uid) AS place, count(*) OVER () AS n FROM p)
  SELECT uid, passed, place FROM r WHERE place<=n//2""")
def accuracy_filter(spark, path):
    return C.accuracy_filter(views.rollouts(spark, path), 0.2, 0.8, 450, 2).select("uid", "passed", "place")


@query("f08_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate>=TIMESTAMP '1997-01-01' AND o_orderdate<TIMESTAMP '1998-01-01'")
def date_range(spark, path):
    d = F.col("o_orderdate")
    return views.table(spark, path, "orders").where((d >= F.lit("1997-01-01").cast("timestamp_ntz")) & (d < F.lit("1998-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("w01_best_turn", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r=1")
def best_turn(spark, path):
    return C.best_turn(views.table(spark, path, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@query("w02_dedup_prompts", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def dedup(spark, path):
    return C.dedup_by(views.texts(spark, path), F.col("text"), "doc_id").select("doc_id")


@query("w07_iteration_slice", """WITH n AS (SELECT count(*) AS n FROM orders), s AS (SELECT o_orderkey, p*n.n+row_number() OVER (PARTITION BY p ORDER BY md5('5.'||p||'|'||o_orderkey), o_orderkey)-1 AS pos_at FROM orders, n, range(0,3) t(p))
  SELECT o_orderkey, pos_at FROM s WHERE pos_at>=2048 AND pos_at<3072""")
def iteration_slice(spark, path):
    o = views.table(spark, path, "orders").select("o_orderkey")
    return SM.iteration_slice(o, "o_orderkey", 2, 1024, max(o.count(), 1), 5).select("o_orderkey", F.col("at").alias("pos_at"))


@query("w08_fit_to_count", """WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY md5('2|'||doc_id), doc_id) AS pos, count(*) OVER () AS n FROM documents)
  SELECT doc_id, floor((2500-pos)/n)::BIGINT+1 AS copies FROM s WHERE floor((2500-pos)/n)>=0""")
def fit_to_count(spark, path):
    d = SM.fit_to_count(views.texts(spark, path).select("doc_id"), "doc_id", 2500, 2)
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))


@query("w09_split_subsets", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('1|'||doc_id), doc_id) AS r FROM documents) WHERE r<=50")
def split_subsets(spark, path):
    return SM.subset(views.texts(spark, path).select("lang", "doc_id"), "doc_id", 50, 1, ["lang"])


@query("w10_validation_split", f"SELECT doc_id, {U(chr(109) + 'd5(' + chr(39) + '4|' + chr(39) + '||doc_id)')}<0.1 AS validation FROM documents")
def validation_split(spark, path):
    d = views.texts(spark, path)
    return d.select("doc_id", SM.split_share(d, "doc_id", 0.1, 4).alias("validation"))


@query("w27_concatenated", "SELECT n_name AS name, 'nation' AS origin FROM nation UNION ALL SELECT r_name, 'region' FROM region UNION ALL SELECT c_name, 'customer' FROM customer")
def concatenated(spark, path):
    part = lambda t, c: views.table(spark, path, t).select(F.col(c).alias("name"), F.lit(t).alias("origin"))
    return part("nation", "n_name").unionByName(part("region", "r_name")).unionByName(part("customer", "c_name"))


@query("p04_math_fields", f"WITH {GRADED} SELECT id, 'p'||id AS problem, CASE WHEN id%2=0 THEN id::VARCHAR ELSE '\\frac{{1}}{{'||n||'}}' END AS answer, 1 AS answers FROM gr")
def math_fields(spark, path):
    raw = responses(spark, path).select(
        "id", F.concat(F.lit("p"), F.col("id")).alias("question"), F.col("text").alias("solution"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("answer")
    )
    rows = C.math_fields(raw)
    return rows.select("id", "problem", F.element_at("answer", 1).alias("answer"), F.size("answer").alias("answers"))


@query("p08_alignment_prompts", f"WITH {PREF} SELECT 'user:'||prompt AS prompt, 'alignment' AS ability, chosen AS ground_truth, row_number() OVER (ORDER BY seq)-1 AS idx FROM pref")
def alignment_prompts(spark, path):
    from ..session import materialise

    rows = C.with_index(materialise(preference(spark, path), "pairs"), "seq")
    out = C.prompt_rows(rows, F.lit("pref"), F.col("prompt"), F.col("chosen"), "alignment", "train")
    return out.select(lines("prompt", "role", "content").alias("prompt"), "ability", F.col("reward_model.ground_truth"), F.col("extra_info.index").alias("idx"))


@query("p10_search_rows", "SELECT 'search_'||source AS data_source, 'system:Search first.|user:'||lang||'?' AS prompt, CASE WHEN doc_id%2=0 THEN 'gold'||doc_id ELSE source END AS target, doc_id%2=0 AS from_reward, doc_id AS tool_doc FROM documents")
def search_rows(spark, path):
    even = F.col("doc_id") % 2 == 0
    raw = views.texts(spark, path).select(
        "doc_id", "source", F.concat("lang", F.lit("?")).alias("question"), F.when(even, F.concat(F.lit("gold"), F.col("doc_id"))).alias("ground_truth"), F.col("source").alias("golden_answers")
    )
    rows = C.search_rows(raw, "Search first.")
    return rows.select(
        "data_source", lines("prompt", "role", "content").alias("prompt"), F.col("reward_model.target").alias("target"), even.alias("from_reward"), F.col("extra_info.tools_kwargs.doc_id").alias("tool_doc")
    )


@query("u01_custom_reward", f"WITH {ROLLOUTS} SELECT rollout_id, {R('score*0.5+correct')} AS reward, {R('sqrt(score)')} AS external FROM rollouts")
def custom_reward(spark, path):
    import pandas as pd

    from ..operators.registry import with_reward

    @F.pandas_udf("double")
    def outside(s: pd.Series) -> pd.Series:
        return s**0.5

    rows = with_reward(views.rollouts(spark, path), lambda df, w: df["score"] * w + df["correct"], w=0.5)
    rows = with_reward(rows, lambda df: outside(df["score"]), name="external")
    return rows.select("rollout_id", r6("reward").alias("reward"), r6("external").alias("external"))
