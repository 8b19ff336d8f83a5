"""Tree queries."""

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import trees as T
from ..operators.registry import PATH_FILTERS, PATH_REWRITES
from ..session import materialise
from ..sources import views
from .registry import NODES, R, query

VALUES = NODES + """, v3 AS (SELECT *, coalesce(reward,0.0) AS value, 0.0::DOUBLE AS value_std, 0 AS n_children FROM nodes WHERE depth=3),
  s3 AS (SELECT parent_id, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM v3 GROUP BY 1),
  v2 AS (SELECT nodes.*, coalesce(m,0.0) AS value, coalesce(s,0.0) AS value_std, coalesce(n,0) AS n_children FROM nodes LEFT JOIN s3 ON s3.parent_id=node_id WHERE depth=2),
  s2 AS (SELECT parent_id, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM v2 GROUP BY 1),
  v1 AS (SELECT nodes.*, coalesce(m,0.0) AS value, coalesce(s,0.0) AS value_std, coalesce(n,0) AS n_children FROM nodes LEFT JOIN s2 ON s2.parent_id=node_id WHERE depth=1),
  s1 AS (SELECT parent_id, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM v1 GROUP BY 1),
  v0 AS (SELECT nodes.*, coalesce(m,0.0) AS value, coalesce(s,0.0) AS value_std, coalesce(n,0) AS n_children FROM nodes LEFT JOIN s1 ON s1.parent_id=node_id WHERE depth=0),
  valued AS (FROM v3 UNION ALL FROM v2 UNION ALL FROM v1 UNION ALL FROM v0)"""
EDGE = VALUES + """, edges AS (SELECT c.*, p.value AS parent_value, p.value_std AS parent_std, p.text AS query, p.n_children AS allocated_k, r.value AS root_value,
    's0:'||md5(c.tree_id||'|'||c.parent_id||'|'||c.node_id) AS edge_id
  FROM valued c JOIN valued p ON c.parent_id=p.node_id JOIN v0 r ON r.tree_id=c.tree_id)"""


def valued(spark, path):
    return T.back_up_values(views.nodes(spark, path), depth=3)


def tree_edges(spark, path):
    return T.edges(valued(spark, path))


@query("v21_value_backup", f"WITH {VALUES} SELECT node_id, {R('value')} AS value, {R('value_std')} AS value_std, n_children FROM valued")
def value_backup(spark, path):
    return valued(spark, path).select("node_id", r6("value").alias("value"), r6("value_std").alias("value_std"), "n_children")


@query("v21_weighted_backup", f"""WITH {NODES}, w AS (SELECT *, length(text)::DOUBLE AS w FROM nodes),
  a AS (SELECT parent_id, sum(coalesce(reward,0.0)*w)/sum(w) AS v FROM w WHERE depth=3 GROUP BY 1),
  b AS (SELECT parent_id, sum(coalesce(v,0.0)*w)/sum(w) AS v FROM w LEFT JOIN a ON a.parent_id=node_id WHERE depth=2 GROUP BY w.parent_id),
  c AS (SELECT w.parent_id, sum(coalesce(v,0.0)*w)/sum(w) AS v FROM w LEFT JOIN b ON b.parent_id=node_id WHERE depth=1 GROUP BY 1)
  SELECT parent_id AS node_id, {R('v')} AS value FROM c UNION ALL SELECT parent_id, {R('v')} FROM b UNION ALL SELECT parent_id, {R('v')} FROM a""".replace("b AS (SELECT parent_id,", "b AS (SELECT w.parent_id,"))
def weighted_backup(spark, path):
    nodes = views.nodes(spark, path).withColumn("w", F.length("text").cast("double"))
    out = T.back_up_values(nodes, depth=3, weight="w")
    return out.where("n_children > 0").select("node_id", r6("value").alias("value"))


@query("p18_edges", f"""WITH {EDGE} SELECT edge_id, tree_id, parent_id, node_id, depth, query, text, (n_children=0) AS leaf, allocated_k,
  {R('value')} AS child_value, {R('parent_value')} AS parent_value FROM edges""")
def edges(spark, path):
    return tree_edges(spark, path).select(
        "edge_id", "tree_id", "parent_id", "node_id", "depth", "query", "text", (F.col("n_children") == 0).alias("leaf"),
        "allocated_k", r6("value").alias("child_value"), r6("parent_value").alias("parent_value"),
    )


MODES = {
    "spo": ("value-parent_value", "value"),
    "treepo": ("0.5*(value-parent_value)+0.5*(value-root_value)", "value"),
    "treerl": ("(value-parent_value)+0.9*value-parent_value", "(value-parent_value)+0.9*value"),
}


def _mode(mode):
    adv, val = MODES[mode]

    @query(f"v22_update_{mode}", f"WITH {EDGE} SELECT edge_id, {R(adv)} AS advantage, {R(val)} AS target_value FROM edges")
    def run(spark, path):
        rows = T.update_values(tree_edges(spark, path), mode)
        return rows.select("edge_id", r6("advantage").alias("advantage"), r6("target_value").alias("target_value"))


for _m in MODES:
    _mode(_m)


@query("v22_update_normalised", f"WITH {EDGE} SELECT edge_id, {R('(value-parent_value)/(parent_std+1e-8)')} AS advantage FROM edges WHERE parent_std>0")
def update_normalised(spark, path):
    rows = T.update_values(tree_edges(spark, path), "spo", "grpo").where("parent_std > 0")
    return rows.select("edge_id", r6("advantage").alias("advantage"))


@query("v22_tree_summary", f"""WITH {EDGE} SELECT tree_id, depth, count(*) AS edges, {R('avg(abs(value-parent_value))')} AS mean_abs_advantage,
  count(*) FILTER (value<>parent_value) AS active_edges, {R('avg(value)')} AS mean_value, {R('max(root_value)')} AS root_value FROM edges GROUP BY ALL""")
def tree_summary(spark, path):
    rows = T.update_values(tree_edges(spark, path), "spo")
    return rows.groupBy("tree_id", "depth").agg(
        F.count(F.lit(1)).alias("edges"), r6(F.avg(F.abs("advantage"))).alias("mean_abs_advantage"),
        F.count_if(F.col("advantage") != 0).alias("active_edges"), r6(F.avg("value")).alias("mean_value"),
        r6(F.max("root_value")).alias("root_value"),
    )


@query("v23_tree_prover_advantage", f"WITH {EDGE} SELECT edge_id, {R('(1-pow(1-value,4))-(1-pow(1-parent_value,4))')} AS prover_advantage FROM edges")
def tree_prover(spark, path):
    return T.prover_advantage(tree_edges(spark, path)).select("edge_id", r6("prover_advantage").alias("prover_advantage"))


@query("v24_child_advantage", f"""WITH {VALUES} SELECT c.node_id, CASE WHEN NOT ends_with(p.text,'7') THEN {R('c.value-p.value')} END AS advantage
  FROM valued c JOIN valued p ON c.parent_id=p.node_id""")
def child_advantage(spark, path):
    rows = T.child_advantages(valued(spark, path), F.col("text").endswith("7"))
    return rows.select("node_id", r6("advantage").alias("advantage"))


PATHS = VALUES + """, up AS (SELECT v.tree_id, v.node_id AS leaf_id, v.depth, CASE v.depth
     WHEN 3 THEN [struct_pack(k:=a.node_id,s:=a.value,a:=NULL::DOUBLE,w:=8.0::DOUBLE), struct_pack(k:=b.node_id,s:=b.value,a:=b.value-a.value,w:=4.0::DOUBLE), struct_pack(k:=c.node_id,s:=c.value,a:=c.value-b.value,w:=2.0::DOUBLE), struct_pack(k:=v.node_id,s:=v.value,a:=v.value-c.value,w:=1.0::DOUBLE)]
     WHEN 2 THEN [struct_pack(k:=a.node_id,s:=a.value,a:=NULL::DOUBLE,w:=8.0::DOUBLE), struct_pack(k:=b2.node_id,s:=b2.value,a:=b2.value-a.value,w:=4.0::DOUBLE), struct_pack(k:=v.node_id,s:=v.value,a:=v.value-b2.value,w:=2.0::DOUBLE)] END AS chain
   FROM valued v LEFT JOIN v2 c ON v.depth=3 AND c.node_id=v.parent_id LEFT JOIN v1 b ON b.node_id=c.parent_id LEFT JOIN v1 b2 ON v.depth=2 AND b2.node_id=v.parent_id
     JOIN v0 a ON a.tree_id=v.tree_id WHERE v.n_children=0 AND v.depth>=2)"""


def tree_paths(spark, path):
    return T.paths(valued(spark, path), depth=3, branch_factor=2)


@query("p17_paths", f"""WITH {PATHS} SELECT tree_id, leaf_id, depth, array_to_string([x.k FOR x IN chain],'>') AS route,
  {R('list_sum([x.w FOR x IN chain])')} AS weights FROM up""")
def paths(spark, path):
    total = F.aggregate("chain", F.lit(0.0), lambda s, x: s + x["weight"])
    return tree_paths(spark, path).select(
        "tree_id", "leaf_id", "depth", F.array_join(F.transform("chain", lambda x: x["node_id"]), ">").alias("route"), r6(total).alias("weights")
    )


@query("p17_repeated_early_paths", f"""WITH {PATHS} SELECT depth, count(*) AS leaves, sum(CASE depth WHEN 3 THEN 1 ELSE 2 END)::BIGINT AS rows_listed FROM up GROUP BY 1""")
def repeated(spark, path):
    rows = T.paths(valued(spark, path), depth=3, branch_factor=2, repeat_early=True)
    return rows.groupBy("depth").agg(F.count_if(F.col("copy") == 1).alias("leaves"), F.count(F.lit(1)).alias("rows_listed"))


@query("f06_path_filters", f"""WITH {PATHS} SELECT tree_id, count(*) AS none, count(*) FILTER (chain[-1].s=1) AS successful, count(*) FILTER (chain[2].s>0) AS first_step_positive,
  count(*) FILTER (chain[-1].s>0) AS last_score_positive, count(*) FILTER (chain[-1].s=0) AS last_score_zero, count(*) FILTER (chain[-1].a>0) AS last_advantage_positive FROM up GROUP BY 1""")
def path_filters(spark, path):
    c = F.col("chain")
    return tree_paths(spark, path).groupBy("tree_id").agg(*[F.count_if(f(c)).alias(n) for n, f in PATH_FILTERS.items()])


REWRITE_SQL = {
    "cut_zero_tail": "list_slice(chain,1,list_max([CASE WHEN i>1 AND abs(x.a)>=1e-6 THEN i ELSE 1 END FOR x, i IN chain]))",
    "first_step_only": "list_slice(chain,1,2)",
    "cut_at_first_negative": "list_slice(chain,1,list_min([CASE WHEN i>1 AND x.a<0 THEN i-1 ELSE len(chain) END FOR x, i IN chain]))",
}


@query("w06_path_rewrites", f"""WITH {PATHS}, z AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in REWRITE_SQL.items())}, len(chain) AS n FROM up),
  o AS (SELECT leaf_id, {", ".join(f"len({k}) AS {k}_n, coalesce(list_sum([x.a FOR x IN {k}]),0.0) AS {k}_a" for k in REWRITE_SQL)},
   list_sum([CASE WHEN x.a IS NOT NULL THEN 1.0 END FOR x IN chain]) AS advantage_one_a, list_sum([CASE WHEN x.a=0 THEN 0.05 ELSE x.a END FOR x IN chain]) AS zero_to_epsilon_a,
   list_sum([CASE WHEN x.a<0 THEN 0.0 ELSE x.a END FOR x IN chain]) AS negative_to_zero_a, chain[-1].s AS inner_score_zero_s, chain[-1].a AS inner_advantage_zero_a,
   list_sum([CASE WHEN i>1 THEN x.s END FOR x, i IN chain]) AS advantage_from_score_a, list_sum([x.a*x.w FOR x IN chain]) AS importance_weighted_a,
   list_sum([CASE WHEN i=n THEN 1.0 ELSE x.a END FOR x, i IN chain]) AS last_advantage_one_a FROM z)
  SELECT leaf_id, {", ".join(f"{k}_n::INT AS {k}_n" for k in REWRITE_SQL)}, {", ".join(f"{R(k + '_a')} AS {k}_a" for k in [*REWRITE_SQL, "advantage_one", "zero_to_epsilon", "negative_to_zero", "inner_advantage_zero", "advantage_from_score", "importance_weighted", "last_advantage_one"])},
   {R('inner_score_zero_s')} AS inner_score_zero_s FROM o""")
def path_rewrites(spark, path):
    cut = set(REWRITE_SQL)
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, x: s + F.coalesce(x[f], F.lit(0.0)))
    c = F.col("chain")
    cols = []
    for name, fn in PATH_REWRITES.items():
        new = fn(c)
        if name in cut:
            cols.append(F.size(new).alias(f"{name}_n"))
        field = "score" if name == "inner_score_zero" else "advantage"
        cols.append(r6(total(new, field)).alias(f"{name}_{field[0]}"))
    return tree_paths(spark, path).select("leaf_id", *cols)


@query("w03_unique_paths", f"WITH {PATHS}, u AS (SELECT DISTINCT tree_id, array_to_string([x.k FOR x IN chain],'>') FROM up) SELECT tree_id, count(*) AS n FROM u GROUP BY 1")
def unique_paths(spark, path):
    twice = materialise(tree_paths(spark, path), "paths")
    return T.unique_paths(twice.unionByName(twice)).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"))


@query("w04_top_share_paths", f"""WITH {PATHS}, s AS (SELECT tree_id, leaf_id, round(list_sum([x.a FOR x IN chain])/(len(chain)-1),9) AS score FROM up),
  r AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY score DESC, md5(leaf_id), leaf_id) AS rn, count(*) OVER (PARTITION BY tree_id) AS n FROM s)
  SELECT tree_id, leaf_id, {R('score')} AS score FROM r WHERE rn<=greatest(floor(n*0.2::DOUBLE),1)""")
def top_share(spark, path):
    return T.top_share(materialise(tree_paths(spark, path), "paths"), 0.2).select("tree_id", "leaf_id", r6("path_score").alias("score"))


@query("w05_sampled_paths", f"""WITH {PATHS}, r AS (SELECT tree_id, leaf_id, row_number() OVER (PARTITION BY tree_id ORDER BY md5('7|'||leaf_id), leaf_id) AS rn FROM up)
  SELECT tree_id, leaf_id FROM r WHERE rn<=16""")
def sampled(spark, path):
    return T.sample_paths(tree_paths(spark, path), 16, seed=7).select("tree_id", "leaf_id")


@query("s08_flatten_trees", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)-1 AS i FROM lineitem),
  o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)-1 AS i FROM orders)
  SELECT c_custkey AS tree_id, 'c'||c_custkey AS node_id, NULL::VARCHAR AS parent_id, 0 AS depth, '0' AS walk, NULL::DOUBLE AS reward FROM customer
  UNION ALL SELECT o_custkey, 'o'||o_orderkey, 'c'||o_custkey, 1, '0.'||i, NULL FROM o
  UNION ALL SELECT o_custkey, 'l'||o_orderkey||'-'||l.i, 'o'||o_orderkey, 2, '0.'||o.i||'.'||l.i, l_quantity FROM l JOIN o ON l_orderkey=o_orderkey""")
def flatten(spark, path):
    return T.flatten_trees(tree_documents(spark, path), depth=2).select(
        "tree_id", "node_id", "parent_id", "depth", F.array_join(F.col("pre_order").cast("array<string>"), ".").alias("walk"), "reward"
    )


def tree_documents(spark, path):
    """Nested documents, one per customer; a document is one tree, bounded by the tree shape of a run."""
    from pyspark.sql import Window

    seq = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = views.table(spark, path, "lineitem").select(
        "l_orderkey", (F.row_number().over(seq) - 1).alias("i"), F.col("l_quantity").alias("q"), "l_returnflag"
    )
    leaf = F.struct("i", F.struct(
        F.concat(F.lit("l"), F.col("l_orderkey"), F.lit("-"), F.col("i")).alias("id"), F.col("l_returnflag").alias("text"),
        F.col("q").alias("reward"), F.lit("stop").alias("finish_reason"),
    ).alias("n"))
    kids = line.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(leaf)), lambda x: x["n"]).alias("children"))
    orders = views.table(spark, path, "orders").join(kids, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    mid = F.struct("o_orderkey", F.struct(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("text"), F.col("children").alias("children")).alias("n"))
    top = orders.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(mid)), lambda x: x["n"]).alias("children"))
    cust = views.table(spark, path, "customer").join(top, F.col("o_custkey") == F.col("c_custkey"), "left")
    doc = F.to_json(F.struct(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("text"), F.col("children")))
    return cust.select(F.col("c_custkey").alias("tree_id"), doc.alias("doc"))


def order_chains(spark, path):
    """Documents as deep as a customer has orders: each order holds a graded leaf and the next order. Every 50th is cut off."""
    o = views.table(spark, path, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", F.floor("o_totalprice").alias("r"))), asc=False).alias("o"))
    key = lambda x: x["o_orderkey"].cast("string")
    leaf = lambda x: F.concat(F.lit('{"id":"l'), key(x), F.lit('","reward":'), x["r"].cast("string"), F.lit("}"))
    node = lambda acc, x: F.concat(F.lit('{"id":"o'), key(x), F.lit('","text":"'), x["o_orderpriority"], F.lit('","children":['), leaf(x), F.when(acc == "", "").otherwise(F.concat(F.lit(","), acc)), F.lit("]}"))
    chain = F.aggregate("o", F.lit(""), node)
    doc = F.concat(F.lit('{"id":"c'), F.col("o_custkey"), F.lit('","children":['), chain, F.lit("]}"))
    return o.select(F.col("o_custkey").alias("tree_id"), F.when(F.col("o_custkey") % 50 == 0, F.substring(doc, 1, 40)).otherwise(doc).alias("doc"))


@query("s08_any_depth", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS up FROM orders WHERE o_custkey%50<>0)
  SELECT DISTINCT o_custkey AS tree_id, 'c'||o_custkey AS node_id, NULL::VARCHAR AS parent_id, 0 AS depth, '0' AS walk, NULL::VARCHAR AS text, NULL::DOUBLE AS reward FROM o
  UNION ALL SELECT o_custkey, 'o'||o_orderkey, CASE WHEN up IS NULL THEN 'c'||o_custkey ELSE 'o'||up END, i::INT, '0.0'||repeat('.1', (i-1)::INT), o_orderpriority, NULL FROM o
  UNION ALL SELECT o_custkey, 'l'||o_orderkey, 'o'||o_orderkey, i::INT+1, '0.0'||repeat('.1', (i-1)::INT)||'.0', NULL, floor(o_totalprice)::DOUBLE FROM o""")
def any_depth(spark, path):
    nodes, _ = T.flatten_any_depth(order_chains(spark, path))
    return nodes.select("tree_id", "node_id", "parent_id", "depth", F.array_join(F.col("pre_order").cast("array<string>"), ".").alias("walk"), "text", "reward")


@query("s08_set_aside", "SELECT DISTINCT o_custkey AS tree_id, 'broken JSON' AS reason FROM orders WHERE o_custkey%50=0")
def set_aside(spark, path):
    _, bad = T.flatten_any_depth(order_chains(spark, path))
    return bad.select("tree_id", "reason")


BLEU = """w AS (SELECT conv_id AS parent, turn AS i, [x FOR x IN string_split_regex(text,'\\s+') IF x<>''] AS w FROM conversations),
  g AS (SELECT parent, i, n, array_to_string(list_slice(w,p,p+n-1),' ') AS g, count(*) AS c FROM (SELECT *, unnest(range(1,len(w)-n+2)) AS p FROM w, range(1,5) t(n)) GROUP BY ALL),
  m AS (SELECT a.parent, a.n, sum(least(a.c,b.c)) AS m FROM g a JOIN g b ON a.parent=b.parent AND a.n=b.n AND a.g=b.g AND a.i<b.i GROUP BY ALL),
  p AS (SELECT a.parent, n, sum(greatest(len(a.w)-n+1,0)) AS t, sum(len(a.w)) AS cand, sum(len(b.w)) AS ref FROM w a JOIN w b ON a.parent=b.parent AND a.i<b.i, range(1,5) s(n) GROUP BY ALL),
  bl AS (SELECT p.parent, CASE WHEN min(coalesce(m,0)/nullif(t,0))>0 AND count(nullif(t,0))=4 THEN exp(avg(ln(m/t)))*CASE WHEN any_value(cand/ref)>1 THEN 1.0 ELSE exp(1-1/any_value(cand/ref)) END ELSE 0.0 END AS bleu
    FROM p LEFT JOIN m ON m.parent=p.parent AND m.n=p.n GROUP BY 1)"""


@query("a18_sibling_bleu", f"WITH {BLEU} SELECT parent, {R('bleu')} AS bleu FROM bl")
def sibling_bleu(spark, path):
    texts = views.messages(spark, path).select(F.col("conv_id").alias("parent"), F.col("turn").alias("i"), "text")
    return T.sibling_bleu(texts).select("parent", r6("bleu").alias("bleu"))


@query("a18_bleu_summary", f"""WITH {BLEU}, d AS (SELECT bl.*, len AS depth, count(*) OVER (PARTITION BY len) AS dn FROM bl JOIN (SELECT conv_id, count(*) AS len FROM conversations GROUP BY 1) s ON conv_id=parent)
  SELECT {R('avg(bleu)')} AS mean_bleu, {R('sum(bleu/dn)/count(DISTINCT depth)')} AS depth_normalised, count(*) AS nodes FROM d""")
def bleu_summary(spark, path):
    msgs = views.messages(spark, path)
    b = T.sibling_bleu(msgs.select(F.col("conv_id").alias("parent"), F.col("turn").alias("i"), "text"))
    depth = msgs.groupBy(F.col("conv_id").alias("parent")).agg(F.count(F.lit(1)).alias("depth"))
    per = b.join(depth, "parent").groupBy("depth").agg(F.avg("bleu").alias("m"), F.sum("bleu").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        r6(F.sum("s") / F.sum("n")).alias("mean_bleu"), r6(F.avg("m")).alias("depth_normalised"), F.sum("n").alias("nodes")
    )


def acting(spark, path):
    first = F.substring("text", 1, 1)
    act = F.when(F.col("depth") < 3, "expand").when(first == "1", "share").when(first == "5", "prune").otherwise("expand")
    return views.nodes(spark, path).withColumn("action", act)


@query("a19_action_counts", f"""WITH {NODES}, a AS (SELECT *, CASE WHEN depth<3 THEN 'expand' WHEN text[1]='1' THEN 'share' WHEN text[1]='5' THEN 'prune' ELSE 'expand' END AS action FROM nodes)
  SELECT tree_id, depth, count(*) AS n, count(*) FILTER (action='expand') AS expand, count(*) FILTER (action='share') AS share, count(*) FILTER (action='prune') AS prune,
   {R("avg((action='share')::INT)")} AS share_rate, {R("avg((action='prune')::INT)")} AS prune_rate FROM a GROUP BY GROUPING SETS ((tree_id),(tree_id,depth))""")
def action_counts(spark, path):
    out = T.action_counts(acting(spark, path))
    return out.withColumns({c: r6(c) for c in ("share_rate", "prune_rate")})


@query("a20_budget_stats", f"""WITH {VALUES}, a AS (SELECT *, n_children+length(text)%3 AS k, CASE depth WHEN 0 THEN 5 WHEN 1 THEN 60 WHEN 2 THEN 10 ELSE 0 END AS req FROM valued WHERE depth<3)
  SELECT tree_id, depth, sum(n_children)::BIGINT AS built, sum(k)::BIGINT AS allocated, sum(req)::BIGINT AS requested, count(*) AS parents, {R('avg(k)')} AS k_mean, min(k)::BIGINT AS k_min, max(k)::BIGINT AS k_max,
   {R('stddev_pop(k)')} AS k_std, {R('sum(n_children)/sum(k)')} AS built_to_allocated, {R('sum(n_children)/sum(req)')} AS built_to_requested FROM a GROUP BY GROUPING SETS ((tree_id),(tree_id,depth))""")
def budget_stats(spark, path):
    v = valued(spark, path).withColumn("allocated_k", F.when(F.col("depth") < 3, F.col("n_children") + F.length("text") % 3))
    out = T.budget_stats(v, {0: 5, 1: 60, 2: 10})
    return out.withColumns({c: r6(c) for c in ("k_mean", "k_std", "built_to_allocated", "built_to_requested")})


@query("a22_child_reward_variance", f"""WITH {VALUES}, x AS (SELECT parent_id, var_pop(value) AS v FROM valued WHERE parent_id IS NOT NULL GROUP BY 1)
  SELECT node_id, depth, {R('v')} AS child_variance, n_children FROM valued LEFT JOIN x ON x.parent_id=node_id""")
def child_variance(spark, path):
    v = valued(spark, path)
    var = F.when(F.col("n_children") > 0, F.col("value_std") * F.col("value_std"))
    return v.select("node_id", "depth", r6(var).alias("child_variance"), "n_children")


@query("a24_group_metrics", f"""WITH {NODES}, e AS (SELECT *, parent_id[1] AS queue FROM nodes WHERE parent_id IS NOT NULL), p AS (SELECT tree_id, parent_id, count(*) AS k FROM e GROUP BY ALL),
  t AS (SELECT tree_id, count(*) AS parents FROM p GROUP BY 1), q AS (SELECT tree_id, sum(q) AS q FROM (SELECT tree_id, queue, count(DISTINCT parent_id) AS q FROM e GROUP BY ALL) GROUP BY 1),
  s AS (SELECT 1.0/(parents*k) AS w, k FROM e JOIN p USING (tree_id, parent_id) JOIN t USING (tree_id))
  SELECT {R('(SELECT avg(parents) FROM t)')} AS parents_per_tree, {R('(SELECT avg(k) FROM p)')} AS children_mean, {R('(SELECT stddev_pop(k) FROM p)')} AS children_std,
   {R('(SELECT avg(q/parents) FROM q JOIN t USING (tree_id))')} AS queue_mass, {R('(SELECT corr(w,k) FROM s)')} AS weight_branch_corr, (SELECT count(*) FROM t) AS trees""")
def group_metrics(spark, path):
    e = views.nodes(spark, path).where("parent_id IS NOT NULL").withColumn("queue", F.substring("parent_id", 1, 1))
    out = T.group_metrics(e)
    return out.select(*[F.col(c) if c == "trees" else r6(c).alias(c) for c in out.columns])


@query("a36_tree_stats", f"""WITH {VALUES} SELECT tree_id, count(*) AS nodes, count(*) FILTER (n_children=0) AS leaves, max(depth) AS max_depth,
  {R('max(value) FILTER (depth=0)')} AS root_value, {R('max(value_std) FILTER (depth=0)')} AS root_std FROM valued GROUP BY 1""")
def tree_stats(spark, path):
    out = T.tree_stats(valued(spark, path))
    return out.withColumns({c: r6(c) for c in ("root_value", "root_std")})


@query("a36_depth_stats", f"WITH {VALUES} SELECT tree_id, depth, count(*) AS n, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std FROM valued GROUP BY ALL")
def depth_stats(spark, path):
    out = T.depth_stats(valued(spark, path))
    return out.withColumns({c: r6(c) for c in ("mean", "std")})


@query("f07_zero_advantage", f"""WITH {EDGE}, m AS (SELECT *, value-parent_value AS adv, (1-pow(1-value,4))-(1-pow(1-parent_value,4)) AS prover FROM edges)
  SELECT depth, count(*) AS edges, count(*) FILTER (adv<>0) AS by_advantage, count(*) FILTER (round(adv+prover,9)<>0) AS by_pav, count(*) FILTER (text[1]<>'5') AS not_pruned FROM m GROUP BY 1""")
def zero_advantage(spark, path):
    e = T.prover_advantage(T.update_values(tree_edges(spark, path)))
    return e.groupBy("depth").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("advantage") != 0).alias("by_advantage"),
        F.count_if(F.round(F.col("advantage") + F.col("prover_advantage"), 9) != 0).alias("by_pav"),
        F.count_if(F.substring("text", 1, 1) != "5").alias("not_pruned"),
    )


@query("p20_parse_tree_id", """SELECT o_orderkey AS k, 'snap'||(o_orderkey%7) AS snapshot, (o_orderkey%30)::BIGINT AS iteration, o_custkey::VARCHAR AS question FROM orders""")
def parse_tree_id(spark, path):
    from ..functions.text import parse_tree_id

    o = views.table(spark, path, "orders")
    ident = F.concat(
        F.lit("snap"), F.pmod("o_orderkey", F.lit(7)), F.lit("|iter:"), F.pmod("o_orderkey", F.lit(30)), F.lit("|q:"), F.col("o_custkey"), F.lit("|"), F.col("o_orderkey")
    )
    return o.select(F.col("o_orderkey").alias("k"), *parse_tree_id(ident))


@query("p19_edge_identity", f"""WITH {EDGE} SELECT depth, count(*) AS edges, count(DISTINCT edge_id) AS distinct_ids, count(*) FILTER (text[1]='1' AND depth=3) AS rejected FROM edges GROUP BY 1""")
def edge_identity(spark, path):
    from ..operators.quality import normalise_edges

    e = tree_edges(spark, path)
    wrong = (F.substring("text", 1, 1) == "1") & (F.col("depth") == 3)
    supplied = e.withColumn("edge_id", F.when(wrong, F.lit("other")).when(F.col("depth") == 1, F.col("edge_id")))
    ok, bad = normalise_edges(supplied, "s0")
    all_ = ok.withColumn("bad", F.lit(0)).unionByName(bad.drop("reason").withColumn("bad", F.lit(1)))
    return all_.groupBy("depth").agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct("derived_id").alias("distinct_ids"), F.sum("bad").alias("rejected")
    )
