"""Retrieval and lookup queries."""

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import lsh as LSH
from ..operators import retrieval as RT
from ..sources import views
from .registry import R, ROLLOUTS, TOKENS, query


def vectors(spark, path):
    """Corpus: all embeddings. Queries: the mean vector of every label, derived from the whole table."""
    e = views.table(spark, path, "embeddings")
    corpus = e.select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    dims = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    q = dims.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda v: v["m"]).alias("vector"))
    return corpus, q


VEC = """d AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1,65) t(i) GROUP BY ALL), q AS (SELECT label::BIGINT AS query_id, list(m ORDER BY i) AS v FROM d GROUP BY 1),
  s AS (SELECT query_id, vec_id AS doc_id, list_dot_product(v, embedding::DOUBLE[]) AS score FROM q, embeddings), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@query("j10_inner_product_top_k", f"WITH {VEC} SELECT query_id, doc_id, {R('score')} AS score, rank::INT AS rank FROM t WHERE rank<=10")
def top_k(spark, path):
    corpus, q = vectors(spark, path)
    return RT.inner_product_top_k(q, corpus, 10).select("query_id", "doc_id", r6("score").alias("score"), "rank")


def stated(spark, path):
    """Every vector is the corpus; those whose id is divisible by 50 ask."""
    corpus = views.table(spark, path, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return corpus, corpus.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")


def approximate(spark, path):
    corpus, q = stated(spark, path)
    projection = LSH.fit(corpus)
    probes = LSH.needed_probes(q, corpus, 10, projection)
    return LSH.approximate_top_k(q, LSH.write_index(corpus, projection), corpus, 10, projection, probes)


@query("j10_approximate_top_k")
def approximate_top_k(spark, path):
    return approximate(spark, path).select("query_id", "doc_id", r6("score").alias("score"), "rank")


@query("j10_approximate_recall", "SELECT count(*) AS queries, sum(least((SELECT count(*) FROM embeddings), 10))::BIGINT AS pairs, true AS enough FROM embeddings WHERE vec_id%50=0")
def approximate_recall(spark, path):
    """Recall of the index against the exact search over all rows: 0.9 at least."""
    corpus, q = stated(spark, path)
    row = LSH.recall(approximate(spark, path), RT.inner_product_top_k(q, corpus, 10))
    return row.select("queries", "pairs", (F.col("recall") >= 0.9).alias("enough"))


BM = """w AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(text),'[^\\p{L}\\p{N}]+') IF x<>''] AS w FROM documents), st AS (SELECT avg(len(w)) AS a, count(*) AS n FROM w),
  p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  q AS (SELECT item_id AS query_id, unnest(list_distinct([x FOR x IN string_split_regex(lower(text),'[^\\p{L}\\p{N}]+') IF x<>''])) AS term FROM benchmark),
  s AS (SELECT query_id, doc_id, round(sum(ln(1+(n-df+0.5)/(df+0.5))*tf/(tf+0.9*(1-0.4+0.4*dl/a))),9) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
  t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@query("j11_bm25_top_k", f"WITH {BM} SELECT query_id, doc_id, {R('score')} AS score, rank::INT AS rank FROM t WHERE rank<=10")
def bm25(spark, path):
    q = views.table(spark, path, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return RT.bm25_top_k(q, views.texts(spark, path).select("doc_id", "text"), 10).select("query_id", "doc_id", r6("score").alias("score"), "rank")


@query("j12_hit_texts", f"WITH {BM} SELECT query_id, t.doc_id, rank::INT AS rank, n_chars, lang FROM t JOIN documents d ON d.doc_id=t.doc_id WHERE rank<=3")
def hit_texts(spark, path):
    q = views.table(spark, path, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = views.texts(spark, path)
    hits = RT.bm25_top_k(q, docs.select("doc_id", "text"), 3)
    return RT.lookup(hits, docs.select("doc_id", "n_chars", "lang")).select("query_id", "doc_id", "rank", "n_chars", "lang")


@query("j14_nearest_key", f"""WITH k AS (SELECT min(p_partkey) AS lk, max(p_partkey) AS hk, p_retailprice AS x FROM part GROUP BY 3), p AS (SELECT o_orderkey AS probe_id, o_totalprice/250 AS x FROM orders),
  lo AS (SELECT probe_id, p.x, k.hk AS id, k.x AS kx FROM p ASOF LEFT JOIN k ON p.x>=k.x), hi AS (SELECT probe_id, p.x, k.lk AS id, k.x AS kx FROM p ASOF LEFT JOIN k ON p.x<=k.x)
  SELECT probe_id, CASE WHEN hi.id IS NULL OR lo.x-lo.kx<hi.kx-lo.x THEN lo.id ELSE hi.id END AS key_id, {R('CASE WHEN hi.id IS NULL OR lo.x-lo.kx<hi.kx-lo.x THEN lo.x-lo.kx ELSE hi.kx-lo.x END')} AS distance FROM lo JOIN hi USING (probe_id)""")
def nearest(spark, path):
    probes = views.table(spark, path, "orders").select(F.col("o_orderkey").alias("probe_id"), (F.col("o_totalprice") / 250).alias("x"))
    keys = views.table(spark, path, "part").select(F.col("p_partkey").alias("key_id"), F.col("p_retailprice").alias("x"))
    return RT.nearest_key(probes, keys).select("probe_id", "key_id", r6("distance").alias("distance"))


@query("j06_unique_requests", "SELECT l_orderkey*100+l_linenumber AS request_id, min(l_orderkey*100+l_linenumber) OVER (PARTITION BY l_quantity, l_discount, l_tax) AS first_id FROM lineitem")
def unique_requests(spark, path):
    req = views.table(spark, path, "lineitem").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("request_id"), F.concat_ws("|", "l_quantity", "l_discount", "l_tax").alias("query")
    )
    return RT.unique_requests(req)


@query("j05_values_to_states", f"WITH {TOKENS} SELECT t.rollout_id, pos, CASE WHEN o_orderstatus<>'P' THEN {R('ln(o_totalprice)')} END AS estimate FROM tokens t JOIN orders ON o_orderkey=rollout_id")
def values_to_states(spark, path):

    done = views.table(spark, path, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("rollout_id"), r6(F.log("o_totalprice")).alias("estimate"))
    return RT.attach_values(views.tokens(spark, path).select("rollout_id", "pos"), done, ["rollout_id"])


@query("j16_pending_work", f"WITH {ROLLOUTS} SELECT rollout_id FROM rollouts WHERE rollout_id NOT IN (SELECT l_orderkey FROM lineitem)")
def pending(spark, path):
    done = views.table(spark, path, "lineitem").select(F.col("l_orderkey").alias("rollout_id"))
    return RT.pending(views.rollouts(spark, path).select("rollout_id"), done, ["rollout_id"])


@query("j09_tree_audit", """WITH f AS (SELECT o_custkey AS problem, o_orderkey AS segment, ln(o_totalprice) AS v, o_orderpriority FROM orders), p AS (SELECT problem, segment, CASE WHEN o_orderpriority[1]='1' THEN 'share' WHEN o_orderpriority[1]='5' THEN 'prune' ELSE 'expand' END AS action, min(segment) OVER (PARTITION BY problem) AS target FROM f)
  SELECT count(*) FILTER (action='share') AS shares, count(*) FILTER (action='share' AND abs(a.v-b.v)>1.0) AS false_shares, count(*) FILTER (action='prune') AS prunes, count(*) FILTER (action='prune' AND a.v>0) AS false_prunes, count(*) FILTER (a.v IS NULL) AS unmatched
  FROM p LEFT JOIN f a ON a.problem=p.problem AND a.segment=p.segment LEFT JOIN f b ON b.problem=p.problem AND b.segment=p.target""")
def tree_audit(spark, path):
    from ..operators.spread import attach_stats

    full = views.rollouts(spark, path).select(F.col("uid").alias("problem"), F.col("rollout_id").alias("segment"), F.col("score").alias("value"), "pred")
    act = F.when(F.substring("pred", 1, 1) == "1", "share").when(F.substring("pred", 1, 1) == "5", "prune").otherwise("expand")
    pruned = attach_stats(full.select("problem", "segment", act.alias("action")), ["problem"], {"target": F.min("segment")}, ["segment"])
    return RT.audit(pruned, full.drop("pred"), 1.0)


@query("j01_parent_texts", "SELECT 'o'||o_orderkey AS node_id, c_name AS parent_text, o_orderpriority AS text FROM orders LEFT JOIN customer ON c_custkey=o_custkey UNION ALL SELECT 'c'||c_custkey, n_name, c_name FROM customer JOIN nation ON n_nationkey=c_nationkey UNION ALL SELECT 'n'||n_nationkey, r_name, n_name FROM nation JOIN region ON r_regionkey=n_regionkey")
def parent_texts(spark, path):
    from .trees import valued
    from ..operators.trees import with_parent

    return with_parent(valued(spark, path), {"text": "parent_text"}).select("node_id", "parent_text", "text")
