"""Named queries with their plain-SQL twins."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is the equivalent statement another engine can run on the same tables."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def R(expr: str) -> str:
    """SQL twin of functions.numeric.r6."""
    return f"(round(CAST({expr} AS DOUBLE),6)+0.0)"


def U(expr: str) -> str:
    """SQL twin of functions.numeric.uniform over an md5 text expression."""
    return f"(CAST(('0x'||substr({expr},1,8))::BIGINT AS DOUBLE)/CAST(4294967296 AS DOUBLE))"


# SQL twins of sources.views
ROLLOUTS = """rollouts AS (SELECT o_custkey AS uid, o_orderkey AS rollout_id, ln(o_totalprice) AS score,
  (o_orderstatus='F')::INT AS correct, o_orderpriority AS pred,
  CAST(floor(o_totalprice/1000) AS BIGINT)+1 AS n_tokens, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS arrival FROM orders)"""
SOURCED = ROLLOUTS + """, sourced AS (SELECT r.*, c_mktsegment AS data_source FROM rollouts r
  JOIN customer ON c_custkey=uid)"""
TOKENS = """tokens AS (SELECT l_orderkey AS rollout_id, row_number() OVER w - 1 AS pos,
  -(l_discount+sqrt(l_quantity)/50) AS old_lp, -(l_tax+sqrt(l_extendedprice)/9000) AS rollout_lp,
  -(l_tax+sqrt(l_linenumber)/50) AS ref_lp, l_quantity/50 AS value,
  CASE WHEN lead(l_orderkey) OVER w IS NULL THEN ln(l_extendedprice) ELSE 0.0 END AS reward,
  (l_returnflag<>'R')::INT AS mask FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))"""
NODES = """cust AS (SELECT c_custkey, c_name, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey=n_nationkey),
nodes AS (SELECT r_regionkey AS tree_id, 'r'||r_regionkey AS node_id, NULL::VARCHAR AS parent_id, 0 AS depth,
    r_name AS text, NULL::DOUBLE AS reward FROM region
  UNION ALL SELECT n_regionkey, 'n'||n_nationkey, 'r'||n_regionkey, 1, n_name, NULL FROM nation
  UNION ALL SELECT n_regionkey, 'c'||c_custkey, 'n'||c_nationkey, 2, c_name, NULL FROM cust
  UNION ALL SELECT n_regionkey, 'o'||o_orderkey, 'c'||o_custkey, 3, o_orderpriority, (o_orderstatus='F')::INT::DOUBLE
    FROM orders JOIN cust ON o_custkey=c_custkey)"""
PILOTS = """pilots AS (SELECT l_orderkey AS node_id, row_number() OVER w - 1 AS pilot, l_quantity/10 AS level,
  l_discount*10 AS slope, l_returnflag='R' AS finished, l_extendedprice/100000 AS reward FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))"""
SUPPORT = PILOTS + """, support AS (SELECT a.node_id, a.pilot, b.pilot AS support, b.pilot AS origin,
  -(abs(a.level-b.level)+a.slope) AS logp FROM pilots a JOIN pilots b USING (node_id)
  WHERE NOT a.finished AND NOT b.finished)"""
ALLOC = """alloc AS (SELECT c_nationkey AS queue, c_custkey AS seq, 'n'||lpad(c_custkey::VARCHAR,12,'0') AS node_id,
  4::BIGINT AS default_k, (1+c_custkey%8)::BIGINT AS predicted_k, pow(greatest(c_acctbal,0.0)/9999.0,2.0) AS c FROM customer)"""
EDGES = """redges AS (SELECT event_id AS edge_id, user_id AS question_id,
  date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS iteration,
  CASE WHEN event_type='view' THEN 0.0 ELSE value/100 END AS advantage, event_type AS kind, ts FROM events)"""
