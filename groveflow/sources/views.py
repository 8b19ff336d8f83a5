"""Adapter views: the given tables read as prompts, rollouts, tokens, trees, pilots and queue events."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.spread import in_tasks


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def rollouts(spark, path) -> DataFrame:
    """One sampled response per order; the prompt is the customer."""
    return table(spark, path, "orders").select(
        F.col("o_custkey").alias("uid"),
        F.col("o_orderkey").alias("rollout_id"),
        F.log("o_totalprice").alias("score"),
        (F.col("o_orderstatus") == "F").cast("int").alias("correct"),
        F.col("o_orderpriority").alias("pred"),
        (F.floor(F.col("o_totalprice") / 1000) + 1).alias("n_tokens"),
        F.unix_date(F.to_date("o_orderdate")).alias("arrival"),
    )


def rollouts_by_source(spark, path) -> DataFrame:
    sources = table(spark, path, "customer").select(
        F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("data_source")
    )
    return rollouts(spark, path).join(sources, "uid")


def lines(spark, path) -> DataFrame:
    """Order lines, spread by order: the lines of an order are one task's, and a task has about a million of them."""
    return in_tasks(table(spark, path, "lineitem"), ["l_orderkey"])


def tokens(spark, path) -> DataFrame:
    """One token per order line. A sequence is bounded by the response length limit, so the window
    partition is one response."""
    seq = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    q = F.col("l_quantity")
    return lines(spark, path).select(
        F.col("l_orderkey").alias("rollout_id"),
        (F.row_number().over(seq) - 1).cast("bigint").alias("pos"),
        (-(F.col("l_discount") + F.sqrt(q) / 50)).alias("old_lp"),
        (-(F.col("l_tax") + F.sqrt("l_extendedprice") / 9000)).alias("rollout_lp"),
        (-(F.col("l_tax") + F.sqrt("l_linenumber") / 50)).alias("ref_lp"),
        (q / 50).alias("value"),
        F.when(F.lead("l_orderkey").over(seq).isNull(), F.log("l_extendedprice")).otherwise(0.0).alias("reward"),
        (F.col("l_returnflag") != "R").cast("int").alias("mask"),
    )


def nodes(spark, path) -> DataFrame:
    """Search trees: region - nation - customer - order, graded at the orders."""
    region, nation = table(spark, path, "region"), table(spark, path, "nation")
    customer, orders = table(spark, path, "customer"), table(spark, path, "orders")

    def row(tree, node, parent, depth, text, reward):
        return [
            tree.alias("tree_id"),
            node.alias("node_id"),
            parent.cast("string").alias("parent_id"),
            F.lit(depth).alias("depth"),
            text.alias("text"),
            reward.cast("double").alias("reward"),
        ]

    nul = F.lit(None)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nat = nation.select("n_nationkey", F.col("n_regionkey"))
    cust = customer.join(nat, customer.c_nationkey == nat.n_nationkey)
    owner = cust.select("c_custkey", "n_regionkey")
    leaf = orders.join(owner, orders.o_custkey == owner.c_custkey)
    return (
        region.select(*row(F.col("r_regionkey"), key("r", "r_regionkey"), nul, 0, F.col("r_name"), nul))
        .unionByName(
            nation.select(
                *row(F.col("n_regionkey"), key("n", "n_nationkey"), key("r", "n_regionkey"), 1, F.col("n_name"), nul)
            )
        )
        .unionByName(
            cust.select(
                *row(F.col("n_regionkey"), key("c", "c_custkey"), key("n", "c_nationkey"), 2, F.col("c_name"), nul)
            )
        )
        .unionByName(
            leaf.select(
                *row(
                    F.col("n_regionkey"),
                    key("o", "o_orderkey"),
                    key("c", "o_custkey"),
                    3,
                    F.col("o_orderpriority"),
                    (F.col("o_orderstatus") == "F").cast("double"),
                )
            )
        )
    )


def pilots(spark, path) -> DataFrame:
    """Pilot prefixes of a node: the lines of an order (their number is bounded by the pilot count)."""
    seq = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return lines(spark, path).select(
        F.col("l_orderkey").alias("node_id"),
        (F.row_number().over(seq) - 1).cast("bigint").alias("pilot"),
        (F.col("l_quantity") / 10).alias("level"),
        (F.col("l_discount") * 10).alias("slope"),
        (F.col("l_returnflag") == "R").alias("finished"),
        (F.col("l_extendedprice") / 100000).alias("reward"),
    )


def support_logps(spark, path) -> DataFrame:
    """Likelihood of every continuation under every pilot of the same node (node, pilot, support, logp).

    The continuation k originates from pilot k, hence `origin = support`. Rows per node: pilots squared,
    bounded by the configured pilot count.
    """
    p = pilots(spark, path).where(~F.col("finished"))
    a = p.select("node_id", F.col("pilot").alias("pilot"), F.col("level").alias("la"), F.col("slope").alias("sa"))
    b = p.select("node_id", F.col("pilot").alias("support"), F.col("level").alias("lb"))
    return a.join(b, "node_id").select(
        "node_id",
        "pilot",
        "support",
        F.col("support").alias("origin"),
        (-(F.abs(F.col("la") - F.col("lb")) + F.col("sa"))).alias("logp"),
    )


def alloc_nodes(spark, path) -> DataFrame:
    """Nodes waiting for a branch budget; one flush per 8 customers of a nation in id order."""
    return table(spark, path, "customer").select(
        F.col("c_nationkey").alias("queue"),
        F.col("c_custkey").alias("seq"),
        F.concat(F.lit("n"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("node_id"),
        F.lit(4).cast("bigint").alias("default_k"),
        (F.lit(1) + F.pmod(F.col("c_custkey"), F.lit(8))).cast("bigint").alias("predicted_k"),
        (F.pow(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 9999.0, F.lit(2.0))).alias("c"),
    )


def replay_edges(spark, path) -> DataFrame:
    return table(spark, path, "events").select(
        F.col("event_id").alias("edge_id"),
        F.col("user_id").alias("question_id"),
        F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).alias("iteration"),
        F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value") / 100).alias("advantage"),
        F.col("event_type").alias("kind"),
        F.col("ts"),
    )


def messages(spark, path) -> DataFrame:
    return table(spark, path, "conversations")


def texts(spark, path) -> DataFrame:
    return table(spark, path, "documents")
