"""Search trees as node tables: flattening, value backup, edges, paths, diversity, statistics.

Nodes: tree_id, node_id (unique), parent_id (null at the root), depth, reward (leaves), text. One tree or one
parent may hold a large share of all nodes, so lookups of a parent or root use the salted statistics join and
aggregations are partial.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import best_of_k, sample_key
from ..session import materialise
from .registry import PATH_FILTERS, PATH_REWRITES, PATH_SELECTORS
from .spread import first_k, hash_bucket, join_stats, ranked, running_sum, scalar, value_bucket

CUT_EVERY = 4

# Levels of a document that one table holds.
STEP = 8


def node_schema(depth: int) -> T.StructType:
    """Schema of a nested tree document of bounded depth; deeper children stay JSON text."""
    fields = [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("reward", T.DoubleType()),
        T.StructField("finish_reason", T.StringType()),
    ]
    kids = T.ArrayType(node_schema(depth - 1)) if depth > 0 else T.StringType()
    return T.StructType(fields + [T.StructField("children", kids)])


def flatten_trees(docs: DataFrame, depth: int) -> DataFrame:
    """Node rows from nested JSON documents (tree_id, doc): each is made and parsed once, and its nodes leave in one explode.

    `pre_order` sorts like a stack walk: the child positions from the root. `cut_off` marks nodes whose
    children lie below the schema depth; the caller sends such trees to quarantine or raises the depth.
    """
    def walk(n: Column, parent: Column, pre: Column, d: int) -> Column:
        last = d == depth
        row = F.struct(
            (F.when(n["children"].isNotNull(), F.raise_error(F.lit("a tree is deeper than the schema"))).otherwise(n["id"]) if last else n["id"]).alias("node_id"),
            parent.alias("parent_id"),
            F.lit(d).alias("depth"),
            pre.alias("pre_order"),
            n["text"].alias("text"),
            n["reward"].alias("reward"),
            n["finish_reason"].alias("finish_reason"),
            (n["children"].isNotNull() if last else F.lit(False)).alias("cut_off"),
        )
        return F.array(row) if last else _and_below(row, n["children"], lambda c, i: walk(c, n["id"], F.array_append(pre, i), d + 1))

    parsed = docs.select("tree_id", F.from_json("doc", node_schema(depth)).alias("n"))
    return parsed.select("tree_id", F.inline(walk(F.col("n"), F.lit(None).cast("string"), F.array(F.lit(0)), 0)))


def _and_below(row: Column, children: Column, walk) -> Column:
    """Array of a node's row and those that `walk(child, position)` gives for its children."""
    return F.concat(F.array(row), F.coalesce(F.flatten(F.transform(children, walk)), F.array()))


def flatten_any_depth(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node rows of nested JSON documents (tree_id, doc) of any depth, and the documents that are set aside.

    Documents are parsed once into variants; STEP levels are a table (node columns and, of the lowest level, the children,
    still variants), and the next one explodes those children, until no node has any. The number of jobs is the depth of the
    deepest tree over STEP.
    Nodes: tree_id, node_id, parent_id, depth, pre_order (positions from the root: sorts like a stack walk), text, reward,
    finish_reason; fields of another type are null. Set aside (tree_id, doc, reason): broken JSON, documents that are no
    object, null documents, and trees in which `children` of some node is no list; none of these has node rows.
    """
    parsed = docs.select("tree_id", "doc", F.try_parse_json("doc").alias("v"))
    kind = F.schema_of_variant("v")
    reason = F.when(F.col("doc").isNull(), "no document").when(F.col("v").isNull(), "broken JSON").when(~F.startswith(kind, F.lit("OBJECT")), "no object")
    parsed = materialise(parsed.withColumn("reason", reason).withColumn("row", F.monotonically_increasing_id()), "documents")
    kids = lambda v: F.try_variant_get(v, "$.children", "array<variant>")
    # list or absent; the second look copies no list
    listed = lambda v, below: below.isNotNull() | F.try_variant_get(v, "$.children", "variant").isNull() | F.is_variant_null(F.try_variant_get(v, "$.children", "variant"))

    def walk(v: Column, parent: Column, pre: Column, depth: int, left: int) -> Column:
        fields = {"node_id": ("$.id", "string"), "text": ("$.text", "string"), "reward": ("$.reward", "double"), "finish_reason": ("$.finish_reason", "string")}
        got = {n: F.try_variant_get(v, p, k) for n, (p, k) in fields.items()}

        def nodes(below: Column) -> Column:
            rest = F.lit(None).cast("array<variant>") if left else below
            row = F.struct(parent.alias("parent_id"), F.lit(depth).alias("depth"), pre.alias("pre_order"), *[c.alias(n) for n, c in got.items()], rest.alias("kids"), listed(v, below).alias("listed"))
            return _and_below(row, below, lambda c, i: walk(c, got["node_id"], F.array_append(pre, i), depth + 1, left - 1)) if left else F.array(row)

        return F.transform(F.array(kids(v)), nodes)[0]  # the children, which are copied out of their parent, once

    def level_of(rows: DataFrame, depth: int) -> DataFrame:
        got = rows.select("row", "tree_id", F.inline(walk(F.col("v"), F.col("parent_id"), F.col("pre_order"), depth, STEP - 1)))
        return materialise(got.withColumn("n_kids", F.coalesce(F.size("kids"), F.lit(0))), "level")

    roots = parsed.where("reason IS NULL").select("row", "tree_id", "v", F.lit(None).cast("string").alias("parent_id"), F.array(F.lit(0)).alias("pre_order"))
    levels = [level_of(roots, 0)]
    while not (open_ := levels[-1].where("n_kids > 0")).isEmpty():
        below = open_.select("row", "tree_id", F.col("node_id").alias("parent_id"), "pre_order", F.posexplode("kids").alias("at", "v"))
        levels.append(level_of(below.withColumn("pre_order", F.array_append("pre_order", F.col("at"))), STEP * len(levels)))
    nodes = reduce(DataFrame.unionByName, [x.drop("kids", "n_kids") for x in levels])
    odd = nodes.where("NOT listed").select("row").distinct()
    set_aside = parsed.where("reason IS NOT NULL").select("tree_id", "doc", "reason").unionByName(
        parsed.where("reason IS NULL").join(odd, "row", "left_semi").select("tree_id", "doc", F.lit("children is no list").alias("reason"))
    )
    nodes = nodes.join(odd, "row", "left_anti").select("tree_id", "node_id", "parent_id", "depth", "pre_order", "text", "reward", "finish_reason")
    return nodes, set_aside


def max_depth(nodes: DataFrame) -> int:
    """Depth of the deepest node: one number, bounded by the tree shape of the run."""
    return nodes.agg(F.max("depth")).first()[0]


def back_up_values(nodes: DataFrame, depth: int | None = None, weight: str | None = None) -> DataFrame:
    """Inner value = mean of the children's values (population deviation alongside), level by level.

    With `weight` the mean is weighted; a group with a weight <= 0 gets a null value. Leaves keep their
    reward, childless inner nodes get 0.
    """
    depth = max_depth(nodes) if depth is None else depth
    w = F.col(weight) if weight else F.lit(1.0)
    done, kids = [], None
    for d in range(depth, -1, -1):
        level = nodes.where(F.col("depth") == d)
        if kids is None:
            level = level.withColumns(
                {"value": F.coalesce("reward", F.lit(0.0)), "value_std": F.lit(0.0), "n_children": F.lit(0).cast("bigint")}
            )
        else:
            mean = F.sum(F.col("value") * w) / F.sum(w)
            stats = kids.groupBy(F.col("parent_id").alias("node_id")).agg(
                F.when(F.min(w) > 0, mean if weight else F.avg("value")).alias("__mean"),
                F.stddev_pop("value").alias("__std"),
                F.count(F.lit(1)).alias("n_children"),
            )
            level = level.join(stats, "node_id", "left").withColumns(
                {
                    "value": F.when(F.col("n_children").isNull(), F.coalesce("reward", F.lit(0.0))).otherwise(F.col("__mean")),
                    "value_std": F.coalesce("__std", F.lit(0.0)),
                    "n_children": F.coalesce("n_children", F.lit(0)),
                }
            ).drop("__mean", "__std")
        if depth > CUT_EVERY and d % CUT_EVERY == 0:
            level = materialise(level)
        done.append(level)
        kids = level
    # every user of a backed-up tree reads it more than once (children, parents, roots)
    return materialise(reduce(DataFrame.unionByName, done), "valued")


def with_parent(valued: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Non-root nodes with columns of their parent; `valued` carries n_children, the parent's fan-out."""
    parents = valued.select(
        F.col("node_id").alias("parent_id"), F.col("n_children").alias("__n"), *[F.col(c).alias(n) for c, n in cols.items()]
    )
    kids = valued.where(F.col("parent_id").isNotNull())
    return join_stats(kids, parents, ["parent_id"], ["node_id"]).drop("__n")


def edges(valued: DataFrame, snapshot: str = "s0") -> DataFrame:
    """One row per non-root node with its parent's value, its tree's root value and a derived identity."""
    rows = with_parent(
        valued, {"value": "parent_value", "value_std": "parent_std", "text": "query", "n_children": "allocated_k"}
    )
    size = valued.groupBy("tree_id").agg(F.count(F.lit(1)).alias("__n"), F.max(F.when(F.col("depth") == 0, F.col("value"))).alias("root_value"))
    rows = join_stats(rows, size, ["tree_id"], ["node_id"]).drop("__n")
    return rows.withColumn("edge_id", edge_id(snapshot))


def edge_id(snapshot: str) -> Column:
    return F.concat_ws(":", F.lit(snapshot), F.md5(F.concat_ws("|", "tree_id", "parent_id", "node_id")))


def update_values(rows: DataFrame, mode: str = "spo", method: str = "rloo", mix: float = 0.5, gamma: float = 0.9) -> DataFrame:
    """Advantage and value of an edge: local, mixed local/root-relative, or process reward plus gamma child."""
    child, parent = F.col("value"), F.col("parent_value")
    local = child - parent
    if method == "grpo":
        local = local / (F.col("parent_std") + 1e-8)
    elif method != "rloo":
        raise ValueError(f"unknown method {method!r}")
    if mode == "spo":
        adv, val = local, child
    elif mode == "treepo":
        w = min(max(mix, 0.0), 1.0)
        adv, val = (1.0 - w) * local + w * (child - F.col("root_value")), child
    elif mode == "treerl":
        val = (child - parent) + gamma * child
        adv = val - parent
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return rows.withColumns({"advantage": adv, "target_value": val})


def prover_advantage(rows: DataFrame, k: int = 4) -> DataFrame:
    gain = best_of_k(F.col("value"), k) - best_of_k(F.col("parent_value"), k)
    return rows.withColumn("prover_advantage", gain)


def child_advantages(valued: DataFrame, answered: Column) -> DataFrame:
    """value - parent value; children of an answered node get none."""
    rows = with_parent(valued.withColumn("answered", answered), {"value": "parent_value", "answered": "below"})
    return rows.withColumn("advantage", F.when(~F.col("below"), F.col("value") - F.col("parent_value")))


def paths(valued: DataFrame, depth: int | None = None, branch_factor: int | None = None, repeat_early: bool = False) -> DataFrame:
    """Root-to-leaf chains: array of (node_id, score, advantage, weight); weight = branch_factor**(missing
    depth) for nodes above the deepest level. `repeat_early` lists a leaf that stopped early that often."""
    depth = max_depth(valued) if depth is None else depth
    bf = F.lit(float(branch_factor or 1))
    weight = F.when(F.col("depth") < depth, F.pow(bf, F.lit(depth) - F.col("depth"))).otherwise(1.0)
    rows = valued.withColumn("weight", weight)
    adv = F.col("value") - F.col("pv")
    entry = lambda a: F.struct("node_id", F.col("value").alias("score"), a.alias("advantage"), "weight")
    keep = ["tree_id", "node_id", "depth", "n_children", "value", "weight", "chain"]
    level = rows.where(F.col("depth") == 0).withColumn("chain", F.array(entry(F.lit(None).cast("double"))))
    level = level.select(*keep)
    sizes = valued.select(F.col("node_id").alias("parent_id"), F.col("n_children").alias("__n"))
    done = [level.where(F.col("n_children") == 0)]
    for d in range(1, depth + 1):
        up = level.select(
            F.col("node_id").alias("parent_id"), F.col("chain").alias("above"), F.col("value").alias("pv"), F.col("n_children").alias("__n")
        )
        kids = join_stats(rows.where(F.col("depth") == d), up, ["parent_id"], ["node_id"], sizes)
        level = kids.withColumn("chain", F.array_append("above", entry(adv))).select(*keep)
        if depth > CUT_EVERY and d % CUT_EVERY == 0:
            level = materialise(level)
        done.append(level.where(F.col("n_children") == 0))
    out = reduce(DataFrame.unionByName, done).withColumnRenamed("node_id", "leaf_id")
    if repeat_early:
        times = F.when(F.col("depth") < depth, F.col("weight").cast("int")).otherwise(F.lit(1))
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    return out.drop("n_children", "value", "weight")


# Path filters: chain -> condition. Node 1 is the query, node 2 the first step.
def _at(chain: Column, i: int) -> Column:
    return F.try_element_at(chain, F.lit(i))


PATH_FILTERS.add("none")(lambda c: F.lit(True))
PATH_FILTERS.add("successful")(lambda c: _at(c, -1)["score"] == 1)
PATH_FILTERS.add("first_step_positive")(lambda c: _at(c, 2)["score"] > 0)
PATH_FILTERS.add("last_score_positive")(lambda c: _at(c, -1)["score"] > 0)
PATH_FILTERS.add("last_score_zero")(lambda c: _at(c, -1)["score"] == 0)
PATH_FILTERS.add("last_advantage_positive")(lambda c: _at(c, -1)["advantage"] > 0)


def _map(chain, fn):
    return F.transform(chain, fn)


def _set(x, **kw):
    for k, v in kw.items():
        x = x.withField(k, v)
    return x


def _last_index(chain, cond):
    """1-based index of the last element after the first one that meets `cond`, else 1."""
    hits = F.transform(chain, lambda x, i: F.when((i > 0) & cond(x), i + 1).otherwise(1))
    return F.array_max(hits)


def _first_negative(chain):
    hits = F.transform(chain, lambda x, i: F.when((i > 0) & (x["advantage"] < 0), i).otherwise(F.size(chain)))
    return F.array_min(hits)


PATH_REWRITES.add("cut_zero_tail")(lambda c: F.slice(c, 1, _last_index(c, lambda x: F.abs(x["advantage"]) >= 1e-6)))
PATH_REWRITES.add("first_step_only")(lambda c: F.slice(c, 1, 2))
PATH_REWRITES.add("cut_at_first_negative")(lambda c: F.slice(c, 1, _first_negative(c)))
PATH_REWRITES.add("advantage_one")(
    lambda c: _map(c, lambda x: _set(x, advantage=F.when(x["advantage"].isNotNull(), 1.0)))
)
PATH_REWRITES.add("zero_to_epsilon")(
    lambda c: _map(c, lambda x: _set(x, advantage=F.when(x["advantage"] == 0, 0.05).otherwise(x["advantage"])))
)
PATH_REWRITES.add("negative_to_zero")(
    lambda c: _map(c, lambda x: _set(x, advantage=F.when(x["advantage"] < 0, 0.0).otherwise(x["advantage"])))
)
PATH_REWRITES.add("inner_score_zero")(
    lambda c: F.transform(c, lambda x, i: _set(x, score=F.when(i < F.size(c) - 1, 0.0).otherwise(x["score"])))
)
PATH_REWRITES.add("inner_advantage_zero")(
    lambda c: F.transform(
        c,
        lambda x, i: _set(x, advantage=F.when((i < F.size(c) - 1) & x["advantage"].isNotNull(), 0.0).otherwise(x["advantage"])),
    )
)
PATH_REWRITES.add("advantage_from_score")(
    lambda c: F.transform(c, lambda x, i: _set(x, advantage=F.when(i > 0, x["score"]).otherwise(x["advantage"])))
)
PATH_REWRITES.add("importance_weighted")(
    lambda c: _map(c, lambda x: _set(x, advantage=x["advantage"] * x["weight"]))
)
PATH_REWRITES.add("last_advantage_one")(
    lambda c: F.transform(c, lambda x, i: _set(x, advantage=F.when(i == F.size(c) - 1, 1.0).otherwise(x["advantage"])))
)


@PATH_SELECTORS.add("unique")
def unique_paths(df: DataFrame) -> DataFrame:
    return df.withColumn("__j", F.to_json("chain")).dropDuplicates(["__j"]).drop("__j")


@PATH_SELECTORS.add("top_share")
def top_share(df: DataFrame, share: float, how: str = "mean") -> DataFrame:
    """Best `share` of the paths of a tree by mean or summed advantage (at least one), earlier leaf on ties.

    Ranks come from running counts over buckets of the score, so a tree with most paths is split.
    """
    known = F.filter(F.transform("chain", lambda x: x["advantage"]), lambda a: a.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, a: s + a)
    score = total / F.greatest(F.size(known), F.lit(1)) if how == "mean" else total
    rows = df.withColumn("path_score", F.round(score, 9))
    # equal scores are common (few distinct values): rank by score level, then inside a level by leaf hash
    levels = rows.groupBy("tree_id", "path_score").agg(F.count(F.lit(1)).alias("c"))
    run = running_sum(levels, ["tree_id"], [F.desc("path_score")], value_bucket(levels, F.col("path_score"), descending=True), {"upto": F.col("c")})
    n = rows.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("__n"))
    run = join_stats(run, n, ["tree_id"], ["path_score"]).drop("__n").withColumn("quota", F.greatest(F.floor(F.col("n") * share), F.lit(1)))
    run = run.withColumn("above", F.col("upto") - F.col("c")).where(F.col("above") < F.col("quota"))
    rows = join_stats(rows, run.withColumnRenamed("c", "__n").drop("upto", "n"), ["tree_id", "path_score"], ["leaf_id"])
    # only the level that crosses the quota needs an order inside it
    whole = rows.where(F.col("above") + F.col("__n") <= F.col("quota"))
    cross = rows.where(F.col("above") + F.col("__n") > F.col("quota")).withColumn("__k", F.md5("leaf_id"))
    cross = ranked(cross, ["tree_id"], [F.col("__k"), F.col("leaf_id")], hash_bucket(F.col("__k")), "__r")
    cross = cross.where(F.col("above") + F.col("__r") <= F.col("quota")).drop("__k", "__r")
    return whole.unionByName(cross).drop("above", "quota", "__n")


@PATH_SELECTORS.add("sample")
def sample_paths(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return first_k(df, ["tree_id"], [sample_key(seed, F.col("leaf_id")), F.col("leaf_id")], k)


# --- diversity ----------------------------------------------------------------------------------------


def sibling_bleu(texts: DataFrame, order: int = 4) -> DataFrame:
    """Corpus BLEU over all sibling pairs (i < j) of a parent: (parent, bleu).

    Input: parent, i, text. n-gram counts per text are joined on (parent, n-gram); siblings of a parent are
    bounded by the branch factor. Lengths need no pair table: they come from per-parent sums over positions.
    """
    words = texts.select("parent", "i", F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "").alias("w"))
    words = words.withColumn("len", F.size("w"))
    gram = lambda n: F.transform(
        F.sequence(F.lit(1), F.col("len") - (n - 1)), lambda p: F.array_join(F.slice("w", p, n), " ")
    )
    grams = [
        words.where(F.col("len") >= n).select("parent", "i", F.lit(n).alias("n"), F.explode(gram(n)).alias("g"))
        for n in range(1, order + 1)
    ]
    counts = reduce(DataFrame.unionByName, grams).groupBy("parent", "i", "n", "g").agg(F.count(F.lit(1)).alias("c"))
    a, b = counts.alias("a"), counts.alias("b")
    hit = (
        a.join(b, (F.col("a.parent") == F.col("b.parent")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.i") < F.col("b.i")))
        .groupBy(F.col("a.parent").alias("parent"), F.col("a.n").alias("n"))
        .agg(F.sum(F.least("a.c", "b.c")).alias("m"))
    )
    hits = hit.groupBy("parent").pivot("n", list(range(1, order + 1))).agg(F.first("m"))
    # text number r of k (from 1) is a candidate k - r times and a reference r - 1 times
    r = F.row_number().over(Window.partitionBy("parent").orderBy("i"))
    k = F.count(F.lit(1)).over(Window.partitionBy("parent"))
    sizes = words.select("parent", "len", r.alias("r"), k.alias("k")).where("k > 1").groupBy("parent").agg(
        F.sum(F.col("len") * (F.col("k") - F.col("r"))).alias("cand"),
        F.sum(F.col("len") * (F.col("r") - 1)).alias("ref"),
        *[F.sum(F.greatest(F.col("len") - (n - 1), F.lit(0)) * (F.col("k") - F.col("r"))).alias(f"p{n}") for n in range(1, order + 1)],
    )
    rows = sizes.join(hits, "parent", "left")
    prec = [F.coalesce(F.col(str(n)), F.lit(0)) / F.nullif(F.col(f"p{n}"), F.lit(0)) for n in range(1, order + 1)]
    logs = reduce(lambda x, y: x + y, [F.log(p) for p in prec]) / order
    ok = F.least(*[F.coalesce(p, F.lit(0.0)) for p in prec]) > 0
    ratio = F.col("cand") / F.col("ref")
    brevity = F.when(ratio > 1, 1.0).otherwise(F.exp(1 - 1 / ratio))
    return rows.select("parent", F.when(ok, F.exp(logs) * brevity).otherwise(0.0).alias("bleu"))


# --- statistics ---------------------------------------------------------------------------------------


def tree_stats(valued: DataFrame) -> DataFrame:
    """Nodes, leaves, depth and root value per tree."""
    root = F.col("depth") == 0
    return valued.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("n_children") == 0).alias("leaves"),
        F.max("depth").alias("max_depth"),
        F.max(F.when(root, F.col("value"))).alias("root_value"),
        F.max(F.when(root, F.col("value_std"))).alias("root_std"),
    )


def depth_stats(valued: DataFrame) -> DataFrame:
    return valued.groupBy("tree_id", "depth").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def action_counts(nodes: DataFrame) -> DataFrame:
    """Actions and share/prune rates per tree and depth, and per tree (depth null), in one pass."""
    act = F.col("action")
    out = nodes.rollup("tree_id", "depth").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(act == "expand").alias("expand"),
        F.count_if(act == "share").alias("share"),
        F.count_if(act == "prune").alias("prune"),
        F.grouping_id().alias("__g"),
    )
    return out.where(F.col("__g") < 3).withColumns(
        {"share_rate": F.col("share") / F.col("n"), "prune_rate": F.col("prune") / F.col("n")}
    ).drop("__g")


def budget_stats(valued: DataFrame, requested: dict[int, int]) -> DataFrame:
    """Built, allocated and requested branches per tree and depth and per tree; nodes without allocation are skipped."""
    want = F.coalesce(*[F.when(F.col("depth") == d, F.lit(v)) for d, v in requested.items()], F.lit(0))
    k = F.col("allocated_k")
    out = valued.where(k.isNotNull()).rollup("tree_id", "depth").agg(
        F.sum("n_children").alias("built"),
        F.sum(k).alias("allocated"),
        F.sum(want).alias("requested"),
        F.count(F.lit(1)).alias("parents"),
        F.avg(k).alias("k_mean"),
        F.min(k).alias("k_min"),
        F.max(k).alias("k_max"),
        F.stddev_pop(k).alias("k_std"),
        F.grouping_id().alias("__g"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.where(F.col("__g") < 3).withColumns(
        {"built_to_allocated": ratio("built", "allocated"), "built_to_requested": ratio("built", "requested")}
    ).drop("__g")


def group_metrics(rows: DataFrame) -> DataFrame:
    """Batch metrics of edges (tree_id, parent_id, queue): parents per tree, children per parent, queue mass,
    correlation of segment weight 1/(parents * k) with the branch factor k."""
    parent = rows.groupBy("tree_id", "parent_id").agg(F.count(F.lit(1)).alias("k"))
    tree = parent.groupBy("tree_id").agg(F.count(F.lit(1)).alias("parents"))
    queue = rows.groupBy("tree_id", "queue").agg(F.countDistinct("parent_id").alias("q")).groupBy("tree_id").agg(F.sum("q").alias("q"))
    t = tree.join(queue, "tree_id")
    # every edge of a parent shares weight and factor: the correlation is weighted by k, on the few distinct (parents, k);
    # moments are centred doubles, which neither overflow nor cancel
    p = join_stats(parent, tree.withColumn("__n", F.col("parents")), ["tree_id"], ["parent_id"])
    k = F.col("k").cast("double")
    p = p.groupBy("parents", "k").agg((F.count(F.lit(1)) * k).alias("edges")).withColumn("w", 1.0 / (F.col("parents") * k))
    e, w = F.col("edges"), F.col("w")
    p = p.withColumn("__mean", p.agg(F.struct((F.sum(e * k) / F.sum(e)).alias("k"), (F.sum(e * w) / F.sum(e)).alias("w")).alias("m")).scalar())
    dk, dw = k - F.col("__mean.k"), w - F.col("__mean.w")
    s = p.agg(
        F.sum(e * dw * dk).alias("swk"), F.sum(e * dw * dw).alias("sww"), F.sum(e * dk * dk).alias("skk"),
        ((F.min("k") < F.max("k")) & (F.min(w) < F.max(w))).alias("varied"),
    )
    return s.select(
        scalar(t, F.avg("parents")).alias("parents_per_tree"), scalar(parent, F.avg("k")).alias("children_mean"), scalar(parent, F.stddev_pop("k")).alias("children_std"),
        scalar(t, F.avg(F.col("q") / F.col("parents"))).alias("queue_mass"),
        F.when(F.col("varied"), F.col("swk") / (F.sqrt("sww") * F.sqrt("skk"))).otherwise(0.0).alias("weight_branch_corr"),
        scalar(t, F.count(F.lit(1))).alias("trees"),
    )


def pair_bleu(texts: DataFrame, order: int = 4) -> DataFrame:
    """Sentence BLEU of each sibling pair i < j of a parent (parent, i, j, bleu); unmatched orders give 0, so only
    pairs that share an n-gram of the highest order are rows."""
    words = texts.select("parent", "i", F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "").alias("w"))
    words = words.withColumn("len", F.size("w"))
    gram = lambda n: F.transform(
        F.sequence(F.lit(1), F.col("len") - (n - 1)), lambda p: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", p, n), " ").alias("g"))
    )
    per = [F.when(F.col("len") >= n, gram(n)).otherwise(F.array().cast("array<struct<n:int,g:string>>")) for n in range(1, order + 1)]
    counts = words.select("parent", "i", F.inline(F.concat(*per))).groupBy("parent", "i", "n", "g").agg(F.count(F.lit(1)).alias("c"))
    a = counts.select("parent", "n", "g", F.col("i").alias("i"), F.col("c").alias("ca"))
    b = counts.select("parent", "n", "g", F.col("i").alias("j"), F.col("c").alias("cb"))
    m = a.join(b, ["parent", "n", "g"]).where("i < j").groupBy("parent", "i", "j", "n").agg(F.sum(F.least("ca", "cb")).alias("m"))
    size = words.select("parent", "i", "len")
    rows = m.join(size, ["parent", "i"]).join(size.select("parent", F.col("i").alias("j"), F.col("len").alias("ref")), ["parent", "j"])
    score = rows.groupBy("parent", "i", "j").agg(
        F.count(F.lit(1)).alias("orders"), F.avg(F.log(F.col("m") / (F.col("len") - F.col("n") + 1))).alias("logs"), F.first("len").alias("len"), F.first("ref").alias("ref")
    )
    ratio = F.col("len") / F.col("ref")
    brevity = F.when(ratio > 1, 1.0).otherwise(F.exp(1 - 1 / ratio))
    return score.where(F.col("orders") == order).select("parent", "i", "j", (F.exp("logs") * brevity).alias("bleu"))


def diverse_acceptance(texts: DataFrame, pairs: DataFrame, threshold: float, last: Column) -> DataFrame:
    """Siblings accepted in arrival order while their mean BLEU to those accepted stays within the threshold; rows
    of the last try are always accepted. A fold over one small array per parent (bounded by the branch factor)."""
    key = F.concat_ws("_", "i", "j")
    m = pairs.groupBy("parent").agg(F.map_from_entries(F.collect_list(F.struct(key, F.col("bleu")))).alias("b"))
    per = texts.withColumn("last", last).groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("i", "last"))).alias("x"))
    per = per.join(m, "parent", "left").withColumn("b", F.coalesce("b", F.create_map().cast("map<string,double>")))

    def step(acc, x):
        got = F.transform(acc, lambda a: F.coalesce(F.try_element_at(F.col("b"), F.concat_ws("_", a, x["i"])), F.lit(0.0)))
        mean = F.aggregate(got, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(acc), F.lit(1))
        return F.when(x["last"] | (mean <= threshold), F.array_append(acc, x["i"])).otherwise(acc)

    return per.select("parent", F.explode(F.aggregate("x", F.array().cast("array<bigint>"), step)).alias("i"))
