"""Prefix trie of conversations as a burst trie.

Conversations are suffixes of turn names below trie heads. A container with more than `limit` distinct suffixes bursts by
the next turn: its prefix becomes a head and its suffixes move to containers one turn deeper. The rest are dealt to the
shards by container, sorted there and swept once with a stack of open nodes, which gives every node below the heads whole.
Heads get their numbers from the containers below them: these are summed by the lowest head first, then handed to its
ancestors, so a head that holds a third of all conversations costs one row for each task.

* Bursting looks at the depths in windows of 2, 4, 8, ... turns. How many suffixes share a prefix is counted before the
  shuffle and joined back with salts for hot prefixes. Only conversations that still are in an oversized container go to
  the next window, so the number of jobs is the logarithm of the deepest head.
* Equal conversations are one suffix with a number of copies. Their ids are sorted over all tasks (a group of copies spans
  many) and cut into blocks of text; a digest of one block is taken in place, one of several blocks reads them in order.
* Texts are never shuffled: a turn is 16 bytes and a length. One task holds the turns of one conversation in that form.

Defined cases: null role or text is empty; null turns stand first, equal turn numbers by name; rows without conv_id belong
to no conversation; repeated rows are turns of their own; a table without conversations has no node, not even the root;
columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groveflow.llm import turns
from groveflow.llm.registry import query, ready, table
from groveflow.operators.spread import attach_stats, join_stats
from groveflow.session import materialise

LIMIT = 1024  # distinct suffixes in a container
BLOCK = 1 << 18  # bytes of ids in one block of a digest
_EMPTY = hashlib.sha256(b"").hexdigest()


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, ids (names of the turns in order) and sizes (code points of their texts)."""
    known = rows.where("conv_id IS NOT NULL")
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", turns.name().alias("id"), F.char_length(turns.plain("text")).alias("size"))
    ordered = known.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return ordered.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def rebuild(own: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """Each conversation with its first `taken` turns (at most `most`) replaced by those of conversation `base`."""
    heads = own.select(F.col("conv_id").alias("base"), F.slice("ids", 1, most).alias("base_ids"), F.slice("sizes", 1, most).alias("base_sizes"))
    rows = own.select("*", base.alias("base"), taken.cast("int").alias("h")).join(heads, "base", "left")
    rest = lambda c: F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))
    first = lambda c, kind: F.coalesce(F.slice(c, F.lit(1), F.col("h")), F.array().cast(kind))
    return rows.select(
        "conv_id", F.concat(first("base_ids", "array<binary>"), rest("ids")).alias("ids"), F.concat(first("base_sizes", "array<int>"), rest("sizes")).alias("sizes")
    )


def _chain(ids) -> list[bytes]:
    """Names of all prefixes, the empty one first."""
    out = [b"\0" * 16]
    for x in ids:
        out.append(hashlib.blake2b(out[-1] + x, digest_size=16).digest())
    return out


def _named(batches):
    for batch in batches:
        names = [_chain(ids)[-1] for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *batch.columns], names=["name", *batch.schema.names])


def _prefixes(low: int, high: int):
    """Prefixes of low to high - 1 turns of each sequence."""

    def run(batches):
        for batch in batches:
            name, depth, prefix = [], [], []
            for own, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                some = _chain(ids[: high - 1])[low:high]
                name += [own] * len(some)
                depth += range(low, low + len(some))
                prefix += some
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(depth, pa.int32()), pa.array(prefix, pa.binary())], names=["name", "depth", "prefix"])

    return run


# ids of equal conversations ----------------------------------------------------------------------


def _blocks(size: int):
    """Runs of one name in sorted rows to blocks of comma-joined ids of about `size` bytes."""

    def run(batches):
        now, ids, held, out = None, [], 0, []

        def close():
            nonlocal ids, held
            if ids:
                out.append((now, ids[0], len(ids), ",".join(map(str, ids))))
            ids, held = [], 0

        def batch_of():
            rows, out[:] = list(out), []
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["name", "least", "n", "text"])

        for batch in batches:
            for name, conv in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()):
                if name != now or held >= size:
                    close()
                    now = name
                ids.append(conv)
                held += len(str(conv)) + 1
            yield batch_of()
        close()
        yield batch_of()

    return run


def _digests(batches):
    """Blocks in order of (name, least) to one SHA-256 for each name."""
    now, hasher = None, None
    for batch in batches:
        names, found = [], []
        for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
            if name == now:
                hasher.update(b"," + text.encode())
                continue
            if hasher:
                names.append(now)
                found.append(hasher.hexdigest())
            now, hasher = name, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.string())], names=["name", "ends"])
    if hasher:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([hasher.hexdigest()], pa.string())], names=["name", "ends"])


def copies(named: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each distinct sequence: name, least conv_id, n, ends (SHA-256 of the ascending ids, comma-joined)."""
    dealt = named.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    blocks = materialise(dealt.mapInArrow(_blocks(block), "name binary, least bigint, n bigint, text string"), "blocks")
    sums = blocks.groupBy("name").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    one = blocks.select("name", F.col("least").alias("at"), F.sha2("text", 256).alias("single"))
    several = blocks.join(sums.where("parts > 1").select("name"), "name", "left_semi").repartition("name").sortWithinPartitions("name", "least")
    long = several.mapInArrow(_digests, "name binary, ends string")
    rows = sums.join(one.where("at IS NOT NULL"), (sums["name"] == one["name"]) & (sums["least"] == one["at"])).select(sums["name"], "least", "n", "single")
    return rows.join(long, "name", "left").select("name", "least", "n", F.coalesce("ends", "single").alias("ends"))


# bursting ----------------------------------------------------------------------------------------


def burst(sequences: DataFrame, limit: int) -> DataFrame:
    """(name, depth) of the container that each sequence stays in; none for sequences that end at a head."""
    spark = sequences.sparkSession
    open_, low, width, found = sequences.select("name", "ids"), 0, 2, None
    while True:
        high = low + width
        rows = open_.mapInArrow(_prefixes(low, high), "name binary, depth int, prefix binary")
        rows = attach_stats(rows, ["prefix"], {"shared": F.count(F.lit(1))}, ["name"])
        fits = F.min(F.when(F.col("shared") <= limit, F.col("depth")))
        rows = materialise(rows.groupBy("name").agg(fits.alias("depth"), F.max("depth").alias("seen")), "burst")
        kept = rows.where("depth IS NOT NULL").select("name", "depth")
        found = kept if found is None else found.unionByName(kept)
        rest = rows.where(F.col("depth").isNull() & (F.col("seen") == high - 1)).select("name")
        if rest.isEmpty():
            return found
        open_ = materialise(open_.join(rest, "name", "left_semi").where(F.size("ids") >= high), "open")
        if open_.isEmpty():
            return found
        low, width = high, width * 2


# sweeping ----------------------------------------------------------------------------------------

_NODE = "container binary, top boolean, depth int, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string"
_KINDS = [pa.binary(), pa.bool_(), pa.int32(), *[pa.int64()] * 6, pa.string()]


def _sweep(batches):
    """Sorted suffixes of containers to nodes: a stack holds the open nodes of the last suffix.

    A node on the stack is [turn, size, least id, conversations, children, leaves, saved below, digest of ends].
    """
    names = [x.split()[0] for x in _NODE.split(", ")]
    now, start, stack, out = None, 0, [], []

    def close(keep: int):
        done = []
        while len(stack) > keep:
            _, size, least, n, children, leaves, saved, ends = stack.pop()
            leaves, saved = leaves or 1, saved + (n - 1) * size
            done.append((start + len(stack), least, n, children, leaves, saved, ends))
            if stack:
                up = stack[-1]
                up[2] = min(up[2], least)
                up[3] += n
                up[4] += 1
                up[5] += leaves
                up[6] += saved
        return done

    waiting = []  # closed nodes whose parent is still open: its least id may change

    def settle(done):
        """Children are closed before their parents; a parent's id is known once it is closed."""
        for node in done:
            depth, least = node[0], node[1]
            while waiting and waiting[-1][0] == depth + 1:
                child = waiting.pop()
                out.append((now, False, child[0], child[1], least, *child[2:]))
            waiting.append(node)
        if not stack:
            for node in waiting:
                out.append((now, True, node[0], node[1], None, *node[2:]))
            waiting.clear()

    def batch_of():
        rows, out[:] = list(out), []
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=names)

    for batch in batches:
        for container, depth, suffix, sizes, least, n, ends in zip(*(batch.column(c).to_pylist() for c in ("container", "depth", "suffix", "suffix_sizes", "least", "n", "ends"))):
            if container != now:
                settle(close(0))
                now, start = container, depth
                stack.append([None, sizes[0], least, 0, 0, 0, 0, _EMPTY])
            same = 0
            while same < len(suffix) and same + 1 < len(stack) and stack[same + 1][0] == suffix[same]:
                same += 1
            settle(close(same + 1))
            for turn, size in zip(suffix[same:], sizes[same + 1 :]):
                stack.append([turn, size, least, 0, 0, 0, 0, _EMPTY])
            end = stack[-1]
            end[2] = min(end[2], least)
            end[3] += n
            end[7] = ends
        yield batch_of()
    settle(close(0))
    yield batch_of()


def _paths(batches):
    """Contributions of the lowest heads to themselves and to all heads above: one row for each head of the path."""
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        length = np.array([len(p) for p in cols["path"]], np.int64)
        at = np.repeat(np.arange(batch.num_rows), length)
        depth = [d for k in length for d in range(k)]
        last = [d + 1 == length[i] for i, d in zip(at, depth)]
        flat = [x for p in cols["path"] for x in p]
        above = [None if d == 0 else cols["path"][i][d - 1] for i, d in zip(at, depth)]
        size = [0 if d == 0 else cols["path_sizes"][i][d - 1] for i, d in zip(at, depth)]
        every = {c: [cols[c][i] for i in at] for c in ("least", "n", "leaves", "saved", "head")}
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(flat, pa.binary()), pa.array(above, pa.binary()), pa.array(depth, pa.int32()), pa.array(size, pa.int64()), pa.array(every["head"], pa.binary()),
                *(pa.array(every[c], pa.int64()) for c in ("least", "n", "leaves", "saved")),
                pa.array([cols["children"][i] if x else 0 for i, x in zip(at, last)], pa.int64()), pa.array([cols["ends"][i] if x else None for i, x in zip(at, last)], pa.string()),
            ],
            names=["name", "parent", "depth", "size", "owner", "least", "n", "leaves", "saved", "children", "ends"],
        )


def _upward(batches):
    """What the heads that a path owns (its lowest ones) save, handed to each head of the path."""
    for batch in batches:
        name, saved = [], []
        for path, own in zip(batch.column("path").to_pylist(), batch.column("own").to_pylist()):
            each = np.zeros(len(path), np.int64)
            for x in own:
                each[x["depth"]] = x["saved"]
            name += path
            saved += each[::-1].cumsum()[::-1].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(saved, pa.int64())], names=["name", "above"])


def trie(sequences: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Nodes of the trie of `sequences` (name, ids, sizes, least, n, ends; names distinct): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    stays = burst(sequences, limit)
    rows = sequences.join(stays, "name", "left")

    def contain(batches):
        """Container and path of heads of each sequence; one that ends at a head has that head as its last."""
        for batch in batches:
            container, path = [], []
            for ids, depth in zip(batch.column("ids").to_pylist(), batch.column("depth").to_pylist()):
                names = _chain(ids if depth is None else ids[:depth])
                container.append(None if depth is None else names.pop())
                path.append(names)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(container, pa.binary()), pa.array(path, pa.list_(pa.binary()))], names=[*batch.schema.names, "container", "path"]
            )

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    rows = materialise(rows.mapInArrow(contain, f"{kinds}, container binary, path array<binary>"), "suffixes")
    inside = rows.where("container IS NOT NULL")
    suffixes = inside.select(
        "container",
        "depth",
        F.slice("ids", F.col("depth") + 1, F.greatest(F.size("ids") - F.col("depth"), F.lit(0))).alias("suffix"),
        F.when(F.col("depth") == 0, F.concat(F.array(F.lit(0)), F.col("sizes"))).otherwise(F.slice("sizes", F.greatest("depth", F.lit(1)), F.size("sizes"))).alias("suffix_sizes"),
        "least",
        "n",
        "ends",
    )
    suffixes = suffixes.repartition("container").sortWithinPartitions("container", "suffix")
    nodes = materialise(suffixes.mapInArrow(_sweep, _NODE), "nodes")

    # the lowest heads: what their containers and the sequences that end there hold
    paths = inside.where(F.size("path") > 0).groupBy("container").agg(F.any_value("path").alias("path"), F.any_value("sizes").alias("sizes"))
    tops = nodes.where("top").join(paths, "container")
    below = tops.select(
        "path", F.slice("sizes", 1, F.size("path")).alias("path_sizes"), F.col("conv_id").alias("least"), F.col("n_convs").alias("n"),
        F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(1).alias("children"), F.lit(None).cast("string").alias("ends"),
    )
    ended = rows.where("container IS NULL").select(
        "path", F.col("sizes").alias("path_sizes"), "least", "n", *(F.lit(0).alias(c) for c in ("leaves", "saved", "children")), "ends"
    )
    sums = {c: F.sum(c).cast("bigint").alias(c) for c in ("n", "leaves", "saved", "children")}
    seeds = below.unionByName(ended).groupBy(F.element_at("path", -1).alias("head")).agg(
        F.any_value("path").alias("path"), F.any_value("path_sizes").alias("path_sizes"), F.min("least").alias("least"), *sums.values(), F.max("ends").alias("ends")
    )
    seeds = materialise(seeds, "seeds")
    shape = "name binary, parent binary, depth int, size bigint, owner binary, least bigint, n bigint, leaves bigint, saved bigint, children bigint, ends string"
    heads = seeds.mapInArrow(_paths, shape).groupBy("name").agg(
        F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.any_value("size").alias("size"), F.min("owner").alias("owner"),
        F.min("least").alias("least"), *sums.values(), F.max("ends").alias("ends"),
    )
    heads = materialise(heads.withColumn("own", (F.col("n") - 1) * F.col("size")), "heads")
    owned = heads.groupBy(F.col("owner").alias("head")).agg(F.collect_list(F.struct("depth", F.col("own").alias("saved"))).alias("own"))
    above = seeds.select("head", "path").join(owned, "head").select("path", "own").mapInArrow(_upward, "name binary, above bigint").groupBy("name").agg(F.sum("above").alias("above"))
    branches = heads.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("branches"))
    heads = heads.join(above, "name").join(branches, "name", "left").withColumn("n_children", F.col("children") + F.coalesce("branches", F.lit(0)))
    heads = materialise(
        heads.select(
            "name", "parent", "depth", F.col("least").alias("conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
            (F.col("saved") + F.col("above")).alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends"),
        ),
        "head-nodes",
    )

    # container tops and heads hang below heads; a head with many children is salted
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    hung = tops.select(F.col("container").alias("name"), F.element_at("path", -1).alias("parent"), *columns)
    hung = hung.unionByName(heads.where("parent IS NOT NULL").select("name", "parent", *columns))
    parents = heads.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__n"))
    hung = join_stats(hung, parents, ["parent"], ["name"]).drop("__n")
    lone = nodes.where("NOT top OR depth = 0").unionByName(heads.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("bigint")), allowMissingColumns=True)
    out = lone.select("parent_conv_id", *columns).unionByName(hung.select("parent_conv_id", *columns))
    return out.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")
    )


def prefix_trie(rebuilt: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """The trie of conversations (conv_id, ids, sizes), see `trie`."""
    ready(rebuilt.sparkSession)
    named = materialise(rebuilt.mapInArrow(_named, "name binary, conv_id bigint, ids array<binary>, sizes array<int>"), "named")
    single = copies(named, block)
    chosen = single.join(named.select(F.col("conv_id").alias("least"), "ids", "sizes"), "least")
    return trie(materialise(chosen.select("name", "ids", "sizes", "least", "n", "ends"), "sequences"), limit)


SHARED = 5  # turns that can be taken from another conversation

_SQL = """
WITH t AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, length(coalesce(text, '')) AS size, turn
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM t),
c AS (SELECT DISTINCT conv_id FROM n),
bytes AS (
  SELECT x, list_reduce([x::UBIGINT] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v FROM range(256) r(x)),
vals AS (SELECT list(v ORDER BY x) AS v FROM bytes),
h AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::UBIGINT),
    lambda a, b: xor(vals.v[(xor(a, b) & 255)::BIGINT + 1], a >> 8)), 4294967295::UBIGINT)::BIGINT % 6 AS h
  FROM c, vals),
r AS (
  SELECT h.conv_id, n.pos, n.id, n.size FROM h JOIN n ON n.conv_id = h.base AND n.pos <= h.h
  UNION ALL SELECT h.conv_id, n.pos, n.id, n.size FROM h JOIN n ON n.conv_id = h.conv_id AND n.pos > h.h),
s AS (
  SELECT h.conv_id, coalesce(list(r.id ORDER BY r.pos) FILTER (r.id IS NOT NULL), []) AS ids, coalesce(list(r.size ORDER BY r.pos) FILTER (r.id IS NOT NULL), []) AS sizes
  FROM h LEFT JOIN r ON r.conv_id = h.conv_id GROUP BY h.conv_id),
p AS (SELECT conv_id, ids, sizes, unnest(range(len(ids) + 1)) AS d FROM s),
q AS (SELECT conv_id, d, len(ids) AS l, array_to_string(ids[1:d], ' ') AS k, array_to_string(ids[1:d - 1], ' ') AS up, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size FROM p),
nodes AS (
  SELECT k, d, any_value(up) AS up, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l = d), '')) AS ends_sha256
  FROM q GROUP BY k, d),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up, d),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.k = nodes.k AND kids.d = nodes.d),
anc AS (
  SELECT DISTINCT q2.k AS k, q2.d AS d, q.k AS below, q.d AS below_d FROM q JOIN q q2 ON q.conv_id = q2.conv_id AND q2.d <= q.d),
sums AS (
  SELECT anc.k, anc.d, sum((f.n_children = 0)::INT)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.size)::BIGINT AS saved_tokens
  FROM anc JOIN full_ f ON f.k = anc.below AND f.d = anc.below_d GROUP BY anc.k, anc.d)
SELECT f.conv_id, f.d::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN sums ON sums.k = f.k AND sums.d = f.d LEFT JOIN nodes u ON f.d > 0 AND u.k = f.up AND u.d = f.d - 1
"""


@query("op11_prefix_trie", _SQL)
def op11(spark, sf_dir):
    own = materialise(conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "turns")
    base = F.col("conv_id") - F.col("conv_id") % 100
    return prefix_trie(rebuild(own, base, F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1), SHARED))
