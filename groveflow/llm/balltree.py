"""Exact ranked search with ball trees over sparse document vectors.

A document's vector has one component for each term, which depends on the term's count and the document's length; a query's
score is the sum of its terms' weights times components, all in 64-bit integers. Documents stay where they were read: each
task cuts its rows into chunks of a fixed number, builds a ball tree over each chunk and searches it for every query of a
block, best subtree first. A task keeps the k best documents of each query from chunk to chunk, so later chunks are pruned
by what was found before; tasks return k rows a query, which are merged.

* Scale: components are stretched by the square root of the term's weight, likewise the query, which leaves the products
  as they are and keeps frequent words from widening the balls.
* Bound of a subtree: product of query and centroid plus radius times the query's length. Terms are split into groups by
  number, with a radius for each, so a query pays only for groups that it has terms in. Float errors are far below the
  slack that is added, and a subtree is dropped only if its bound is below the k-th score found; ties are kept.
* Leaves are scored in integers.

Only terms that some query holds matter to a score. A bitmap of fixed size (2 MB, whatever the queries) drops most others
when documents are read; those that pass are kept by a 64-bit hash of the term. Queries come in blocks of at most `BLOCK`
terms together (one query at least), each of which is a broadcast of that size and one pass over the stored vectors.

Defined cases: a null or wordless text is not a document of the collection and is never found; a query without terms finds
nothing; repeated documents are ranked each; equal scores stand by document id, null last; repeated or null query ids are
queries of their own if the text differs, and one if all is equal; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groveflow.llm import kernel
from groveflow.llm.registry import query, ready, table
from groveflow.session import materialise

TOP = 10
BITS = 24
CHUNK, LEAF, GROUPS = 4096, 32, 64
BLOCK = 1 << 15  # terms of the queries in one block
SCALE, PARTS, HALF, FULL = 1_000_000_000, 1000, 8, 90  # fixed values of the score
SLACK = 1e-9


def weight(n, df):
    """Column: weight of a term that df of n documents hold."""
    return F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * df + 1))).cast("bigint")


def length_share(size: np.ndarray, count: int, total: int) -> np.ndarray:
    """A document's length against the mean; whole numbers, exact for any size."""
    if count * FULL * int(size.max(initial=0)) < 1 << 63:
        return 100 - FULL + size * (FULL * count) // total
    return np.array([100 - FULL + FULL * int(x) * count // total for x in size], np.int64)


# reading -----------------------------------------------------------------------------------------


def counted(array: pa.Array, bitmap: np.ndarray | None):
    """Of each slice of texts: (terms in each text, distinct (hash, count) of the terms that the bitmap lets through, how
    many of these each text has)."""
    for a, b in kernel.slices(array):
        data, offsets = kernel.bytes_of(array.slice(a, b - a))
        words = kernel.Words(data, offsets, kernel.ALNUM)
        own, h = words.texts(), words.hash
        if bitmap is not None:
            bit = (h >> np.uint64(64 - BITS)).astype(np.int64)
            keep = np.flatnonzero((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            own, h = own[keep], h[keep]
        order = np.lexsort((h, own))
        own, h = own[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        yield words.count, h[at].view(np.int64), np.diff(np.append(at, len(h))), np.bincount(own[at], minlength=b - a)


def _vectors(column, bitmap):
    """Word counts, list arrays of hashes and of counts, for a column of texts."""
    sizes, hashes, counts = [np.zeros(0, np.int64)], [], []
    for n, h, c, own in counted(kernel.texts(column), bitmap):
        sizes.append(n)
        hashes.append(kernel.lists(own, pa.array(h)))
        counts.append(kernel.lists(own, pa.array(c.astype(np.int32))))
    empty = lambda kind: [pa.array([], pa.list_(kind))]
    return np.concatenate(sizes), pa.concat_arrays(hashes or empty(pa.int64())), pa.concat_arrays(counts or empty(pa.int32()))


# trees -------------------------------------------------------------------------------------------


class Tree:
    """Ball tree over a chunk of sparse rows.

    first, term, value: rows in compressed form (term numbers below n_terms, float components). Nodes are stored as arrays:
    bounds [begin, end) in `rows` (row numbers in the order of the tree), children, centroids, radii by group of terms.
    """

    def __init__(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int, leaf: int, groups: int):
        self.first, self.term, self.value, self.n_terms, self.leaf, self.groups = first, term, value, n_terms, leaf, groups
        self.rows = np.arange(len(first) - 1)
        self.bounds, self.children, self.centroids, self.radii = [], [], [], []
        if len(self.rows):
            self._node(0, len(self.rows))
        self.centroid = np.array(self.centroids).reshape(-1, n_terms)
        self.radius = np.array(self.radii).reshape(-1, groups)

    def _cells(self, rows: np.ndarray):
        lengths = self.first[rows + 1] - self.first[rows]
        at = kernel.ragged(self.first[rows], lengths)
        return np.repeat(np.arange(len(rows)), lengths), self.term[at], self.value[at]

    def _node(self, begin: int, end: int) -> int:
        rows = self.rows[begin:end]
        own, term, value = self._cells(rows)
        n = len(rows)
        centre = np.bincount(term, value, self.n_terms) / n
        # squared distance to the centroid by group: all of the centroid, corrected where the row has a component
        whole = np.bincount(np.arange(self.n_terms) % self.groups, centre * centre, self.groups)
        fix = np.bincount(own * self.groups + term % self.groups, (value - centre[term]) ** 2 - centre[term] ** 2, n * self.groups).reshape(n, self.groups)
        far = whole[None, :] + fix
        size = whole + np.bincount(term % self.groups, value * value, self.groups)  # of what was added and subtracted
        me = len(self.bounds)
        self.bounds.append((begin, end))
        self.centroids.append(centre)
        self.radii.append(np.sqrt(np.maximum(far.max(axis=0), 0) + SLACK * size))
        self.children.append(None)
        if n > self.leaf:
            # two rows far apart: the one farthest from the centroid, the one farthest from that; rows go to the nearer half
            a = int(far.sum(axis=1).argmax())
            dense = np.zeros(self.n_terms)
            dense[term[own == a]] = value[own == a]
            norm = np.bincount(own, value * value, n)
            b = int((norm - 2 * np.bincount(own, value * dense[term], n)).argmax())
            dense[term[own == b]] -= value[own == b]
            order = np.argsort(np.bincount(own, value * dense[term], n), kind="stable")
            self.rows[begin:end] = rows[order]
            middle = begin + n // 2
            self.children[me] = (self._node(begin, middle), self._node(middle, end))
        return me

    def bound(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the product of each query (rows) with any row of each node (columns)."""
        length = np.sqrt(np.stack([np.bincount(np.arange(self.n_terms) % self.groups, q * q, self.groups) for q in queries]))
        size = queries @ self.centroid.T + length @ self.radius.T
        return size * (1 + SLACK) + 1

    def search(self, bound: np.ndarray, score, threshold):
        """Best-first: the leaves, in falling order of their bounds, until a bound is below `threshold()`; `score(rows)` takes
        a leaf's rows."""
        if not self.bounds:
            return
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if -b < threshold():
                return
            if self.children[node] is None:
                begin, end = self.bounds[node]
                score(self.rows[begin:end])
            else:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bound[child], child))


class _Best:
    """The k best (score, document id) so far; equal scores by ascending id, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def floor(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        floor = self.floor()
        at = np.flatnonzero(scores >= floor)
        if len(at):
            rows = self.rows + [(int(scores[i]), ids[i]) for i in at]
            rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
            self.rows = rows[: self.k]


def _search(block, count: int, total: int, k: int, chunk: int, leaf: int, groups: int, out):
    """Search of one task's rows (id, n, terms, counts). block: (numbers of the queries, hashes, weights), sorted by hash,
    as a broadcast."""

    def run(batches):
        number, hashes, weights = block.value
        vocabulary, code = np.unique(hashes, return_inverse=True)
        n_queries = int(number.max(initial=-1)) + 1
        w = np.zeros(len(vocabulary), np.int64)
        w[code] = weights
        root = np.sqrt(w.astype(np.float64))
        order = np.argsort(number, kind="stable")
        of = np.searchsorted(number[order], np.arange(n_queries + 1))
        best = [_Best(k) for _ in range(n_queries)]

        def settle(rows):
            ids = [x for b in rows for x in b[0]]
            n, own, term, tf = [], [], [], []
            base = 0
            for _, size, lengths, h, c in rows:
                place = np.searchsorted(vocabulary, h)
                place[place == len(vocabulary)] = 0
                hit = np.flatnonzero(vocabulary[place] == h) if len(vocabulary) else np.zeros(0, np.int64)
                own.append(np.repeat(np.arange(len(lengths)) + base, lengths)[hit])
                term.append(place[hit])
                tf.append(c[hit].astype(np.int64))
                n.append(size)
                base += len(lengths)
            n, own, term, tf = (np.concatenate(x) for x in (n, own, term, tf))
            m = length_share(n, count, total)
            value = SCALE * tf // (PARTS * tf + HALF * m[own])
            # terms of this chunk only, so that a tree's arrays follow the chunk
            here, local = np.unique(term, return_inverse=True)
            if not len(here):
                return
            first = np.searchsorted(own, np.arange(base + 1))
            tree = Tree(first, local, value * root[here][local], len(here), leaf, groups)
            place = np.full(len(vocabulary), -1)
            place[here] = np.arange(len(here))
            step = max(1, (1 << 22) // max(1, len(here)))  # queries whose dense rows take 32 MB
            for low in range(0, n_queries, step):
                some = range(low, min(low + step, n_queries))
                terms = [place[code[order[of[q] : of[q + 1]]]] for q in some]
                dense = np.zeros((len(some), len(here)))
                for i, t in enumerate(terms):
                    dense[i, t[t >= 0]] = root[here[t[t >= 0]]]
                bounds = tree.bound(dense)
                for i, q in enumerate(some):
                    exact = np.zeros(len(here), np.int64)
                    t = terms[i][terms[i] >= 0]
                    exact[t] = w[here[t]]

                    def score(rows, exact=exact, best=best[q]):
                        lengths = first[rows + 1] - first[rows]
                        at = kernel.ragged(first[rows], lengths)
                        sums = np.concatenate([[0], np.cumsum(exact[local[at]] * value[at])])
                        ends = np.cumsum(lengths)
                        best.add(sums[ends] - sums[ends - lengths], [ids[r] for r in rows])

                    tree.search(bounds[i], score, best[q].floor)

        held, rows = 0, []
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                part = batch.slice(a, chunk)
                hashes_, counts_ = part.column("terms"), part.column("tf")
                lengths = np.diff(np.asarray(hashes_.offsets))
                rows.append((part.column("doc_id").to_pylist(), np.asarray(part.column("n")), lengths, np.asarray(hashes_.flatten()), np.asarray(counts_.flatten())))
                held += part.num_rows
                if held >= chunk:
                    settle(rows)
                    held, rows = 0, []
        if rows:
            settle(rows)
        found = [(q, *r) for q, b in enumerate(best) for r in b.rows]
        columns = list(zip(*found)) if found else [[], [], []]
        kinds = [pa.int32(), pa.int64(), out]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query", "score", "doc_id"])

    return run


def bitmap_of(terms: DataFrame) -> np.ndarray:
    """Bitmap of 2**BITS cells of the hashes `h`; at most 512 rows of 4 KB come to the driver."""
    bit = F.shiftrightunsigned("h", 64 - BITS) + 1
    found = terms.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    for r in found:
        at = (r.bucket - 1) * 4096
        bitmap[at : at + 4096] |= np.frombuffer(bytes(r.bits), np.uint8)
    return bitmap


def blocks(queries: DataFrame, size: int) -> DataFrame:
    """Queries (query, terms) with a block number: about `size` terms of consecutive queries, one query at least."""
    # running sum over ranges of queries: the table of ranges is small
    some = queries.withColumn("part", F.floor(F.col("query") / 4096))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = some.groupBy("part").agg(F.sum("n_terms").alias("sum")).withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("query").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("inside", F.coalesce(F.sum("n_terms").over(inside), F.lit(0))).join(parts.select("part", "before"), "part")
    return some.withColumn("block", F.floor((F.col("before") + F.col("inside")) / size)).drop("part", "inside", "before")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, chunk: int = CHUNK, leaf: int = LEAF, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """The k best documents (doc_id, text) of each query (item_id, text): item_id, query (number of the distinct query), rank,
    doc_id, score (above 0)."""
    spark = docs.sparkSession
    ready(spark)

    def query_terms(batches):
        for batch in batches:
            n, hashes, _ = _vectors(batch.column("text"), None)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), hashes], names=["item_id", "terms"])

    kind = queries.schema["item_id"].dataType.simpleString()
    asked = queries.select("item_id", "text").distinct().mapInArrow(query_terms, f"item_id {kind}, terms array<bigint>")
    asked = materialise(asked.where(F.size("terms") > 0).withColumn("query", F.monotonically_increasing_id()), "queries")
    terms = materialise(asked.select("query", F.explode("terms").alias("h")), "query-terms")
    shared = spark.sparkContext.broadcast(bitmap_of(terms))

    def read(batches):
        for batch in batches:
            n, hashes, counts = _vectors(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), hashes, counts], names=["doc_id", "n", "terms", "tf"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    vectors = docs.select("doc_id", "text").mapInArrow(read, f"doc_id {id_kind}, n bigint, terms array<bigint>, tf array<int>")
    vectors = materialise(vectors.where("n > 0"), "vectors")
    shared.destroy()
    count, total = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    none = spark.createDataFrame([], f"item_id {kind}, query bigint, rank int, doc_id {id_kind}, score bigint")
    if not count:
        return none

    def frequencies(batches):
        """Documents that hold each term, summed over a batch."""
        for batch in batches:
            h, n = np.unique(np.asarray(batch.column("terms").flatten()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "df"])

    df = vectors.select("terms").mapInArrow(frequencies, "h bigint, df bigint").groupBy("h").agg(F.sum("df").alias("df"))
    weighed = df.withColumn("w", weight(F.lit(count).cast("bigint"), F.col("df"))).where("w > 0")
    weighed = materialise(terms.join(weighed, "h").select("query", "h", "w"), "weights")
    sized = blocks(weighed.groupBy("query").agg(F.count(F.lit(1)).alias("n_terms")), block)
    sized = materialise(sized.select("query", "block"), "blocks")
    found = none.select("query", "doc_id", "score")
    for (at,) in sized.select("block").distinct().orderBy("block").collect():  # one number for each `block` terms
        rows = weighed.join(sized.where(F.col("block") == at), "query").select("query", "h", "w").orderBy("h").toArrow()
        ids, number = np.unique(np.asarray(rows.column("query")), return_inverse=True)
        held = spark.sparkContext.broadcast((number, np.asarray(rows.column("h")), np.asarray(rows.column("w"))))
        out = pa.int64() if id_kind == "bigint" else _arrow(docs, "doc_id")
        part = vectors.mapInArrow(_search(held, count, total, k, chunk, leaf, groups, out), f"query int, score bigint, doc_id {id_kind}")
        names = F.broadcast(spark.createDataFrame(list(enumerate(ids.tolist())), "query int, named bigint"))  # at most `block` queries
        part = part.join(names, "query").select(F.col("named").alias("query"), "doc_id", "score")
        found = found.unionByName(materialise(part, "found"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", "query", "rank", "doc_id", "score")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


_SQL = rf"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
d AS (SELECT r, doc_id, t, len(t) AS n FROM words WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS n, sum(n)::BIGINT AS l FROM d),
tf AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(t) AS w FROM d) GROUP BY r, w),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
wt AS (SELECT item_id, i.w, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS wt FROM i JOIN df ON df.w = i.w, s),
sc AS (
  SELECT item_id, tf.r, sum(wt * (({SCALE} * tf.tf) // ({PARTS} * tf.tf + {HALF} * (100 - {FULL} + ({FULL} * d.n * s.n) // s.l))))::BIGINT AS score
  FROM wt JOIN tf ON tf.w = wt.w JOIN d ON d.r = tf.r, s GROUP BY item_id, tf.r),
rk AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM sc JOIN d ON d.r = sc.r WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM rk WHERE rank <= {TOP}
"""


@query("op12_ball_tree", _SQL)
def op12(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")
