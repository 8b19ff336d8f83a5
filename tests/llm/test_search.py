"""Ball-tree search: the small tables, hand-made cases and random rows against scoring everything."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import PATH, key, rows

from groveflow.llm import balltree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    docs = [(d, terms(t)) for d, t in docs]
    docs = [x for x in docs if x[1]]
    n, total = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for d, t in docs:
            m = 100 - 90 + 90 * len(t) * n // total
            score = 0
            for w in set(terms(text)):
                tf = t.count(w)
                if tf:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((score, d))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
        out += [(item, i, d, s) for i, (s, d) in enumerate(found[:k], 1)]
    return out


def got(frame):
    return [tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()]


def test_search_table(spark):
    assert sorted(got(balltree.op12(spark, PATH))) == sorted(plain(rows("documents"), rows("benchmark", "item_id")))


def test_search_twin(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({balltree._SQL})").fetchall()
    assert sorted(got(balltree.op12(spark, PATH))) == sorted(want)


DOCS = [(5, "A b c"), (3, "a b c"), (3, "a b c"), (None, "a b c"), (9, None), (10, " ,;"), (11, "d"), (12, "a " * 5000), (13, "é É ab9"), (14, "c c c x y z")]
ITEMS = [(1, "a"), (2, "A A b"), (3, None), (4, "..."), (5, "nowhere"), (6, "É ab9"), (None, "c"), (7, "c x"), (7, "c x"), (7, "d")]


@pytest.mark.parametrize("chunk,leaf,block", [(1, 1, 1), (3, 1, 2), (4096, 32, 1 << 15)])
def test_search_cases(spark, chunk, leaf, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("terms", F.lit("x")).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("query", F.lit(1)).withColumn("h", F.lit(0))
    found = got(balltree.search(docs, items, k=3, chunk=chunk, leaf=leaf, block=block))
    assert sorted(found, key=key) == sorted(plain(DOCS, ITEMS, 3), key=key)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(balltree.search(docs.limit(0), items)) == [] and got(balltree.search(docs, items.limit(0))) == []
    assert got(balltree.search(docs.where("text IS NULL"), items)) == []


def test_search_by_names(spark):
    docs, items = [("b", "x y"), ("a", "x y"), ("é", "x")], [("q", "x")]
    found = balltree.search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert sorted(got(found)) == sorted(plain(docs, items)) and {r[2] for r in got(found)} == {"a", "b", "é"}


def test_search_random(spark):
    """Copies beyond k, ties, and items of many blocks."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words[: rng.randrange(1, 40)]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 30))) for i in range(300)]
    docs += [(1000 - i, docs[7][1]) for i in range(60)]
    items = [(i, text(rng.randrange(0, 9))) for i in range(40)] + [(99, docs[7][1])]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(plain(docs, items))
    for chunk, leaf, block in ((50, 4, 20), (7, 2, 1 << 15)):
        assert sorted(got(balltree.search(*frames, chunk=chunk, leaf=leaf, block=block))) == want


def test_bounds_hold_and_prune():
    """No row's product is above the bound of any of its subtrees; copies of the query's own row prune nearly all leaves."""
    rng = np.random.default_rng(1)
    n, v = 600, 50
    dense = np.where(rng.random((n, v)) < 0.15, rng.integers(1, 9, (n, v)) * 1000.0, 0.0)
    own, term = np.nonzero(dense)
    first = np.searchsorted(own, np.arange(n + 1))
    tree = balltree.Tree(first, term, dense[own, term], v, 8, 16)
    queries = np.where(rng.random((20, v)) < 0.2, rng.random((20, v)), 0.0)
    queries[0] = dense[3]
    bound, real = tree.bound(queries), queries @ dense.T
    for node, (a, b) in enumerate(tree.bounds):
        assert (bound[:, node] >= real[:, tree.rows[a:b]].max(axis=1)).all()
    assert sorted(tree.rows) == list(range(n))
    seen, best = [], [0.0]

    def score(some):
        seen.extend(some)
        best[0] = max(best[0], real[0, some].max())

    tree.search(bound[0], score, lambda: best[0])
    assert best[0] == real[0].max() and len(seen) < n
    lone = balltree.Tree(np.arange(2), np.zeros(1, np.int64), np.ones(1), 1, 8, 4)
    assert lone.bound(np.ones((1, 1)))[0, 0] >= 1
    same = balltree.Tree(np.arange(101), np.zeros(100, np.int64), np.full(100, 5.0), 1, 8, 4)  # equal rows are split all the same
    assert max(b - a for (a, b), c in zip(same.bounds, same.children) if c is None) <= 8


def test_lengths_beyond_64_bits():
    assert balltree.length_share(np.array([3, 10**7]), 10**13, 10**15).tolist() == [10 + 90 * 3 * 10**13 // 10**15, 10 + 90 * 10**7 * 10**13 // 10**15]
