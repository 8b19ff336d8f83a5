"""Hot-group helpers: salted joins, bucketed ranks, running sums, as-of lookups, exact quantiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groveflow.operators import spread as SP


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(0 if rng.random() < 0.4 else rng.randrange(1, 60), i, float(rng.choice([rng.random() * 1e6, rng.randrange(5)]))) for i in range(3000)]
    return spark.createDataFrame(data, "g int, id bigint, v double").repartition(7).cache(), data


@pytest.mark.parametrize("salts", [1, 64])
def test_salted_stats_equal_plain_ones(rows, salts):
    df, data = rows
    got = {r.id: (r.n, round(r.s, 3)) for r in SP.attach_stats(df, ["g"], {"n": F.count(F.lit(1)), "s": F.sum("v")}, ["id"], salts=salts).collect()}
    want = {}
    for g, _, v in data:
        n, s = want.get(g, (0, 0.0))
        want[g] = n + 1, s + v
    assert got == {i: (want[g][0], round(want[g][1], 3)) for g, i, _ in data}


def test_hot_rows_spread_over_salts(rows):
    df, _ = rows
    stats = df.groupBy("g").agg(F.count(F.lit(1)).alias("__n"))
    plan = SP.join_stats(df, stats, ["g"], ["id"])._jdf.queryExecution().toString()
    assert "__spread_salt" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("odd", [1e12, float("inf"), float("-inf"), float("nan")])
def test_outliers_leave_buckets_even(spark, odd):
    df = spark.range(100_000).select((F.col("id") / 100_000).alias("v")).unionByName(spark.createDataFrame([(odd,)], "v double"))
    sizes = [r["count"] for r in SP.with_bucket(df, SP.value_bucket(df, F.col("v"))).groupBy("__spread_cell").count().collect()]
    assert len(sizes) == 256 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_null_keys_and_values_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 1.0), (1, 3, 5.0), (1, 4, None)], "g int, id bigint, v double")
    order = [F.col("v").asc_nulls_first(), F.col("id")]
    assert {r.id: r["rank"] for r in SP.ranked(df, ["g"], order, SP.value_bucket(df, F.col("v"))).collect()} == {1: 2, 2: 1, 3: 2, 4: 1}
    assert {r.id: r.n for r in SP.attach_stats(df, ["g"], {"n": F.count(F.lit(1))}, ["id"]).collect()} == {1: 2, 2: 2, 3: 2, 4: 2}
    assert {r.id: r.seen for r in SP.last_known(df, ["g"], [F.col("id")], SP.value_bucket(df, F.col("id")), F.col("v"), "seen").collect()} == {1: 2.0, 2: 1.0, 3: 5.0, 4: 5.0}


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_ranks(rows, keys):
    df, data = rows
    got = {r.id: r["rank"] for r in SP.ranked(df, keys, [F.col("v"), F.col("id")], SP.value_bucket(df, F.col("v"))).collect()}
    groups = {}
    for g, i, v in data:
        groups.setdefault(g if keys else 0, []).append((v, i))
    want = {i: n for members in groups.values() for n, (_, i) in enumerate(sorted(members), 1)}
    assert got == want


def test_quantiles(rows):
    df, data = rows
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r.prob: r.value for r in SP.exact_quantiles(df, F.col("v"), probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile([d[2] for d in data], p))
    by = {(r.g, r.prob): r.value for r in SP.exact_quantiles(df, F.col("v"), [0.25], ["g"]).collect()}
    assert by[(0, 0.25)] == pytest.approx(np.quantile([d[2] for d in data if d[0] == 0], 0.25))


def test_last_known(spark):
    data = [(i, float(i) if i % 7 == 3 else None) for i in range(500)]
    df = spark.createDataFrame(data, "x bigint, v double").repartition(5)
    got = {r.x: r.seen for r in SP.last_known(df, [], [F.col("x")], SP.value_bucket(df, F.col("x"), 32), F.col("v"), "seen").collect()}
    last = None
    for x, v in data:
        last = v if v is not None else last
        assert got[x] == last


def test_result_is_independent_of_partitioning(rows):
    from groveflow.operators.sampling import shuffled, subset

    df, _ = rows
    a = sorted((r.id, r.pos) for r in shuffled(df, "id", 3).collect())
    b = sorted((r.id, r.pos) for r in shuffled(df.repartition(1), "id", 3).collect())
    assert a == b
    assert sorted(r.id for r in subset(df, "id", 40, 9).collect()) == sorted(r.id for r in subset(df.repartition(3), "id", 40, 9).collect())


def test_callers_columns_survive(spark):
    """Columns that look like helpers stay as they are, many rows stand in each bucket, and the module's own names are refused."""
    rng = random.Random(4)
    data = [(rng.randrange(3), i, rng.random(), rng.random()) for i in range(600)]
    plain = spark.createDataFrame(data, "g int, id bigint, v double, w double")
    names = ["__k", "__b", "__o", "__n", "__salt", "__v", "__s", "__hot", "__rn"]
    df = plain.withColumns({n: F.col("w") + i for i, n in enumerate(names)})
    order, bucket = [F.col("__k"), F.col("id")], F.floor(F.col("__k") * 4).cast("int")
    place = {}
    for g in range(3):
        members = sorted((r for r in data if r[0] == g), key=lambda r: (r[3], r[1]))
        place |= {r[1]: (n, r[2]) for n, r in enumerate(members, 1)}
        total = 0.0
        for r in members:
            total += r[2]
            place[r[1]] = (place[r[1]][0], total, r[2])
    frames = {
        "rank": SP.ranked(df, ["g"], order, bucket, "got"),
        "sum": SP.running_sum(df, ["g"], order, bucket, {"got": F.col("v")}),
        "last": SP.last_known(df, ["g"], order, bucket, F.col("v"), "got"),
        "stats": SP.attach_stats(df, ["g"], {"got": F.count(F.lit(1))}, ["id"]),
        "first": SP.first_k(df, ["g"], order, 1000, "got"),
    }
    sizes = {g: sum(r[0] == g for r in data) for g in range(3)}
    for kind, frame in frames.items():
        found = frame.collect()
        assert len(found) == len(data), kind
        for r in found:
            want = {"rank": place[r.id][0], "first": place[r.id][0], "sum": place[r.id][1], "last": place[r.id][2], "stats": sizes[r.g]}[kind]
            assert r.got == pytest.approx(want), kind
            assert [r[n] for n in names] == [data[r.id][3] + i for i, n in enumerate(names)], kind
    for name in ("__spread_key", "__spread_cell"):
        with pytest.raises(ValueError):
            SP.attach_stats(df.withColumn(name, F.lit(1)), ["g"], {"got": F.count(F.lit(1))}, ["id"])
    with pytest.raises(ValueError):
        SP.ranked(df.withColumn("__spread_key", F.lit(1)), ["g"], order, bucket)
    with pytest.raises(ValueError):
        SP.join_stats(df, df.groupBy("g").agg(F.count(F.lit(1)).alias("__n")), ["g"], ["id"])
