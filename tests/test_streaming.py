"""Streams over several micro-batches: state is carried, nothing is lost, transactions hold."""

import pytest
from pyspark.sql import functions as F

from groveflow.streaming import operators as S
from groveflow.streaming.replay import ReplayTable
from groveflow.streaming.run import stream_of, to_table

ITEM = "snapshot string, lane int, node_id bigint, at double, kind string"


def test_queue_timeout_and_drain(spark):
    rows = [("s", 0, i, float(t), "item") for i, t in enumerate([0, 1, 20, 21, 22, 23])] + [("s", 0, -1, 99.0, "end")]
    df = spark.createDataFrame(rows, ITEM)
    got = [tuple(r) for r in to_table(S.budget_queue(stream_of(df, "q"), 3, timeout=10.0), "f").orderBy("flush", "node_id").select("flush", "reason", "node_id").collect()]
    assert got == [(0, "timeout", 0), (0, "timeout", 1), (1, "capacity", 2), (1, "capacity", 3), (1, "capacity", 4), (2, "drain", 5)]


def test_queue_joins_the_shortest(spark):
    df = spark.createDataFrame([("s", 0, i, float(i), "item") for i in range(5)] + [("s", 0, -1, 9.0, "end")], ITEM)
    got = {r.node_id: r.queue for r in to_table(S.budget_queue(stream_of(df, "q"), 3, queues=2), "f").collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0}


def test_queue_state_survives_batches(spark):
    items = spark.createDataFrame([(f"s{i % 3}", 0, i, float(i), "item") for i in range(30)], ITEM).repartitionByRange(3, "at")
    rows = to_table(S.budget_queue(stream_of(items, "q", 1), 4), "f").collect()
    assert len(rows) == 24 and {r.reason for r in rows} == {"capacity"}
    assert len({r.node_id for r in rows}) == 24


def table(spark):
    return ReplayTable(spark, 3, "edge_id bigint, question_id bigint, iteration int, advantage double")


def edges(spark, ids, iteration):
    return spark.createDataFrame([(i, i % 4, iteration, 0.1) for i in ids], "edge_id bigint, question_id bigint, iteration int, advantage double")


def test_replay_transactions(spark):
    t = table(spark)
    t.add(edges(spark, range(10), 0), 0)
    with pytest.raises(ValueError):
        t.add(edges(spark, [10, 10], 1), 1)
    with pytest.raises(ValueError):
        t.add(edges(spark, [3], 1), 1)
    assert t.read().count() == 10
    picked = t.reserve("r", cap=1, target=3)
    assert picked.count() == 3
    t.add(edges(spark, range(20, 25), 5), 2)  # age 5 expires the old free rows, reserved ones stay
    assert t.read().where("status = 'r'").count() == 3 and t.read().count() == 8
    t.rollback("r")
    assert t.read().where("status = 'free'").count() == 8
    t.reserve("x", cap=9, target=2)
    t.commit("x")
    assert t.read().count() == 6


def test_replay_survives_retry_and_restart(spark):
    t = table(spark)
    t.add(edges(spark, range(10), 0), 0)
    t.add(edges(spark, range(20, 25), 1), 1)
    t.add(edges(spark, range(20, 25), 1), 1)  # the last batch again
    assert t.read().count() == 15
    again = ReplayTable(spark, 3, t.schema, t.root)
    assert sorted(r.edge_id for r in again.read().collect()) == sorted(r.edge_id for r in t.read().collect())
    again.add(edges(spark, range(20, 25), 1), 1)
    again.reserve("r", cap=1, target=2)
    again.add(edges(spark, range(20, 25), 1), 1)  # an earlier batch again: already in
    assert again.read().count() == 15
    again.add(edges(spark, [30], 9).unionByName(edges(spark, [31], 2)), 2)
    assert again.late(2) == 1 and again.late(1) == 0 and again.late(7) is None


def test_stream_goes_on_from_its_state(spark):
    from groveflow.session import scratch_path

    source, out, state = (scratch_path(spark, n) for n in ("src", "out", "state"))
    for part in (range(3), range(3, 5)):
        spark.createDataFrame([(i,) for i in part], "i bigint").write.mode("append").parquet(source)
        got = to_table(spark.readStream.schema("i bigint").parquet(source), "t", out=out, state=state)
    assert sorted(r.i for r in got.collect()) == list(range(5))


def test_idle_counter_over_batches(spark):
    s = spark.createDataFrame([(1, i, i == 2) for i in range(8)], "run bigint, iteration int, progress boolean").repartitionByRange(4, "iteration")
    df = s.coalesce(1)
    got = [r.idle for r in to_table(S.idle_counter(stream_of(df, "s"), 3), "i").orderBy("iteration").collect()]
    assert got == [1, 2, 0, 1, 2, 3, 4, 5]


def test_full_batches_wait_for_more(spark):
    g = spark.createDataFrame([("a", i, i % 2 == 0) for i in range(20)], "lane string, uid bigint, varied boolean").repartitionByRange(4, "uid")
    rows = to_table(S.full_batches(stream_of(g, "g", 1), 4), "b").collect()
    assert len(rows) == 8 and all(r.uid % 2 == 0 for r in rows)
