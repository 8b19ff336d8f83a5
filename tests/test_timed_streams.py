"""Operators on event time: any cut into micro-batches, restarts, keys that get no more rows, state that goes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from groveflow.operators import trees as TR
from groveflow.session import scratch_path
from groveflow.streaming import timed as T
from groveflow.streaming.run import by_batch, each_batch, stream_of, to_table

BASE = dt.datetime(2024, 1, 1)
ITEM = "snapshot string, lane int, node_id bigint, at timestamp, kind string, c double"


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def fed(spark, parts, schema, make, run, name="t"):
    """Each part is appended to the source and run as a stream of its own, on the state of the one before."""
    source, out, state = (scratch_path(spark, f"{name}-{x}") for x in ("src", "out", "state"))
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        run(make(spark.readStream.schema(schema).parquet(source)), out, state)
    return out, state


def plain_queue(rows, capacity, timeout, queues):
    """Flushes by going through each lane's rows in order of time."""
    out, lanes = [], {}
    for snapshot, lane, node, when, kind, _ in sorted(rows, key=lambda r: (r[3], r[4] == "end", r[2])):
        lanes.setdefault((snapshot, lane), []).append(((when - BASE).total_seconds(), kind, node))
    for key, items in lanes.items():
        held, count = [[] for _ in range(queues)], [0] * queues

        def flush(q, reason, key=key, held=held, count=count):
            out.extend((*key, q, count[q], reason, n) for _, n in held[q])
            held[q], count[q] = [], count[q] + 1

        for when, kind, node in [*items, (float("inf"), "tick", -1)]:
            for due, q in sorted((h[0][0] + timeout, q) for q, h in enumerate(held) if h and timeout):
                if due <= when:
                    flush(q, "timeout")
            if kind == "end":
                for q in range(queues):
                    if held[q]:
                        flush(q, "drain")
            if kind == "item":
                q = min(range(queues), key=lambda i: (len(held[i]), i))
                held[q].append((when, node))
                if len(held[q]) >= capacity:
                    flush(q, "capacity")
    return sorted(out)


def queue_rows():
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(3)}", rng.randrange(2), i, at(rng.randrange(600)), "item", float(i % 7)) for i in range(200)]
    return sorted([*rows, ("s0", 0, -1, at(300), "end", None), ("s1", 1, -1, at(599), "end", None)], key=lambda r: r[3])


TICK = ("tick", 0, -1, at(5000), "tick", None)


@pytest.mark.parametrize("cut", [1, 4])
@pytest.mark.parametrize("queues", [1, 2])
def test_queue_is_the_same_for_any_cut(spark, cut, queues):
    rows = queue_rows()
    size = -(-len(rows) // cut)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    for part in parts:
        random.Random(1).shuffle(part)
    make = lambda s: T.timed_queue(s, 4, 25.0, "100 seconds", queues)
    out, _ = fed(spark, [*parts, [TICK]], ITEM, make, lambda s, out, state: to_table(s, "q", out=out, state=state))
    got = spark.read.parquet(out).drop("flushed_at").where("snapshot <> 'tick'")
    assert sorted(tuple(r) for r in got.collect()) == plain_queue(rows, 4, 25.0, queues)


def test_idle_queue_flushes_without_a_new_row(spark):
    """The only row of a lane leaves by its timer, when another lane's row has moved the watermark."""
    first, other = ("s", 0, 1, at(0), "item", 0.5), ("s", 9, 2, at(60), "item", 0.5)
    make = lambda s: T.timed_queue(s, 3, 10.0, carry=["c"])
    out, state = fed(spark, [[first], [other]], ITEM, make, lambda s, out, state: to_table(s, "q", out=out, state=state))
    assert [(r.lane, r.reason, r.node_id, r.c, r.flushed_at) for r in spark.read.parquet(out).collect()] == [(0, "timeout", 1, 0.5, at(10))]
    left = spark.read.format("statestore").option("stateVarName", "queued").load(state)
    assert left.count() == 1  # the other lane's item waits on


@pytest.mark.parametrize("cut", [1, 3])
def test_allocation_follows_the_queue(spark, cut):
    """Queue, flush groups and exact allocation in one stream equal the batch allocation of each flush, restarts included."""
    from groveflow.operators import allocation as AL
    from groveflow.plans.streams import allocated_flushes

    rng = random.Random(6)
    schema = "snapshot string, lane int, node_id bigint, at timestamp, kind string, node string, default_k bigint, predicted_k bigint, c double"
    rows = [("p", rng.randrange(4), i, at(i * 3), "item", f"n{i:04d}", 4, 1 + i % 8, rng.random()) for i in range(120)]
    tick = [("tick", 0, -1, at(9000 + i), "tick", None, None, None, None) for i in range(2)]
    size = -(-len(rows) // cut)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    allocate = allocated_flushes(stream_of(spark.createDataFrame(rows, schema), "x"), 40.0)[1]
    out, _ = fed(spark, [*parts, tick], schema, lambda s: allocated_flushes(s, 40.0)[0], lambda s, out, state: each_batch(s, "a", by_batch(out, allocate), state=state))
    got = {r.node_id: (r.queue, r.flush, r.reason, r.k) for r in spark.read.parquet(out).collect()}
    flushed = plain_queue([(*r[:5], None) for r in rows], 8, 40.0, 1)
    nodes = {r[2]: r for r in rows}
    flat = spark.createDataFrame([(lane, flush, reason, *nodes[n][5:]) for _, lane, _, flush, reason, n in flushed], "queue bigint, flush bigint, reason string, node_id string, default_k bigint, predicted_k bigint, c double")
    budget = flat.groupBy("queue", "flush").agg((F.sum("default_k") + F.max(F.when(F.col("queue") % 5 == 0, 60).otherwise(0))).alias("budget"))
    want = AL.allocate(AL.bounds(flat, budget, n_min=1, max_k=12, repair_k=14)).collect()
    assert len(got) == len(rows) and got == {r.node_id: (r.queue, r.flush, r.reason, r.k) for r in want}


def test_whole_numbers_beside_nulls(spark):
    """A batch that holds a null in a column of whole numbers hands it to Python as floats; items keep their numbers."""
    schema = "snapshot string, lane int, node_id bigint, at timestamp, kind string, k bigint, flag boolean"
    rows = [("p", 0, 1, at(0), "item", 4, True), ("p", 0, 2, at(1), "item", None, None), ("tick", 0, -1, at(50), "tick", None, None)]
    got = to_table(T.timed_queue(stream_of(spark.createDataFrame(rows, schema).coalesce(1), "q"), 3, 10.0, carry=["k", "flag"]), "f").collect()
    assert sorted((r.node_id, r.k, r.flag) for r in got) == [(1, 4, True), (2, None, None)]


def test_batches_replace_themselves(spark):
    out = scratch_path(spark, "by-batch")
    write = by_batch(out, lambda df: df.withColumn("twice", F.col("id") * 2))
    write(spark.range(3), 0)
    write(spark.range(5), 1)
    write(spark.range(3), 0)
    assert sorted((r.batch, r.id, r.twice) for r in spark.read.parquet(out).collect()) == [(0, i, 2 * i) for i in range(3)] + [(1, i, 2 * i) for i in range(5)]


STATUS = "run bigint, iteration int, progress boolean, at timestamp"


def test_silent_run_is_aborted_and_forgotten(spark):
    rows = [[(1, 0, False, at(0)), (2, 0, True, at(0)), (1, 1, False, at(5))], [(2, 1, False, at(12))], [(2, 2, False, at(50)), (1, 2, False, at(50))], [(-1, 0, None, at(100))]]
    make = lambda s: T.idle_runs(s, 3, 10.0)
    out, state = fed(spark, rows[:2], STATUS, make, lambda s, out, state: to_table(s, "i", out=out, state=state))
    read = lambda: sorted((r.run, r.iteration, r.idle, r.abort, r.reason) for r in spark.read.parquet(out).collect())
    first = read()
    assert (2, 0, 0, True, "silent") in first and (1, 1, 2, True, "silent") not in first  # run 1 is silent from second 15 on
    out, state = fed(spark, rows, STATUS, make, lambda s, out, state: to_table(s, "i", out=out, state=state))
    assert read() == [
        (1, 0, 1, False, "counted"), (1, 1, 2, False, "counted"), (1, 1, 2, True, "silent"), (1, 2, 1, False, "counted"), (1, 2, 1, True, "silent"),
        (2, 0, 0, False, "counted"), (2, 0, 0, True, "silent"), (2, 1, 1, False, "counted"), (2, 1, 1, True, "silent"), (2, 2, 1, False, "counted"), (2, 2, 1, True, "silent"),
    ]
    assert spark.read.format("statestore").option("stateVarName", "idle").load(state).count() == 0


TEXT = "parent bigint, i bigint, text string, last boolean, at timestamp"


@pytest.mark.parametrize("cut", [1, 3])
def test_acceptance_in_a_stream_equals_the_batch(spark, cut):
    rng = random.Random(9)
    words = "a b c d e".split()
    rows = [(p, i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))), i == 5, at(i * 10 + p)) for p in range(6) for i in range(6)]
    rows[3] = (*rows[3][:2], None, *rows[3][3:])
    rows.sort(key=lambda r: r[4])
    size = -(-len(rows) // cut)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    make = lambda s: T.diverse_stream(s, 0.2, 1000.0)
    out, state = fed(spark, [*parts, [(-1, 0, "", False, at(3000))]], TEXT, make, lambda s, out, state: to_table(s, "d", out=out, state=state))
    texts = spark.createDataFrame([(p, i, t or "") for p, i, t, _, _ in rows], "parent bigint, i bigint, text string")
    want = TR.diverse_acceptance(texts, TR.pair_bleu(texts, order=2), 0.2, F.col("i") == 5)
    got = sorted((r.parent, r.i) for r in spark.read.parquet(out).collect() if r.parent >= 0)
    assert got == sorted((r.parent, r.i) for r in want.collect()) and 6 < len(got) < 36
    assert spark.read.format("statestore").option("stateVarName", "seen").load(state).where("key.parent >= 0").count() == 0
