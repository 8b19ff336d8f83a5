"""Stateful streaming operators. Per-key state is bounded (queue capacity, one counter, a few moments); a key
includes a lane (hash of the row id), so that one busy snapshot or source spreads over many keys."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lane(col: str, lanes: int):
    return F.pmod(F.xxhash64(col), F.lit(lanes)).cast("int")


def budget_queue(items: DataFrame, capacity: int, queues: int = 1, timeout: float = 0.0) -> DataFrame:
    """Online budget queue: flushed items with queue, flush number and reason.

    items: snapshot, lane, node_id, at (seconds), kind ('item' or 'end'). A node joins the shortest queue of its
    (snapshot, lane); a queue flushes when it reaches its capacity or when `timeout` seconds passed since its first
    item; an 'end' row drains all queues. Snapshots never mix because the snapshot is part of the key.
    """
    out = "snapshot string, lane int, queue int, flush int, reason string, node_id bigint"
    state = "ids array<array<bigint>>, first array<double>, flushes array<int>"

    def step(key, batches, st):
        ids, first, flushes = (
            [list(x) for x in st.get[0]], list(st.get[1]), list(st.get[2])
        ) if st.exists else ([[] for _ in range(queues)], [0.0] * queues, [0] * queues)
        rows = pd.concat(list(batches)).assign(end=lambda d: d["kind"] == "end").sort_values(["end", "at", "node_id"])
        done = []

        def flush(q, reason):
            done.extend((key[0], key[1], q, flushes[q], reason, n) for n in ids[q])
            ids[q], flushes[q] = [], flushes[q] + 1

        for at, node, end in zip(rows["at"], rows["node_id"], rows["end"]):
            for q in range(queues):
                if ids[q] and end:
                    flush(q, "drain")
                elif ids[q] and timeout > 0 and at - first[q] >= timeout:
                    flush(q, "timeout")
            if end:
                continue
            q = min(range(queues), key=lambda i: (len(ids[i]), i))
            if not ids[q]:
                first[q] = float(at)
            ids[q].append(int(node))
            if len(ids[q]) >= capacity:
                flush(q, "capacity")
        st.update((ids, first, flushes))
        yield pd.DataFrame(done, columns=["snapshot", "lane", "queue", "flush", "reason", "node_id"])

    return items.groupBy("snapshot", "lane").applyInPandasWithState(step, out, state, "append", "NoTimeout")


def full_batches(groups: DataFrame, batch: int) -> DataFrame:
    """Dynamic sampling: kept groups (lane, uid, varied) leave in batches of exactly `batch`; the rest waits in
    state, which holds fewer than `batch` ids per lane."""
    out = "lane string, batch int, uid bigint"

    def step(key, parts, st):
        waiting, number = (list(st.get[0]), st.get[1]) if st.exists else ([], 0)
        rows = pd.concat(list(parts))
        waiting += sorted(int(u) for u in rows.loc[rows["varied"], "uid"])
        ready = []
        while len(waiting) >= batch:
            ready += [(key[0], number, u) for u in waiting[:batch]]
            waiting, number = waiting[batch:], number + 1
        st.update((waiting, number))
        yield pd.DataFrame(ready, columns=["lane", "batch", "uid"])

    return groups.groupBy("lane").applyInPandasWithState(step, out, "waiting array<bigint>, number int", "append", "NoTimeout")


def idle_counter(status: DataFrame, abort_after: int) -> DataFrame:
    """Consecutive iterations without progress per run, carried across batches."""
    out = "run bigint, iteration int, idle bigint, abort boolean"

    def step(key, parts, st):
        idle = st.get[0] if st.exists else 0
        rows = pd.concat(list(parts)).sort_values("iteration")
        res = []
        for it, progress in zip(rows["iteration"], rows["progress"]):
            idle = 0 if progress else idle + 1
            res.append((key[0], int(it), idle, idle >= abort_after))
        st.update((int(idle),))
        yield pd.DataFrame(res, columns=["run", "iteration", "idle", "abort"])

    return status.groupBy("run").applyInPandasWithState(step, out, "idle bigint", "append", "NoTimeout")


def running_moments(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, population variance and Bessel deviation over all batches so far (partial aggregates in state)."""
    x = F.col(value)
    return rows.groupBy(key).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.stddev_samp(x).alias("std")
    )


def adaptive_rounds(rollouts: DataFrame, per_round: int, max_rounds: int, limit: float) -> DataFrame:
    """Replay of adaptive sampling over stored rollouts: the first round whose confidence interval is at most
    `limit`, else the last. Only the first per_round * max_rounds rollouts of a prompt can matter."""
    from pyspark.sql import Window

    from ..functions.numeric import ci_length
    from ..operators.spread import first_k

    rows = first_k(rollouts, ["uid"], [F.col("rollout_id")], per_round * max_rounds, "__r")
    rows = rows.withColumn("round", F.floor((F.col("__r") - 1) / per_round) + 1)
    per = rows.groupBy("uid", "round").agg(F.sum("correct").alias("s"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("uid").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"s": F.sum("s").over(w), "n": F.sum("c").over(w)}).withColumn("p", F.col("s") / F.col("n"))
    stop = ci_length(F.col("p"), F.col("n")) <= limit
    return per.groupBy("uid").agg(
        F.coalesce(F.min(F.when(stop, F.col("round"))), F.max("round")).alias("rounds"), F.max("round").alias("available")
    )
