"""Stateful operators on event time: rows wait in state until the watermark has passed them and are then taken in the order
of their event time. Results therefore do not depend on how a stream is cut into micro-batches, and a key that gets no
more rows goes on by timers: idle queues flush, silent runs are aborted, finished parents leave the state.

State of a key: the rows of the watermark's delay, and what the operator itself keeps (bounded, see each). Rows that come
later than the delay are dropped by Spark. All operators need the RocksDB state store (`rocksdb`).
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import FractionalType, IntegralType, StructType

_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
PACK = 4096  # waiting rows in one element of the state
STORE = "spark.sql.streaming.stateStore.providerClass"


def rocksdb(spark: SparkSession) -> None:
    """State with timers and lists needs RocksDB; a provider that the cluster chose stays."""
    if "HDFSBacked" in spark.conf.get(STORE, "HDFSBacked"):
        spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _plain(column: pd.Series, kind) -> list:
    """Python values, null as None: whole numbers come as floats where the batch holds a null, and must not go on as such."""
    values = column.tolist()
    if column.hasnans:
        return [None if pd.isna(x) else kind(x) if kind else x for x in values]
    return list(map(kind, values)) if kind else values


def _packs(rows: list[tuple]) -> list[tuple[bytes]]:
    return [(pickle.dumps(rows[at : at + PACK]),) for at in range(0, len(rows), PACK)]


class Ordered(StatefulProcessor):
    """Keeps rows (at_ms first, then `order`) until the watermark has passed them. Waiting rows are stored in packs of at most
    PACK, pickled tuples in the order of `columns`: every element of a state costs a call and a conversion.

    Subclasses give `columns` (of a stored row: at_ms bigint and what they need) and `out` (columns of a result row), and
    say what `take(row)` does, when they want to be woken (`deadline()`) and what happens then (`expire(now)`); both methods
    return result rows. `load` and `store` frame the work on one key.
    """

    columns: str
    names: list[str]
    kinds: list
    out: list[str]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.open(handle)

    def open(self, handle) -> None: ...

    def load(self, key) -> None: ...

    def store(self) -> None: ...

    def take(self, row: dict) -> list: ...

    def deadline(self) -> int | None:
        return None

    def expire(self, now: int) -> list:
        return []

    def _wake(self, times, now: int = -1) -> None:
        """One timer, for the earliest of the times; those up to `now` are just firing and go by themselves."""
        times = [t for t in times if t is not None]
        have = [t for t in self.handle.listTimers() if t > now]
        if times and (not have or min(times) < min(have)):
            self.handle.registerTimer(int(min(times)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, got = None, []
        for part in rows:
            if len(part):
                got += zip(*(_plain(part[c], kind) for c, kind in zip(self.names, self.kinds)))
                least = int(part["at_ms"].min())
                first = least if first is None else min(first, least)
        if got:
            self.waiting.appendList(_packs(got))
        self._wake([first])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [dict(zip(self.names, r)) for (pack,) in self.waiting.get() for r in pickle.loads(pack)]
        due = sorted((r for r in rows if r["at_ms"] <= now), key=self.order)
        later = [r for r in rows if r["at_ms"] > now]
        self.load(key)
        done = []
        for row in due:
            done += self.expire(row["at_ms"])
            done += self.take(row)
        done += self.expire(now)
        if later:
            self.waiting.put(_packs([tuple(r[c] for c in self.names) for r in later]))
        elif rows:
            self.waiting.clear()
        self.store()
        self._wake([min((r["at_ms"] for r in later), default=None), self.deadline()], now)
        if done:
            yield pd.DataFrame(done, columns=self.out)

    @staticmethod
    def order(row: dict):
        return row["at_ms"]

    def close(self) -> None: ...


def on_time(rows: DataFrame, keys: list[str], processor: Ordered, out: str, delay: str, event: str | None = None) -> DataFrame:
    """Run an ordered processor over rows with an event time `at`. `event`: the result's event time, for a next operator."""
    rocksdb(rows.sparkSession)
    rows = rows.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    fields = StructType.fromDDL(processor.columns).fields
    processor.names = [f.name for f in fields]
    processor.kinds = [int if isinstance(f.dataType, IntegralType) else float if isinstance(f.dataType, FractionalType) else None for f in fields]
    processor.out = StructType.fromDDL(out).fieldNames()
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime", None, event or "")


# budget queues -----------------------------------------------------------------------------------


class _Queues(Ordered):
    """State: at most `capacity` items in each queue, and a flush count."""

    columns = "at_ms bigint, node_id bigint, kind string"

    def __init__(self, capacity: int, queues: int, timeout_ms: int, carry: list[tuple[str, str]]):
        self.capacity, self.queues, self.timeout = capacity, queues, timeout_ms
        self.carry = [c for c, _ in carry]
        self.columns = ", ".join([_Queues.columns, *(f"{c} {k}" for c, k in carry)])

    def open(self, handle) -> None:
        self.queued = handle.getListState("queued", f"queue int, {self.columns}")
        self.counts = handle.getValueState("counts", "flushes array<int>")

    @staticmethod
    def order(row):
        return row["at_ms"], row["kind"] == "end", row["node_id"]

    def load(self, key) -> None:
        self.key = key
        self.items = [[] for _ in range(self.queues)]
        for queue, *row in self.queued.get() if self.queued.exists() else []:
            self.items[queue].append(dict(zip(self.names, row)))
        self.flushes = list(self.counts.get()[0]) if self.counts.exists() else [0] * self.queues

    def store(self) -> None:
        rows = [(q, *(r[c] for c in self.names)) for q, items in enumerate(self.items) for r in items]
        self.queued.put(rows) if rows else self.queued.clear()
        self.counts.update((self.flushes,))

    def _flush(self, q: int, reason: str, at: int) -> list:
        when = pd.Timestamp(at, unit="ms")
        done = [(*self.key, q, self.flushes[q], reason, r["node_id"], *(r[c] for c in self.carry), when) for r in self.items[q]]
        self.items[q], self.flushes[q] = [], self.flushes[q] + 1
        return done

    def _due(self) -> list[tuple[int, int]]:
        return sorted((items[0]["at_ms"] + self.timeout, q) for q, items in enumerate(self.items) if items) if self.timeout else []

    def deadline(self):
        return min((at for at, _ in self._due()), default=None)

    def expire(self, now):
        return [x for at, q in self._due() if at <= now for x in self._flush(q, "timeout", at)]

    def take(self, row):
        if row["kind"] == "end":
            return [x for q, items in enumerate(self.items) if items for x in self._flush(q, "drain", row["at_ms"])]
        if row["kind"] != "item":
            return []
        q = min(range(self.queues), key=lambda i: (len(self.items[i]), i))
        self.items[q].append(row)
        return self._flush(q, "capacity", row["at_ms"]) if len(self.items[q]) >= self.capacity else []


def timed_queue(items: DataFrame, capacity: int, timeout: float, delay: str = "0 seconds", queues: int = 1, carry: list[str] | None = None) -> DataFrame:
    """Online budget queue on event time: flushed items with queue, flush number, reason and flushed_at.

    items: snapshot, lane, node_id, at (timestamp), kind, and the columns `carry`. An 'item' joins the shortest queue of its
    (snapshot, lane); a queue flushes when it holds `capacity` items, or by a timer `timeout` seconds after its first
    item (0: never), whether or not another row comes; an 'end' row drains all queues; other kinds only move the watermark.
    A flush is one row per item, all in one micro-batch and of one event time, so operators on event time can follow.
    """
    kinds = dict(items.dtypes)
    carried = [(c, kinds[c]) for c in carry or []]
    extra = "".join(f", {c} {k}" for c, k in carried)
    out = f"snapshot string, lane int, queue int, flush int, reason string, node_id bigint{extra}, flushed_at timestamp"
    return on_time(items, ["snapshot", "lane"], _Queues(capacity, queues, round(timeout * 1000), carried), out, delay, "flushed_at")


def flush_groups(flushes: DataFrame, columns: list[str]) -> DataFrame:
    """One row per flush, with its nodes: a second stateful operator after `timed_queue`, which lets a flush go once the
    watermark has passed its second. A flush holds at most `capacity` nodes."""
    keys = ["snapshot", "lane", "queue", "flush", "reason"]
    group = flushes.groupBy(F.window("flushed_at", "1 second").alias("second"), *keys)
    return group.agg(F.sort_array(F.collect_list(F.struct("node_id", *columns))).alias("nodes")).select(*keys, "nodes")


# runs that fall silent ---------------------------------------------------------------------------


class _Idle(Ordered):
    """State: one counter and two times."""

    columns = "at_ms bigint, iteration int, progress boolean"

    def __init__(self, abort_after: int, silence_ms: int):
        self.abort_after, self.silence = abort_after, silence_ms

    def open(self, handle) -> None:
        self.state = handle.getValueState("idle", "idle bigint, iteration int, last bigint")

    @staticmethod
    def order(row):
        return row["at_ms"], row["iteration"]

    def load(self, key) -> None:
        now = self.state.get()
        self.key, self.now = key, tuple(now) if now is not None else None

    def store(self) -> None:
        self.state.update(self.now) if self.now else self.state.clear()

    def deadline(self):
        return self.now[2] + self.silence if self.now else None

    def expire(self, now):
        if not self.now or self.deadline() > now:
            return []
        idle, iteration, _ = self.now
        self.now = None
        return [(*self.key, iteration, idle, True, "silent")]

    def take(self, row):
        if row["progress"] is None:
            return []
        idle = 0 if row["progress"] else (self.now[0] if self.now else 0) + 1
        self.now = (idle, row["iteration"], row["at_ms"])
        return [(*self.key, row["iteration"], idle, idle >= self.abort_after, "counted")]


def idle_runs(status: DataFrame, abort_after: int, silence: float, delay: str = "0 seconds") -> DataFrame:
    """Iterations without progress in a row for each run, from (run, iteration, progress, at). A run without a row for
    `silence` seconds is aborted by a timer: a row with its last iteration and reason 'silent', and its state is gone; should
    it come back, it counts from the start. Rows without progress (null) only move the watermark."""
    out = "run bigint, iteration int, idle bigint, abort boolean, reason string"
    return on_time(status, ["run"], _Idle(abort_after, round(silence * 1000)), out, delay)


# diverse acceptance ------------------------------------------------------------------------------


class _Diverse(Ordered):
    """State: n-gram counts of the accepted texts of a parent, in a map by text number; gone when the parent is done."""

    columns = "at_ms bigint, i bigint, text string, last boolean"

    def __init__(self, threshold: float, order: int, silence_ms: int):
        self.threshold, self.grams, self.silence = threshold, order, silence_ms

    def open(self, handle) -> None:
        self.accepted = handle.getMapState("accepted", "i bigint", "size int, grams array<string>, counts array<int>")
        self.seen = handle.getValueState("seen", "last bigint")

    @staticmethod
    def order(row):
        return row["at_ms"], row["i"]

    def load(self, key) -> None:
        self.key = key
        self.texts = {k[0]: (v[0], dict(zip(v[1], v[2]))) for k, v in self.accepted.iterator()} if self.accepted.exists() else {}
        self.new, self.at, self.gone = [], self.seen.get()[0] if self.seen.exists() else None, False

    def store(self) -> None:
        if self.gone and self.at is None:
            self.accepted.clear()
            self.seen.clear()
            return
        if self.gone:
            self.accepted.clear()
        for i in self.new:
            size, grams = self.texts[i]
            self.accepted.updateValue((i,), (size, list(grams), list(grams.values())))
        if self.at is not None:
            self.seen.update((self.at,))

    def deadline(self):
        return None if self.at is None else self.at + self.silence

    def expire(self, now):
        if self.at is not None and self.at + self.silence <= now:
            self.texts, self.new, self.at, self.gone = {}, [], None, True
        return []

    def _bleu(self, a, b) -> float:
        """Sentence BLEU of a against b; 0 where an order has no match."""
        (size, mine), (ref, theirs) = a, b
        if size < self.grams or ref < self.grams:
            return 0.0
        hits = [0] * self.grams
        for g, c in mine.items():
            hits[g.count(" ")] += min(c, theirs.get(g, 0))
        if not all(hits):
            return 0.0
        logs = sum(math.log(m / (size - n)) for n, m in enumerate(hits)) / self.grams
        return math.exp(logs) * (1.0 if size > ref else math.exp(1 - ref / size))

    def take(self, row):
        words = [w for w in _BLANKS.split(row["text"] or "") if w]
        grams = {}
        for n in range(1, self.grams + 1):
            for p in range(len(words) - n + 1):
                g = " ".join(words[p : p + n])
                grams[g] = grams.get(g, 0) + 1
        mine = (len(words), grams)
        self.at = row["at_ms"]
        mean = sum(self._bleu(other, mine) for other in self.texts.values()) / max(len(self.texts), 1)
        if not row["last"] and mean > self.threshold:
            return []
        self.texts[row["i"]] = mine
        self.new.append(row["i"])
        return [(*self.key, row["i"])]


def diverse_stream(texts: DataFrame, threshold: float, silence: float, order: int = 2, delay: str = "0 seconds") -> DataFrame:
    """Siblings (parent, i, text, last, at) accepted in the order of their event time while their mean BLEU to those accepted
    stays within the threshold; a `last` try is always accepted. The accepted texts' n-gram counts are kept for each
    parent until it gets no row for `silence` seconds."""
    return on_time(texts, ["parent"], _Diverse(threshold, order, round(silence * 1000)), "parent bigint, i bigint", delay)
