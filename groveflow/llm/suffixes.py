"""Removal of repeated byte strings by suffix arrays.

A byte goes if some `LENGTH`-byte string over it also starts anywhere else in the corpus, its own document included.

1. Anchors. In every window of LENGTH bytes the 32-byte gram with the smallest hash is the window's anchor (the last
   of equal ones). Equal windows have equal anchors at equal places, so every window start belongs to one anchor and
   only starts of equal anchor hashes need be compared. An anchor's context are the bytes of all its windows.
2. Anchors that occur once are done: nothing repeats there. Equal contexts are counted as one (a hash of the context
   stands for it); where one occurs twice, all its starts are repeated. Texts that occur twice are repeated in full.
3. Suffix arrays. The differing contexts of an anchor hash go to one shard. In each shard their suffix array is refined
   as by Larsson and Sadakane: ranks of 7-byte prefixes, then of 14, 28, ... bytes from the ranks half a length apart,
   sorting only groups that are still equal. Kasai's rule gives the common prefixes of neighbours, all contexts in step;
   starts with LENGTH common bytes to a neighbour are repeated.
4. Shards. An anchor hash with more than `GROUP` contexts is dealt over several shards. Each of those hands on its
   distinct windows by digest, dealt by digest; the sorted lists of the shards are merged by binary search, and windows
   found in two shards are repeated.

Defined cases: null and empty texts have no bytes; texts shorter than LENGTH keep all; repeated rows are repeated texts;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveflow.llm import kernel
from groveflow.llm.registry import query, ready, table
from groveflow.session import materialise

LENGTH, GRAM = 200, 32
GROUP = 2000  # contexts of one anchor hash in one shard
CHUNK = 1 << 20  # bytes of contexts whose suffix array is built at once
ROWS = 128  # texts that are unpacked at once
BITS = 24
_CODES = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


class Rolling:
    """Hashes of byte ranges of a buffer."""

    def __init__(self, data: np.ndarray, codes: np.ndarray):
        self.up, self.down = kernel._POWERS.upto(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * self.up[: len(data)], out=self.total[1:])

    def ranges(self, begin, end) -> np.ndarray:
        return kernel.mix((self.total[end] - self.total[begin]) * self.down[begin])

    def runs(self, size: int) -> np.ndarray:
        n = len(self.total) - size
        return kernel.mix((self.total[size:] - self.total[:n]) * self.down[:n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Per anchor of the texts: text, position, first and last start of its windows (in the buffer), hash, context hash."""
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolling = Rolling(data, _CODES[0])
    h = rolling.runs(gram)
    sizes = np.diff(offsets)
    least = kernel.sliding(h, width, np.minimum)
    # windows that cross the end of a text do not count
    cross = np.ones(len(least), bool)
    long = np.flatnonzero(sizes >= length)
    cross[kernel.ragged(offsets[long], sizes[long] - length + 1)] = False
    least[cross] = 0
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    p = np.flatnonzero(kernel.sliding(padded, width, np.maximum) == h)
    if not len(p):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    text = np.searchsorted(offsets, p, "right") - 1
    own = h[p]
    first = np.maximum(offsets[text], p - width + 1)
    last = np.minimum(p, offsets[text + 1] - length)
    for step in range(1, width):  # nearest smaller anchor before, nearest not larger one after
        near = p[step:] - p[:-step] < width
        if not near.any():
            break
        smaller = near & (own[:-step] < own[step:])
        first[step:] = np.where(smaller, np.maximum(first[step:], p[:-step] + 1), first[step:])
        smaller = near & (own[step:] <= own[:-step])
        last[:-step] = np.where(smaller, np.minimum(last[:-step], p[step:] - width), last[:-step])
    keep = np.flatnonzero((first <= last) & (own != 0))
    text, p, first, last, own = text[keep], p[keep], first[keep], last[keep], own[keep]
    context = kernel.mix(rolling.ranges(first, last + length) + ((p - first) * 512 + (last - first)).astype(np.uint64))
    return text, p, first, last, own, context


def suffix_array(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of every suffix) of all suffixes of the strings data[bounds[i]:bounds[i + 1]].

    A suffix ends with its string; equal suffixes stand in the order of their strings.
    """
    n = len(data)
    end = np.repeat(bounds[1:], np.diff(bounds))
    place = np.arange(n)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = data.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | np.where(place + j < end, wide[j : j + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    array = order
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(fresh, place, 0))
    rank[array] = start
    # places of the array in groups of two or more
    open_ = ~(fresh & np.append(fresh[1:], True))
    size = 7
    while open_.any() and size < n:
        at = np.flatnonzero(open_)
        items = array[at]
        ahead = items + size
        second = np.where(ahead < end[items], rank[np.minimum(ahead, n - 1)] + 1, 0)
        if not (second > 0).any():
            break  # what is still equal is equal to the end
        pair = (rank[items].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        new = np.argsort(pair, kind="stable")
        pair, items = pair[new], items[new]
        array[at] = items
        begin = np.ones(len(at), bool)
        begin[1:] = pair[1:] != pair[:-1]
        rank[items] = at[np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))]
        open_[at] = ~(begin & np.append(begin[1:], True))
        size *= 2
    # equal suffixes in the order of their strings: a stable sort by place inside each group
    array = np.lexsort((place, rank))
    final = np.empty(n, np.int64)
    final[array] = place
    return array, final


def common_prefixes(data: np.ndarray, bounds: np.ndarray, array: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """By Kasai's rule, for every suffix the length it has in common with the one before it in the array.

    The strings are walked in step; each step starts from the last length less one and compares eight bytes at a time.
    """
    n = len(data)
    end = np.repeat(bounds[1:], np.diff(bounds))
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word |= padded[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    out = np.zeros(n, np.int64)
    have = np.zeros(len(bounds) - 1, np.int64)
    sizes = np.diff(bounds)
    for step in range(int(sizes.max(initial=0))):
        who = np.flatnonzero(sizes > step)
        i = bounds[:-1][who] + step
        r = rank[i]
        j = array[np.maximum(r - 1, 0)]
        most = np.where(r > 0, np.minimum(end[i] - i, end[j] - j), 0)
        length = np.minimum(np.maximum(have[who] - 1, 0), most)
        todo = np.flatnonzero(length < most)
        while len(todo):
            a, b = i[todo] + length[todo], j[todo] + length[todo]
            differ = word[a] ^ word[b]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
            length[todo] = np.minimum(length[todo] + same, most[todo])
            todo = todo[(same == 8) & (length[todo] < most[todo])]
        have[who] = length
        out[i] = length
    return out


def repeated_starts(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, length: int = LENGTH):
    """Of the first starts[i] suffixes of each string: which have `length` bytes in common with another suffix, and a
    number that is equal for those that share them."""
    array, rank = suffix_array(data, bounds)
    common = common_prefixes(data, bounds, array, rank)
    in_order = common[array] >= length
    run = np.cumsum(~in_order)
    repeated = in_order | np.append(in_order[1:], False)
    places = kernel.ragged(bounds[:-1], starts)
    return places, repeated[rank[places]], run[rank[places]]


# jobs --------------------------------------------------------------------------------------------


def _find_anchors(length, gram):
    """Per distinct text of a task: class, and each anchor's hash, context hash, position, first and last start."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            column = kernel.texts(batch.column("text"))
            names = batch.column("c").to_pylist()
            for a, b in kernel.slices(column, 1 << 18):
                data, offsets = kernel.bytes_of(column.slice(a, b - a))
                text, p, first, last, h, x = anchors(data, offsets, length, gram)
                new = np.zeros(b - a, bool)
                for i in range(a, b):
                    if names[i] not in seen:
                        seen.add(names[i])
                        new[i - a] = True
                keep = np.flatnonzero(new[text])
                text, p, first, last, h, x = (v[keep] for v in (text, p, first, last, h, x))
                base = offsets[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[a:b], pa.binary()).take(pa.array(text)), pa.array(h.view(np.int64)), pa.array(x.view(np.int64)), *(pa.array((v - base).astype(np.int64)) for v in (p, first, last))],
                    names=["c", "h", "x", "p", "first", "last"],
                )

    return run


def _bitmap(names: DataFrame):
    """Which of 2**24 bits the classes fall on; 2 MB at most reach the driver, whatever their number."""
    bit = F.conv(F.hex(F.substring("c", 1, BITS // 8)), 16, 10).cast("bigint") + 1
    rows = names.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    for r in rows:
        bitmap[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return bitmap


def _passes(bits: np.ndarray, names: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(names.to_pylist()), np.uint8).reshape(-1, 16).astype(np.int64)
    place = (raw[:, 0] << 16) | (raw[:, 1] << 8) | raw[:, 2]
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0


def _chosen(bitmap, want: bool, once: bool):
    """Rows whose class has its bit set, or not; once: one row per class and task."""

    def run(batches):
        seen: set[bytes] = set()
        bits = bitmap.value
        for batch in batches:
            keep = _passes(bits, batch.column("c")) == want if batch.num_rows else np.zeros(0, bool)
            if once:
                names = batch.column("c").to_pylist()
                for i in np.flatnonzero(keep).tolist():
                    if names[i] in seen:
                        keep[i] = False
                    seen.add(names[i])
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def _small(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _contexts(length):
    """Joined texts and their wanted anchors to contexts."""

    def run(batches):
        for batch in _small(batches):
            rows = []
            for c, text, wanted in zip(batch.column("c").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()):
                raw = (text.as_py() or "").encode()
                for w in wanted:
                    rows.append((w["h"], w["salt"], w["shards"], c, w["first"], w["last"] - w["first"] + 1, w["times"], raw[w["first"] : w["last"] + length]))
            if rows:
                types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=["h", "salt", "shards", "c", "first", "starts", "times", "context"])

    return run


_FOUND = "c binary, first bigint, last bigint, digest binary, shard int"


def _shard(length):
    """Suffix arrays over the contexts of a task, whole groups of (h, salt) at a time.

    Rows with null digest: intervals of repeated starts. Others: a distinct window of a shard of a divided group, with its
    start if it is not yet known as repeated.
    """

    def solve(group):
        salts, divided, names, firsts, counts, times, raws = zip(*group)
        data = np.frombuffer(b"".join(raws), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
        counts = np.array(counts)
        places, repeated, run = repeated_starts(data, bounds, counts, length)
        owner = np.repeat(np.arange(len(raws)), counts)
        start = places - bounds[owner] + np.array(firsts)[owner]
        out = []
        hit = np.flatnonzero(repeated & (np.array(times)[owner] == 1))
        if len(hit):
            cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)) + 1
            for piece in np.split(hit, cut):
                out.append((names[owner[piece[0]]], int(start[piece[0]]), int(start[piece[-1]]), None, None))
        many = np.array(divided)[owner] > 1
        if many.any():
            pair = [Rolling(data, codes) for codes in _CODES]
            digests = np.stack([r.ranges(places, places + length) for r in pair], 1).astype(">u8").view("V16").ravel()
            known = repeated | (np.array(times)[owner] > 1)
            todo = np.flatnonzero(many)
            _, one = np.unique(np.where(repeated, run, -1 - np.arange(len(run)))[todo], return_index=True)
            for k in todo[one].tolist():
                shown = (None, None) if known[k] else (int(start[k]), int(start[k]))
                out.append((names[owner[k]], *shown, digests[k].tobytes(), salts[owner[k]]))
        return out

    def run(batches):
        group, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("h", "salt", "shards", "c", "first", "starts", "times", "context"))):
                if size >= CHUNK and row[:2] != last:
                    yield from _found(solve(group))
                    group, size = [], 0
                last = row[:2]
                group.append(row[1:])
                size += len(row[-1])
        if group:
            yield from _found(solve(group))

    return run


def _found(rows):
    for at in range(0, len(rows), 20_000):
        types = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows[at : at + 20_000]), types)], names=["c", "first", "last", "digest", "shard"])


def _merge(batches):
    """Sorted digest lists of shards, merged by binary search: starts whose window stands in another shard."""
    names, starts, digests, shards = [], [], [], []
    for batch in batches:
        names += batch.column("c").to_pylist()
        starts += [-1 if s is None else s for s in batch.column("first").to_pylist()]
        digests += batch.column("digest").to_pylist()
        shards += batch.column("shard").to_pylist()
    if not names:
        return
    digests, shards, starts = np.array(digests, "V16"), np.array(shards), np.array(starts)
    halves = digests.view(">u8").reshape(-1, 2).astype(np.uint64)
    value = kernel.mix(halves[:, 0]) ^ halves[:, 1]
    lists = {s: np.sort(value[shards == s]) for s in np.unique(shards).tolist()}
    found = np.zeros(len(value), bool)
    for s in lists:
        mine = np.flatnonzero(shards == s)
        for other, have in lists.items():
            if other != s:
                at = np.searchsorted(have, value[mine])
                at[at == len(have)] = 0
                found[mine] |= have[at] == value[mine]
    keep = np.flatnonzero(found & (starts >= 0)).tolist()
    rows = [(names[i], int(starts[i]), int(starts[i]), None, None) for i in keep]
    yield from _found(rows)


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(c, first, last): intervals of window starts that are repeated, by class of equal texts; c is the text's MD5.

    docs: c, text.
    """
    spark = docs.sparkSession
    ready(spark)
    twice = docs.where(F.octet_length("text") >= length).groupBy("c").agg(F.count("*").alias("times"), F.max(F.octet_length("text")).alias("size"))
    whole = twice.where("times > 1").select("c", F.lit(0).cast("bigint").alias("first"), (F.col("size") - length).cast("bigint").alias("last"))

    schema = "c binary, h bigint, x bigint, p bigint, first bigint, last bigint"
    found = materialise(docs.where(F.octet_length("text") >= length).mapInArrow(_find_anchors(length, gram), schema), "anchors")
    again = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    found = materialise(found.join(again, "h", "left_semi").distinct(), "anchors")
    by_context = found.groupBy("h", "x").agg(F.count("*").alias("times"), F.min(F.struct("c", "first", "last")).alias("one"))
    by_context = materialise(by_context, "contexts")
    equal = found.join(by_context.where("times > 1").select("h", "x"), ["h", "x"], "left_semi").select("c", "first", "last")

    mixed = by_context.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h", F.ceil(F.col("k") / GROUP).cast("int").alias("shards"))
    wanted = by_context.join(mixed, "h").select("h", F.pmod(F.xxhash64("x"), F.col("shards")).cast("int").alias("salt"), "shards", "times", "one.*")
    wanted = wanted.groupBy("c").agg(F.collect_list(F.struct("h", "salt", "shards", "times", "first", "last")).alias("wanted"))
    wanted = materialise(wanted, "wanted")
    bitmap = spark.sparkContext.broadcast(_bitmap(wanted))
    texts = docs.select("c", "text").mapInArrow(_chosen(bitmap, True, True), "c binary, text string").join(wanted, "c").dropDuplicates(["c"])
    contexts = texts.mapInArrow(_contexts(length), "h bigint, salt int, shards int, c binary, first bigint, starts bigint, times bigint, context binary")
    shards = contexts.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_shard(length), _FOUND)
    shards = materialise(shards, "shards")
    inside = shards.where("digest is null").select("c", "first", "last")
    across = shards.where("digest is not null").repartition("digest").mapInArrow(_merge, _FOUND).select("c", "first", "last")
    return whole.unionByName(equal).unionByName(inside).unionByName(across)


def _kept(raw: bytes, spans, length: int):
    """(bytes removed, maximal runs, SHA-256 of what stays, what stays) for sorted intervals of starts."""
    runs = []
    for first, last in spans:
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last + length)
        else:
            runs.append([first, last + length])
    at, parts = 0, []
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    kept = b"".join(parts)
    return len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept


def _cut(length, with_spans: bool, with_bytes: bool):
    def run(batches):
        for batch in _small(batches):
            rows = []
            spans = batch.column("spans").to_pylist() if with_spans else [()] * batch.num_rows
            for text, own in zip(batch.column("text"), spans):
                raw = (text.as_py() or "").encode()
                removed, runs, sha, kept = _kept(raw, sorted((s["first"], s["last"]) for s in own), length)
                rows.append((len(raw), removed, runs, sha, kept if with_bytes else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(v, t) for v, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the kept bytes of every document."""
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("c", F.unhex(F.md5("text")))
    spans = repeated(docs.select("c", "text"), length, gram).groupBy("c").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = materialise(spans, "spans")
    bitmap = spark.sparkContext.broadcast(_bitmap(spans))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = f"doc_id {kind}, text string, c binary"
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    clean = docs.mapInArrow(_chosen(bitmap, False, False), rows).mapInArrow(_cut(length, False, with_bytes), schema)
    rest = docs.mapInArrow(_chosen(bitmap, True, False), rows).join(spans, "c", "left")
    rest = rest.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<first: bigint, last: bigint>>"))).mapInArrow(_cut(length, True, with_bytes), schema)
    return clean.unionByName(rest)


@query("op4_suffix_dedup")
def op4(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")
