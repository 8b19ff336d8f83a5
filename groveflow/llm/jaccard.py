"""N-gram Jaccard join by a token-group matrix.

A document's set holds the hashes of its distinct word shingles; documents link where the Jaccard similarity of
their sets is `PERCENT` hundredths or more. The work goes:

1. Classes. Documents with equal sets are one class, named by a 128-bit digest of the set.
2. Groups. Classes that agree in at least two of four min-hashes are compared with the first class that has the same
   min-hash, and where many have it also with the first of a small team, dealt in a few ways; the pairs grow with the
   documents, not with the square of a group. Verified links make groups of similar documents: connected already, none of
   their own pairs needs another look. In the matrix a group stands in bands of nearly equal size.
3. Matrix. In a fixed order of all tokens a set needs only its first n - ceil(0.8 n) + 1 tokens: a partner that shares
   none of them is below the threshold. For every token the matrix holds the groups whose members have it in this prefix
   (the union over the group). Frequent tokens come last in the order, so common passages hardly occur in prefixes.
4. Bound. A class and a foreign group that share c prefix tokens overlap in at most c + max(n - prefix) tokens with any
   member, so c must reach a number that follows from the sizes. Ordered by rarity, the first common token then has as
   many prefix tokens from there on in both, so only tokens with so many left are looked up. A second bound on the overlap
   holds the class's numbers of tokens in 16 buckets against the largest ones of the group's members. Only groups that pass
   both are opened, in one direction: the smaller group asks.
5. Opened groups are compared member by member on whole sets: first a few members each (`FEW`, by hash), then, with the
   components known so far, all others that are not connected yet. The links of all rounds give the components.

Nothing is dropped or capped: the order of the tokens and the leaders only decide how much is compared. The list of
frequent tokens is bounded (`FREQUENT`), and any list gives the same result.

Defined cases: texts without words have an empty set and link with nothing; texts of fewer than `WIDTH` words have
their whole word sequence as one token; repeated rows share a class; a null doc_id is linked like any other, but does
not count as smallest id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from groveflow.llm import kernel
from groveflow.llm.components import components
from groveflow.llm.registry import query, ready, table
from groveflow.session import materialise

WIDTH, PERCENT = 5, 80
SEEDS = 4
PACKED = 8 << 20  # bytes of text whose prefix tokens are packed together
FREQUENT = 1 << 17
BLOCK = 32 << 20  # bytes of texts that are counted together
OFTEN = 4  # documents of one block in which a token must occur to be proposed as frequent
FEW = 24
TEAM, WAYS = 8, 2
BAND = 1.05  # members of a group whose sizes differ by less than this stand together in the matrix
BITS = 24


class Sets:
    """Sorted distinct tokens of the texts of a slice: `tokens` of text i are at bounds[i] to bounds[i + 1]."""

    def __init__(self, array: pa.Array, width: int = WIDTH):
        data, offsets = kernel.bytes_of(array)
        words = kernel.Words(data, offsets, kernel.SPACED)
        grams = kernel.grams(words.hash, width)
        parts = []
        first = words.first.tolist()
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= width:
                parts.append(np.unique(grams[a : b - width + 1]))
            else:
                parts.append(kernel.grams(words.hash[a:b], b - a) if b > a else grams[:0])
        self.size = np.array([len(p) for p in parts], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.size)])
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.full = np.flatnonzero(self.size)

    def reduce(self, ufunc, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size), np.uint64)
        if len(self.full):
            out[self.full] = ufunc.reduceat(values, self.bounds[:-1][self.full])
        return out

    def digests(self) -> np.ndarray:
        """16 bytes a set; null sets (no tokens) have digest 0."""
        pair = [self.reduce(np.add, kernel.mix(self.tokens ^ np.uint64(s))) for s in (0x243F6A8885A308D3, 0x13198A2E03707344)]
        return np.stack([kernel.mix(p + self.size.astype(np.uint64)) for p in pair], 1).astype(">u8").view("V16").ravel()

    def histograms(self) -> list[np.ndarray]:
        """Tokens per bucket, 16 buckets by their last bits, a byte each in two numbers; 255 stands for 255 or more."""
        owner = np.repeat(np.arange(len(self.size)), self.size)
        counts = np.bincount(owner * 16 + (self.tokens & np.uint64(15)).astype(np.int64), minlength=16 * len(self.size))
        return list(np.minimum(counts, 255).astype(np.uint8).reshape(-1, 2, 8).copy().view("<i8")[:, :, 0].T)

    def minima(self) -> list[np.ndarray]:
        return [self.reduce(np.minimum, kernel.mix(self.tokens * np.uint64(2 * j + 3) + np.uint64(j + 1))) for j in range(SEEDS)]


def _binary(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(values.dtype.itemsize), len(values), [None, pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def prefix(n, percent: int = PERCENT):
    """Tokens to look at so that a partner that shares none of them overlaps in less than percent of n."""
    return n - (percent * n + 99) // 100 + 1


# scan 1 ------------------------------------------------------------------------------------------


def _describe(width):
    """Rows of documents: doc_id, class, size, min-hashes; and, with null class, tokens proposed as frequent and their count."""

    names = ["doc_id", "c", "n", *(f"m{j}" for j in range(SEEDS)), "h0", "h1"]

    def proposals(held, kind):
        tokens, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= OFTEN
        k = int(often.sum())
        tokens, times = pa.array(tokens[often].view(np.int64)), pa.array(times[often])
        return pa.RecordBatch.from_arrays([pa.nulls(k, kind), pa.nulls(k, pa.binary()), times, tokens, *[pa.nulls(k, pa.int64())] * (SEEDS + 1)], names=names)

    def run(batches):
        held, size, seen, kind = [], 0, set(), None
        for batch in batches:
            column, kind = kernel.texts(batch.column("text")), batch.column("doc_id").type
            for a, b in kernel.slices(column):
                sets = Sets(column.slice(a, b - a), width)
                classes = sets.digests()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), _binary(classes), pa.array(sets.size), *(pa.array(m.view(np.int64)) for m in (*sets.minima(), *sets.histograms()))], names=names
                )
                new = [i for i, c in enumerate(classes.tolist()) if not (c in seen or seen.add(c))]  # equal sets count once in a block
                held.append(sets.tokens[kernel.ragged(sets.bounds[new], sets.size[new])])
                size += int(sets.bounds[-1]) * 8
                if size >= BLOCK:
                    yield proposals(held, kind)
                    held, size, seen = [], 0, set()
        if held:
            yield proposals(held, kind)

    return run


# verification ------------------------------------------------------------------------------------


def _whole_sets(width, bitmap):
    """One row per class of the task whose bit is set: class and packed set."""

    def run(batches):
        seen: set[bytes] = set()
        bits = bitmap.value
        for batch in batches:
            column = kernel.texts(batch.column("text"))
            for a, b in kernel.slices(column):
                sets = Sets(column.slice(a, b - a), width)
                names = sets.digests()
                place = names.view(">u8").reshape(-1, 2)[:, 0].astype(np.uint64) >> np.uint64(64 - BITS)
                hit = np.flatnonzero((bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
                out, packed = [], []
                for i in hit.tolist():
                    name = names[i].tobytes()
                    if name not in seen:
                        seen.add(name)
                        out.append(name)
                        packed.append(sets.tokens[sets.bounds[i] : sets.bounds[i + 1]].tobytes())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(packed, pa.binary())], names=["c", "packed"])

    return run


def _verify(percent):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return run


def _bitmap(names: DataFrame):
    """Which of 2**24 bits the classes fall on; 2 MB at most reach the driver, whatever their number."""
    bit = F.conv(F.hex(F.substring("c", 1, BITS // 8)), 16, 10).cast("bigint") + 1
    rows = names.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    for r in rows:
        bitmap[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return bitmap


def verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the similarity."""
    spark = docs.sparkSession
    names = materialise(pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct(), "names")
    bitmap = spark.sparkContext.broadcast(_bitmap(names))
    sets = docs.select("text").mapInArrow(_whole_sets(width, bitmap), "c binary, packed binary").join(names, "c", "left_semi").dropDuplicates(["c"])
    sets = materialise(sets, "sets")
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("packed").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("packed").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a binary, b binary")


# scan 2: the matrix ------------------------------------------------------------------------------


def _prefixes(width, percent, frequent, buckets):
    """Per slice and bucket of tokens one row with packed classes, prefix tokens per class, and tokens."""

    def run(batches):
        common = frequent.value  # sorted tokens, and the rank of each by frequency
        for batch in batches:
            column = kernel.texts(batch.column("text"))
            for a, b in kernel.slices(column, PACKED):
                names_, owners, tokens_ = [], [], []
                for i, j in kernel.slices(column.slice(a, b - a)):
                    sets = Sets(column.slice(a + i, j - i), width)
                    names = sets.digests()
                    _, one = np.unique(names, return_index=True)
                    one = one[sets.size[one] > 0]
                    key = sets.tokens >> np.uint64(1)
                    if len(common[0]):
                        at = np.searchsorted(common[0], sets.tokens)
                        at[at == len(common[0])] = 0
                        key = np.where(common[0][at] == sets.tokens, np.uint64(1 << 63) + common[1][at], key)
                    for r in one.tolist():
                        lo, n = sets.bounds[r], int(sets.size[r])
                        p = prefix(n, percent)
                        own = key[lo : lo + n]
                        chosen = np.argpartition(own, p - 1)[:p] if p < n else np.arange(n)
                        tokens_.append(sets.tokens[lo + chosen])
                        names_.append(names[r])
                        owners.append(p)
                if not names_:
                    continue
                names, tokens = np.array(names_), np.concatenate(tokens_)
                owner = np.repeat(np.arange(len(names)), owners)
                part = (kernel.mix(tokens) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((owner, part))
                part, owner, tokens = part[order], owner[order], tokens[order]
                ends = np.searchsorted(part, np.arange(buckets + 1))
                rows = []
                for k in np.flatnonzero(np.diff(ends)).tolist():
                    own, counts = np.unique(owner[ends[k] : ends[k + 1]], return_counts=True)
                    rows.append((k, names[own].tobytes(), counts.astype("<u4").tobytes(), tokens[ends[k] : ends[k + 1]].tobytes()))
                ks, *blobs = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "names", "counts", "tokens"])

    return run


def _shared_tokens(batches):
    """Of the buckets of a task the (token, class) entries whose token occurs in two classes or more."""
    names, counts, tokens = [], [], []
    for batch in batches:
        for x, y, z in zip(batch.column("names"), batch.column("counts"), batch.column("tokens")):
            names.append(np.frombuffer(x.as_buffer(), "V16").copy())
            counts.append(np.frombuffer(y.as_buffer(), "<u4").copy())
            tokens.append(np.frombuffer(z.as_buffer(), np.uint64).copy())
    if not names:
        return
    names, counts, tokens = map(np.concatenate, (names, counts, tokens))
    names, number = np.unique(names.view(">u8").reshape(-1, 2), axis=0, return_inverse=True)
    owner = np.repeat(number.ravel(), counts)
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)  # the same class may come from several tasks
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    tokens, owner = tokens[new], owner[new]
    begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    times = np.diff(np.append(begin, len(tokens)))
    times = np.repeat(times, times)
    keep = np.flatnonzero(times > 1)
    names = np.ascontiguousarray(names.astype(">u8")).view("V16").ravel()
    for at in range(0, len(keep), 1 << 16):
        part = keep[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(tokens[part].view(np.int64)), pa.array(times[part]), _binary(names[owner[part]])], names=["token", "times", "c"])
    del names, owner, tokens, times, keep, begin, new, order, counts
    kernel.trim()


def _byte(column: str, i: int):
    return F.shiftrightunsigned(F.col(column), 8 * i).bitwiseAND(F.lit(255))


def _count(column: str, i: int):
    """A bucket's tokens; no bound where the byte is full."""
    return F.when(_byte(column, i) < 255, _byte(column, i)).otherwise(F.lit(1 << 40))


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT):
    """(documents: doc_id, c, n) and (verified links a, b between classes) that connect all similar documents."""
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    minima = [f"m{j}" for j in range(SEEDS)]
    columns = ", ".join(f"{x} bigint" for x in (*minima, "h0", "h1"))
    scanned = materialise(docs.mapInArrow(_describe(width), f"doc_id {kind}, c binary, n bigint, {columns}"), "classes")
    documents = scanned.where("c is not null").select("doc_id", "c", "n")
    classes = scanned.where("c is not null and n > 0").groupBy("c").agg(*(F.min(x).alias(x) for x in ("n", *minima, "h0", "h1")))
    classes = materialise(classes.withColumn("k", F.monotonically_increasing_id()), "classes")  # k: a short name, fixed by writing it

    # groups: verified stars around one leader per min-hash
    alike = lambda x: sum((F.col(m) == F.col(f"{x}.{m}")).cast("int") for m in minima)
    close = lambda n, m: (100 * F.least(n, m) >= percent * F.greatest(n, m))
    slots = F.array(*[F.struct(F.lit(j).alias("slot"), F.col(m).alias("key")) for j, m in enumerate(minima)])
    dealt = classes.select("c", "n", *minima, F.explode(slots).alias("x")).select("c", "n", *minima, "x.*")
    sized = dealt.groupBy("slot", "key").agg(F.count("*").alias("times")).where("times > 1")
    # one leader for all, and, where there are many, one for every few, dealt by hash in several ways
    ways = F.sequence(F.lit(0), F.when(F.col("times") > TEAM, F.lit(WAYS)).otherwise(F.lit(0)))
    team = F.when(F.col("way") == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("c", "way"), F.ceil(F.col("times") / TEAM)))
    dealt = dealt.join(sized, ["slot", "key"]).withColumn("way", F.explode(ways)).withColumn("team", team)
    leaders = dealt.groupBy("slot", "key", "way", "team").agg(F.min(F.struct("c", "n", *minima)).alias("lead"))
    stars = dealt.join(leaders, ["slot", "key", "way", "team"]).where((F.col("c") != F.col("lead.c")) & (alike("lead") >= 2) & close(F.col("n"), F.col("lead.n")))
    stars = materialise(stars.select(F.col("lead.c").alias("a"), F.col("c").alias("b")).distinct(), "stars")
    first = materialise(verified(docs, stars, width, percent), "links")
    roots = components(first)
    members = classes.select("c", "k", "n", "h0", "h1").join(roots, F.col("c") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c"))
    members = members.join(classes.select(F.col("c").alias("root"), F.col("k").alias("g")), "root")
    band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("bigint")
    members = members.select("c", "k", "n", "h0", "h1", "g", (F.col("g") * 1000 + band).alias("s"))
    members = materialise(members, "members")
    sizes = materialise(members.groupBy("g").agg(F.count("*").alias("members")), "sizes")
    tops = [F.max(_byte(h, i)) for h in ("h0", "h1") for i in range(8)]
    packed = [reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(top, 8 * i) for i, top in enumerate(tops[at : at + 8])]) for at in (0, 8)]
    groups = members.groupBy("s", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"), packed[0].alias("t0"), packed[1].alias("t1"))
    groups = materialise(groups.join(sizes, "g"), "groups")

    # the matrix of tokens and groups
    often = scanned.where("c is null").groupBy(F.col("m0").alias("token")).agg(F.sum("n").alias("times"))
    often = often.orderBy(F.desc("times"), "token").limit(FREQUENT).toArrow()
    tokens = often.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[order], (len(tokens) - 1 - order).astype(np.uint64)))
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    prefixes = docs.select("text").mapInArrow(_prefixes(width, percent, frequent, buckets), "bucket int, names binary, counts binary, tokens binary")
    shared = prefixes.repartition(buckets, "bucket").mapInArrow(_shared_tokens, "token bigint, times bigint, c binary")
    entries = shared.join(members.select("c", "k", "g", "s"), "c").select("token", "times", "k", "g", "s")
    across = entries.groupBy("token").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 <> g1").select("token")
    # All tokens are ordered: those of one group only, then the rarest first. `left`: prefix tokens of the class from there on
    by_class = Window.partitionBy("k").orderBy(F.desc("times"), F.desc("token"))
    entries = entries.join(across, "token", "left_semi").withColumn("left", F.row_number().over(by_class)).drop("times")
    entries = materialise(entries, "entries")
    matrix = entries.groupBy("token", "s").agg(F.max("left").alias("left_there"))
    matrix = materialise(matrix.join(groups, "s").withColumnsRenamed({"g": "component", "s": "other", "members": "many", "low": "low_there", "high": "high_there"}), "matrix")
    asking = entries.drop("s").join(members.select("k", "n", "h0", "h1"), "k").join(sizes, "g")
    asks = (F.col("members") < F.col("many")) | ((F.col("members") == F.col("many")) & (F.col("g") < F.col("component")))
    fits = (100 * F.col("high_there") >= percent * F.col("n")) & (percent * F.col("low_there") <= 100 * F.col("n"))
    # two similar sets share `need` prefix tokens at least, so the rarest of them has as many from there on in both
    rest = lambda n: F.ceil(n * percent / 100) - 1  # noqa: E731  tokens behind the prefix
    overlap = lambda m: F.ceil((F.col("n") + m) * percent / (100 + percent))
    need = lambda m: overlap(m) - F.greatest(rest(F.col("n")), rest(m))
    least = F.greatest(F.col("low_there"), F.ceil(F.col("n") * percent / 100))
    most = F.least(F.col("high_there"), F.floor(F.col("n") * 100 / percent))
    # beyond n the need falls, but by its ceilings may be one less inside the range than at its upper end
    inside = F.when((most > least) & (most > F.col("n")), 1).otherwise(0)
    enough = F.greatest(F.least(need(least), need(most) - inside), F.lit(1))
    # in every bucket a class and a member share no more than the smaller of their numbers of tokens
    both = reduce(lambda x, y: x + y, [F.least(_count(h, i), _count(t, i)) for h, t in (("h0", "t0"), ("h1", "t1")) for i in range(8)])
    met = asking.join(matrix, "token").where((F.col("g") != F.col("component")) & asks & fits & (F.least("left", "left_there") >= enough) & (both >= overlap(least)))
    opened = materialise(met.select("k", "n", "other").distinct(), "opened")
    opened = opened.join(members.select("k", F.col("c").alias("a")), "k").select("a", "n", "other")
    inside = members.join(sizes, "g").select(F.col("s").alias("other"), F.col("c").alias("b"), F.col("n").alias("m"), "members")
    # first about FEW members of each opened group; most of what belongs together is then connected and needs no more looks
    slice_ = F.pmod(F.xxhash64("a", "b"), F.greatest(F.floor(F.col("members") / FEW), F.lit(1))) == 0
    pairs = opened.join(inside, (opened.other == inside.other) & close(F.col("n"), F.col("m")) & slice_).select("a", "b")
    second = materialise(first.unionByName(verified(docs, materialise(pairs, "pairs"), width, percent)), "links")
    # then all members that are still in another component
    roots = components(second)
    asking = opened.join(roots.select(F.col("node").alias("a"), F.col("root").alias("at")), "a", "left").withColumn("at", F.coalesce("at", "a"))
    inside = inside.join(roots.select(F.col("node").alias("b"), F.col("root").alias("there")), "b", "left").withColumn("there", F.coalesce("there", "b"))
    apart = (asking.other == inside.other) & close(F.col("n"), F.col("m")) & ~slice_ & (F.col("at") != F.col("there"))
    pairs = asking.join(inside, apart).select("a", "b")
    third = verified(docs, materialise(pairs, "pairs"), width, percent)
    return documents, materialise(second.unionByName(third), "links")


def similar(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), one row per document."""
    documents, edges = links(docs, width, percent)
    named = documents.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"))
    named = named.join(components(edges), F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("root"), "least")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(smallest, "root").select("c", "component_id"), "components")
    return documents.join(named, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


@query("op5_jaccard_join")
def op5(spark, sf_dir):
    return similar(table(spark, sf_dir, "documents"))
