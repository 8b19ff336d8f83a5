"""Benchmark decontamination by winnowing.

Of every window of `window` consecutive k-word hashes the smallest is kept as a fingerprint, in documents and in
benchmark items alike. Equal windows keep equal fingerprints, so every shared span of k + window - 1 = `span`
words shares at least one. Fingerprints are joined, each hit is extended word by word to both sides, and runs
of `span` words or more are hits. Items of fewer than `span` words are one window: their fingerprint is the hash
of the whole item (k = its length, window 1).

Items in which a fingerprint stands among the same words meet the documents once, as a class, and documents with the same
classes get one list of items, so a passage of many items and many documents makes no row for each pair of them.

Before the join a bitmap of fixed size (2 MB, whatever the benchmark's size) built from the item fingerprints
drops document fingerprints that cannot match, so that clean text is not shuffled. The join itself is a shuffle
join that Spark may turn into a broadcast by its own threshold.

Defined cases: a null text has no words and no hits; an item with no words has no windows; repeated rows each get
their own result; a null item id still causes hits but has no name to list; an empty benchmark leaves every
document clean; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveflow.llm import kernel
from groveflow.llm.registry import query, ready, table
from groveflow.operators.spread import join_stats
from groveflow.session import materialise

K, SPAN = 5, 13
BITS = 24
_HIT = pa.struct([("h", pa.int64()), ("k", pa.int32()), ("p", pa.int32()), ("around", pa.list_(pa.int64()))])


def _selected(grams: np.ndarray, texts: np.ndarray, k: int, window: int) -> np.ndarray:
    """Positions whose hash is the smallest of some window; windows stay inside one text."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = kernel.sliding(grams, window, np.minimum)
    least[texts[:n] != texts[window + k - 2 :][:n]] = 0
    padded = np.zeros(n + 2 * (window - 1), np.uint64)
    padded[window - 1 : window - 1 + n] = least
    return np.flatnonzero(kernel.sliding(padded, window, np.maximum) == grams)


def _around(words: kernel.Words, texts: np.ndarray, at: np.ndarray, k: int, span: int, blank: int) -> np.ndarray:
    """Hashes of the words from at - (span - k) to at + span - 1; `blank` beyond the text."""
    index = at[:, None] + np.arange(-(span - k), span)[None, :]
    inside = (index >= 0) & (index < len(texts))
    index = np.clip(index, 0, max(len(texts) - 1, 0))
    inside &= texts[index] == texts[at][:, None]
    return np.where(inside, words.hash[index].view(np.int64), blank)


def fingerprints(column, k: int, span: int, lengths, bitmap, items: bool):
    """Fingerprints of the texts of an Arrow column, as (texts' word counts, list array of hits).

    items: also the whole-item windows of short items, and no filter. Else: k-word and all `lengths`-word hashes
    that the bitmap lets through.
    """
    counts, parts = [], []
    array = kernel.texts(column)
    for a, b in kernel.slices(array):
        data, offsets = kernel.bytes_of(array.slice(a, b - a))
        words = kernel.Words(data, offsets, kernel.ALNUM)
        texts = words.texts()
        counts.append(words.count)
        at, ks, hs, ctx = [], [], [], []
        for size, winnowed in ((k, True), *((n, False) for n in lengths)):
            g = kernel.grams(words.hash, size)
            if not len(g):
                continue
            if items:
                pos = _selected(g, texts, k, span - k + 1) if winnowed else words.first[:-1][words.count == size]
            else:
                bit = (g >> np.uint64(64 - BITS)).astype(np.int64)
                passed = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
                if not passed.any():
                    continue
                pos = _selected(g, texts, k, span - k + 1) if winnowed else np.arange(len(g))
                pos = pos[passed[pos] != 0]
            pos = pos[texts[pos] == texts[pos + size - 1]]
            if len(pos):
                at.append(pos)
                ks.append(np.full(len(pos), 0 if winnowed else size))
                hs.append(g[pos])
                ctx.append(_around(words, texts, pos, k, span, 1 if items else 0))
        if at:
            at, ks, hs, ctx = (np.concatenate(x) for x in (at, ks, hs, ctx))
            order = np.argsort(at, kind="stable")
            at, ks, hs, ctx = at[order], ks[order], hs[order], ctx[order]
            own = np.bincount(texts[at], minlength=b - a)
            around = pa.FixedSizeListArray.from_arrays(pa.array(ctx.ravel()), ctx.shape[1]).cast(pa.list_(pa.int64()))
            values = pa.StructArray.from_arrays(
                [pa.array(hs.view(np.int64)), pa.array(ks.astype(np.int32)), pa.array((at - words.first[texts[at]]).astype(np.int32)), around],
                fields=list(_HIT),
            )
            parts.append(kernel.lists(own, values))
        else:
            parts.append(kernel.lists(np.zeros(b - a, np.int64), pa.array([], _HIT)))
    if not parts:
        return np.zeros(0, np.int64), pa.array([], pa.list_(_HIT))
    return np.concatenate(counts), pa.concat_arrays(parts)


_HITS = "array<struct<h: bigint, k: int, p: int, around: array<bigint>>>"


def _extend(k: int, span: int):
    """Rows of joined fingerprints to spans of words: as far as the words around agree, if that is a window."""

    def run(batches):
        left = span - k
        for batch in batches:
            n = batch.num_rows
            doc, item = (np.asarray(batch.column(c).flatten()).reshape(n, span + left) for c in ("around", "item_around"))
            ks, p = np.asarray(batch.column("k")), np.asarray(batch.column("p")).astype(np.int64)
            same = doc == item
            back = np.cumprod(same[:, :left][:, ::-1], axis=1).sum(axis=1)
            ahead = np.cumprod(same[:, left:], axis=1).sum(axis=1)
            long = (ks == 0) & (ahead >= k) & (back + ahead >= span)
            short = (ks > 0) & (ahead >= ks)
            keep = np.flatnonzero(long | short)
            begin = np.where(long, p - back, p)[keep]
            end = np.where(long, p + ahead, p + ks)[keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(keep)), batch.column("cls").take(pa.array(keep)), pa.array(begin), pa.array(end)],
                names=["row", "cls", "begin", "end"],
            )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, span: int = SPAN, keep: list[str] | None = None) -> DataFrame:
    """One row per document: the columns `keep` (doc_id by default), n_words, n_hit, spans [(begin, end)) in words, item_ids.

    Documents need `text`, items `item_id` and `text`.
    """
    spark = docs.sparkSession
    ready(spark)
    keep = ["doc_id"] if keep is None else keep

    def item_prints(batches):
        for batch in batches:
            _, hits = fingerprints(batch.column("text"), k, span, range(1, span), None, True)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), hits], names=["item_id", "hits"])

    id_type = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select("item_id", "text").mapInArrow(item_prints, f"item_id {id_type}, hits {_HITS}")
    items = items.select("item_id", F.explode("hits").alias("x")).select("item_id", "x.h", "x.k", F.col("x.around").alias("item_around"))
    # items that show a fingerprint among the same words are one class, named by 128 bits: documents meet classes, not items
    shown = F.concat_ws(",", "h", "k", F.col("item_around").cast("array<string>"))
    items = materialise(items.withColumn("cls", F.unhex(F.md5(shown))), "items")
    classes = items.groupBy("cls").agg(F.any_value("h").alias("h"), F.any_value("k").alias("k"), F.any_value("item_around").alias("item_around"))
    bit = F.shiftrightunsigned("h", 64 - BITS) + 1
    found = items.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)  # at most 512 rows of 4 KB, whatever the benchmark holds
    for r in found:
        bits = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little"))
        bits = bits + (r.bucket - 1) * 32768
        np.bitwise_or.at(bitmap, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
    lengths = sorted(r.k for r in items.where("k > 0").select("k").distinct().collect())  # at most span - 1 numbers
    shared = spark.sparkContext.broadcast(bitmap)

    def doc_prints(batches):
        for batch in batches:
            n, hits = fingerprints(batch.column("text"), k, span, lengths, shared.value, False)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n), hits, batch.column("kept")], names=["row", "n_words", "hits", "kept"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "text", F.struct(*keep).alias("kept"))
    kept = rows.schema["kept"].dataType.simpleString()
    scanned = materialise(rows.mapInArrow(doc_prints, f"row bigint, n_words bigint, hits {_HITS}, kept {kept}"), "prints")
    prints = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.*")
    joined = prints.join(classes, ["h", "k"]).select("row", "p", "k", "around", "item_around", "cls")
    spans = joined.mapInArrow(_extend(k, span), "row bigint, cls binary, begin bigint, `end` bigint")
    hits = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"), F.array_sort(F.collect_set("cls")).alias("classes"))
    hits = materialise(hits, "hits")
    # documents with the same classes have the same items: the lists are made once for each set of classes
    sets = hits.groupBy("classes").agg(F.count(F.lit(1)).alias("__n"))
    named = sets.select("classes", "__n", F.explode("classes").alias("cls")).join(items.select("cls", "item_id").distinct(), "cls")
    named = named.groupBy("classes").agg(F.max("__n").alias("__n"), F.collect_set("item_id").alias("item_ids"))
    hits = join_stats(hits, named, ["classes"], ["row"], sizes=sets).drop("__n", "classes")
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    count = F.aggregate(
        "spans",
        start,
        lambda a, s: F.struct((a.n + F.greatest(s.end - F.greatest(s.begin, a.to), F.lit(0))).alias("n"), F.greatest(a.to, s.end).alias("to")),
    )
    return scanned.join(hits, "row", "left").select(
        "kept.*", "n_words", F.when(F.col("spans").isNull(), F.lit(0)).otherwise(count.n).cast("bigint").alias("n_hit"), "spans", "item_ids"
    )


def contaminated(n_hit="n_hit", n_words="n_words"):
    """At least one hit, and at least one word in twenty."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


@query("op1_decontaminate")
def op1(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.transform(F.coalesce("item_ids", F.array().cast(out.schema["item_ids"].dataType)), lambda x: x.cast("string"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(ids)), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
