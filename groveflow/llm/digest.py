"""Document fingerprints: quartile bucket digests.

Every byte triplet of a text is hashed into one of 128 buckets. The digest holds for each bucket in which quartile
of the text's own bucket counts it lies (two bits), the logarithm of the length, and two ratios of the quartiles.
Two digests are compared by a difference: steps between the quartiles of each bucket, with an extra for opposite
ends, and bounded parts for length and ratios. The likeness is one less the difference over its largest value.

Pairs of neighbours (a document and the next one by doc_id) are formed by range: split points from the ids' quantiles
(as many as shuffle partitions) give buckets of ids, and the first document of each bucket is sent a second time, to
the bucket before it. Each task walks its sorted bucket and holds two texts at a time.

Defined cases: a null text is empty; the digest of an empty text has all buckets in the lowest quartile and length
code 0; equal texts have equal digests; one single document is its own next one; rows with equal doc_id are ordered by
their text; null ids come last; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveflow.llm.registry import query, ready, table

BUCKETS = 128
LENGTH_BOUND, RATIO_BOUND = 32, 16
MOST = 6 * BUCKETS + LENGTH_BOUND + 2 * RATIO_BOUND


def _mixing_table() -> np.ndarray:
    return np.random.default_rng(16).permutation(256).astype(np.uint8)


_MIX = _mixing_table()


def bucket_counts(data: np.ndarray) -> np.ndarray:
    """Counts per bucket of the triplets (i, i+1, i+2), (i, i+1, i+3) and (i, i+2, i+3)."""
    n = len(data)
    total = np.zeros(BUCKETS, np.int64)
    if n < 3:
        return total
    for salt, gaps in ((3, (0, 1, 2)), (7, (0, 1, 3)), (11, (0, 2, 3))):
        m = n - gaps[-1]
        if m > 0:
            h = _MIX[data[:m] ^ np.uint8(salt)]
            h = _MIX[h ^ data[gaps[1] : gaps[1] + m]]
            h = _MIX[h ^ data[gaps[2] : gaps[2] + m]]
            total += np.bincount(h & np.uint8(BUCKETS - 1), minlength=BUCKETS)
    return total


def digest(raw: bytes) -> str:
    """Hexadecimal digits: length code (2), quartile ratios (2), quartile of each bucket (64)."""
    counts = bucket_counts(np.frombuffer(raw, np.uint8))
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, int(np.log2(len(raw)) * 8) + 1) if raw else 0
    ratios = (q1 * 16 // max(q3, 1)) % 16, (q2 * 16 // max(q3, 1)) % 16
    packed = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{packed.astype(np.uint8).tobytes().hex()}"


def _parts(text: str):
    packed = np.frombuffer(bytes.fromhex(text[4:]), np.uint8)
    return int(text[:2], 16), int(text[2], 16), int(text[3], 16), (packed[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3


def difference(a: str, b: str) -> int:
    """0 for equal digests, MOST at most."""
    la, ra, sa, ca = _parts(a)
    lb, rb, sb, cb = _parts(b)
    steps = np.abs(ca.astype(np.int16) - cb)
    score = int(np.where(steps == 3, 6, steps).sum())
    score += min(LENGTH_BOUND, abs(la - lb))
    for x, y in ((ra, rb), (sa, sb)):
        gap = abs(x - y)
        score += min(RATIO_BOUND, min(gap, 16 - gap) * 2)
    return score


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / MOST


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every text."""
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([digest((t.as_py() or "").encode()) for t in batch.column("text")], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame):
    """Buckets of documents by doc_id; `next` marks a bucket's extra last row: the document that follows it.

    Columns bucket, doc_id, text, next. Sent to the driver: as many split points and first ids as there are shuffle partitions.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    # exact to one part in 10,000 of the rows; splits only balance the buckets
    splits = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000).alias("q")).first().q if parts > 1 else None
    splits = sorted(set(splits or []))
    bounds = np.array(splits, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        """The number of split points at or below the id."""
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right").astype(np.int32))

    bucket = place(F.coalesce(F.col("doc_id"), F.lit(0).cast("bigint")))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(splits))).otherwise(bucket)
    placed = docs.withColumn("bucket", bucket)
    firsts = placed.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect()
    order = sorted(firsts, key=lambda r: r.bucket)
    before = {r.first: order[i - 1].bucket for i, r in enumerate(order) if r.first is not None}  # the first of all follows the last
    if not before:  # no ids at all: the order is that of the texts
        extra = placed.orderBy("text").limit(1).select("bucket", "doc_id", "text", F.lit(True).alias("next"))
        return placed.select("bucket", "doc_id", "text", F.lit(False).alias("next")).unionByName(extra), len(splits) + 1
    pairs = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])
    extra = placed.where(F.col("doc_id").isin(list(before))).select(pairs[F.col("doc_id")].alias("bucket"), "doc_id", "text", F.lit(True).alias("next"))
    return placed.select("bucket", "doc_id", "text", F.lit(False).alias("next")).unionByName(extra), len(splits) + 1


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many, or all, of the next text's first."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likeness and that to the next document."""
    ready(docs.sparkSession)
    rows, parts = with_next(docs)

    def run(batches):
        def result(doc, text, mark, following, following_mark):
            edited = edited_text(text, following).encode()
            new = digest(edited)
            return doc, len(text), hashlib.sha256(edited).hexdigest(), mark, new, likeness(mark, new), likeness(mark, following_mark)

        held, out = None, []
        for batch in batches:
            for bucket, doc, text, extra in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("next").to_pylist()):
                if extra and (held is None or held[0] != bucket):
                    continue  # a second copy of the following document
                text = text.as_py()
                mark = digest(text.encode())
                if held is not None and held[0] == bucket:
                    out.append(result(*held[1:], text, mark))
                held = None if extra else (bucket, doc, text, mark)
            if out:
                yield _batch(out)
                out = []

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    placed = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "next", F.col("doc_id").asc_nulls_last(), "text")
    return placed.mapInArrow(run, schema)


def _batch(rows):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


@query("op3_fingerprint")
def op3(spark, sf_dir):
    return compare_with_next(table(spark, sf_dir, "documents"))
