"""Language identification by the nearest of several centroids per language.

A text is the vector of its byte-trigram counts in `DIMS` hashed cells, damped (1 + log), weighted by inverse document
frequency and scaled to length one. Training vectors of each language are clustered (spherical k-means, `CLUSTERS`
centroids a language, seeded by far points); a text takes the language of the centroid with the largest cosine. It is
rejected if its cosine is below `PART` of what all but `TAIL` of the language's training texts of that length reach (length
classes by powers of two of the filled cells: short texts lie far from any centroid), or if it has no letters. A class with
fewer than `ENOUGH` training texts of the language takes those of all languages, else the limit of the next shorter class.

The classifier is fitted on at most `SAMPLE` documents, as many of each language (all, if there are fewer; one at least), in
hash order of their ids, so its size and time are fixed: their vectors, not their texts, reach the driver. Prediction
runs over all documents where they are.

Defined cases: a null text or one without letters is `und` with score 0; with no training document every text is `und`;
repeated rows get equal results; documents with null doc_id are predicted and count as held out of training; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groveflow.llm import kernel
from groveflow.llm.registry import query, ready, table
from groveflow.session import materialise

DIMS = 1 << 12
CLUSTERS, ROUNDS = 4, 12
SAMPLE = 4000  # documents of all languages together
PART, TAIL, ENOUGH = 0.5, 0.01, 20
LEAST = 0.1  # least cosine where no training text is as short
CLASSES = DIMS.bit_length() + 1
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:48] = _FOLD[58:65] = _FOLD[91:97] = _FOLD[123:128] = 32  # anything but digits, letters and multi-byte characters
_FOLD[48:58] = 48


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of damped trigram counts of the texts; trigrams do not cross texts."""
    n, docs = len(data), len(offsets) - 1
    if n < 3:
        return np.zeros((docs, DIMS), np.float32)
    x = _FOLD[data].astype(np.uint32)
    h = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    blank = (x[:-1] == 32) & (x[1:] == 32)
    cell = ((h * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
    size = np.maximum(np.diff(offsets) - 2, 0)
    index = kernel.ragged(offsets[:-1], size)
    owner = np.repeat(np.arange(docs), size)
    keep = ~(blank[index] | blank[index + 1])
    found = np.bincount(owner[keep] * DIMS + cell[index[keep]], minlength=docs * DIMS).reshape(docs, DIMS)
    return np.where(found > 0, 1 + np.log(np.maximum(found, 1)), 0).astype(np.float32)


def _length(rows: np.ndarray) -> np.ndarray:
    """Length class of each row."""
    return np.log2((rows > 0).sum(axis=1) + 1).astype(np.int64)


def _limits(cosines: np.ndarray, langs: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Least cosine by language and length class; cosines of training texts with centroids of their own language."""
    limits = np.full((n, CLASSES), LEAST)
    for i in range(n):
        for k in range(CLASSES):
            for held in (cosines[(length == k) & (langs == i)], cosines[length == k]):
                if len(held) >= ENOUGH:
                    limits[i, k] = PART * np.quantile(held, TAIL)
                    break
            else:
                limits[i, k] = limits[i, max(k - 1, 0)]
    return limits


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far points; empty clusters are left out."""
    centres = [_unit(rows.mean(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(rows)):
        near = (rows @ np.array(centres).T).max(axis=1)
        centres.append(rows[int(near.argmin())])
    centres = np.array(centres)
    for _ in range(ROUNDS):
        own = (rows @ centres.T).argmax(axis=1)
        centres = _unit(np.array([rows[own == i].mean(axis=0) for i in range(len(centres)) if (own == i).any()]))
    return centres


class Centroids:
    def __init__(self, rows: np.ndarray, langs: list[str]):
        """rows: damped counts, one vector per training text; they are weighted and scaled in place."""
        self.names = sorted(set(langs))
        if not self.names:
            return
        self.idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
        length = _length(rows)
        rows *= self.idf
        rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-12)[:, None]
        langs = np.array(langs)
        parts = [_cluster(rows[langs == name], CLUSTERS) for name in self.names]
        self.owner = np.concatenate([[i] * len(p) for i, p in enumerate(parts)])
        self.centres = np.concatenate(parts).astype(np.float32)
        number = np.searchsorted(self.names, langs)
        own = np.where(self.owner[None] == number[:, None], rows @ self.centres.T, -1).max(axis=1)
        self.limit = _limits(own, number, length, len(self.names))

    def predict(self, data: np.ndarray, offsets: np.ndarray):
        """Number of the nearest centroid's language, cosine, and whether it is too far, per text."""
        rows = counts(data, offsets)
        length = _length(rows)
        rows = _unit(rows * self.idf)
        cosine = np.clip(rows @ self.centres.T, 0, 1)
        best = cosine.argmax(axis=1)
        value = cosine[np.arange(len(rows)), best].astype(np.float64)
        lang = self.owner[best]
        return lang, value, value < self.limit[lang, length]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _vectors(batches):
    for batch in batches:
        column = kernel.texts(batch.column("text"))
        for a, b in kernel.slices(column):
            rows = counts(*kernel.bytes_of(column.slice(a, b - a))).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(a, b - a), batch.column("h").slice(a, b - a), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "h", "vector"]
            )


def fit(docs: DataFrame, sample: int = SAMPLE):
    """Centroids of the documents with text and language (doc_id, text, lang), as a broadcast of fixed size.

    Each language gives its ids of smallest hash, one text of each id: a share of the hashes, from the approximate number
    of ids, leaves a third more than are wanted, and the rest are ranked. No language is left out, however many copies
    an id has.
    """
    spark = docs.sparkSession
    ready(spark)
    docs = docs.where("text is not null and lang is not null and doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
    sizes = materialise(docs.groupBy("lang").agg(F.approx_count_distinct("h").alias("ids")), "languages")
    each = max(sample // max(sizes.count(), 1), 1)
    share = F.shiftrightunsigned("h", 11) / float(1 << 53)  # even over 0 to 1
    near = docs.join(sizes, "lang").where(share * F.col("ids") < 1.33 * each + 8).select("lang", "h", "text")
    first = Window.partitionBy("lang").orderBy("h")
    chosen = near.select("lang", "h").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= each).select("lang", "h")
    texts = near.join(F.broadcast(chosen), ["lang", "h"], "left_semi")  # at most `sample` rows, or one for each language
    found = texts.mapInArrow(_vectors, "lang string, h bigint, vector binary").groupBy("lang", "h").agg(F.max("vector").alias("vector")).orderBy("lang", "h").toArrow()
    langs = found.column("lang").to_pylist()
    packed = found.column("vector").combine_chunks()
    packed = packed.cast(pa.large_binary())
    rows = np.frombuffer(packed.buffers()[2], np.float16).reshape(-1, DIMS).astype(np.float32) if langs else np.zeros((0, DIMS), np.float32)
    del found, packed
    return spark.sparkContext.broadcast(Centroids(rows, langs))


def predict(docs: DataFrame, model, keep: list[str], nested: bool = False) -> DataFrame:
    """The columns `keep` (nested: as one struct `kept`), lang_pred, score (cosine, 0 to 1), rejected (too far from any
    centroid, or no letters)."""
    ready(docs.sparkSession)

    def run(batches):
        m = model.value
        for batch in batches:
            column = kernel.texts(batch.column("text"))
            for a, b in kernel.slices(column):
                part = column.slice(a, b - a)
                data, offsets = kernel.bytes_of(part)
                ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
                total = np.concatenate([[0], np.cumsum(ascii_letter)])
                letters = total[offsets[1:]] > total[offsets[:-1]]
                for i in np.flatnonzero(~letters).tolist():
                    letters[i] = has_letter(part[i].as_py())
                langs, scores, rejected = [UNKNOWN] * (b - a), np.zeros(b - a), np.ones(b - a, bool)
                if m.names:
                    lang, value, far = m.predict(data, offsets)
                    langs = [m.names[i] if ok else UNKNOWN for i, ok in zip(lang.tolist(), letters.tolist())]
                    scores, rejected = np.where(letters, value, 0.0), far | ~letters
                yield pa.RecordBatch.from_arrays([batch.column("kept").slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], names=["kept", "lang_pred", "score", "rejected"])

    rows = docs.select("text", F.struct(*keep).alias("kept"))
    return rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, lang_pred string, score double, rejected boolean").select("kept" if nested else "kept.*", "lang_pred", "score", "rejected")


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


@query("op7_language")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")), model, ["doc_id", "held_out"])
