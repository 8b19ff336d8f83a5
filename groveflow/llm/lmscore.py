"""Language-model scores by cross-entropy difference.

Two word-bigram models share one vocabulary, the words as they are written (lower case), so that their losses differ by
the texts they have seen and by nothing else. The background model counts every document, the target model those that
are given as target (here: all documents labelled good). A document's score is the mean over its words of target loss
less background loss, in nats; lower is closer to the target.

1. The corpus is written once more as slices of about four megabytes of text, each with its own list of words and the texts
   as numbers in that list.
2. Every slice asks for its distinct words, previous words and pairs: their 62-bit names (two bits tell the three kinds
   apart), sorted, with their counts in the slice, cut into ranges of the names. A range of all slices meets in one task,
   which adds the counts up and answers every slice in its own order. Names are not sent back, only counts.
3. Answers meet their slices again, and the losses are summed by document.

What is shuffled is packed: names as differences, all numbers by byte planes, which compress well. A frequent name is one
entry for each slice; ranges are as many as the corpus needs for about `RANGE` entries each. All counts are exact: nothing
is hashed into cells, and equal names of different words or pairs have a chance of about n**2 / 2**63 for n distinct ones.

Loss of word w after v: pair counts interpolated with word counts, which are interpolated with the uniform
distribution: p(w|v) = (n(v,w) + MU * p(w)) / (n(v) + MU), p(w) = (n(w) + 1) / (N + V), where V is the number of
distinct words and one for all others. A text starts after the empty word.

Defined cases: a null or wordless text has score null and no words; repeated rows count as often as they stand;
with no target document the target model is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveflow.llm import kernel
from groveflow.llm.registry import query, ready, table
from groveflow.session import materialise

MU = 64.0
SLICE = 4 << 20  # bytes of text
RANGE = 1 << 20  # words of the corpus for each range of names
FLAGS = 1 << 20  # target ids up to this number are a broadcast; beyond it documents are joined with them
_KINDS = [np.uint64(k) for k in range(3)]  # pair, word, previous word


def name(values: np.ndarray, kind: int) -> np.ndarray:
    """Names of one kind: two low bits tell it."""
    return (kernel.mix(values + np.uint64(0x51ED270B * (kind + 1))) & ~np.uint64(3)) | _KINDS[kind]


def pair_value(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return word + kernel.mix(before + np.uint64(1))


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, as many as the largest needs (at least one), after a byte with their number."""
    many = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([many]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :many].T).tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    many = raw[0]
    rows = np.frombuffer(raw, np.uint8, offset=1).reshape(many, -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, :many] = rows.T
    return out.view("<u8").ravel()


class Slice:
    """Words of some texts: `hashes` of the distinct ones, `code` of each word in it, `texts` (the text of each word)."""

    def __init__(self, hashes: np.ndarray, code: np.ndarray, n_words: np.ndarray):
        self.hashes, self.code, self.n_words = hashes, code.astype(np.int64), n_words
        self.texts = np.repeat(np.arange(len(n_words)), n_words)
        # previous words: 0 is the empty word before a text, k + 1 word k
        before = np.zeros(len(code), np.int64)
        before[1:] = self.code[:-1] + 1
        first = np.cumsum(n_words) - n_words
        before[first[n_words > 0]] = 0
        width = len(hashes) + 1
        distinct, self.pair = np.unique(before * width + self.code, return_inverse=True)
        self.before, self.word = distinct // width, distinct % width
        previous = np.concatenate([np.zeros(1, np.uint64), hashes])
        names = np.concatenate([name(pair_value(hashes[self.word], previous[self.before]), 0), name(hashes, 1), name(previous, 2)])
        self.order = np.argsort(names, kind="stable")
        self.names = names[self.order]

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """How often each name stands in the texts of the flags, in the order of the names."""
        own = flags[self.texts]
        pairs = np.bincount(self.pair[own], minlength=len(self.word))
        words = np.bincount(self.word, pairs, len(self.hashes)).astype(np.int64)
        befores = np.bincount(self.before, pairs, len(self.hashes) + 1).astype(np.int64)
        return np.concatenate([pairs, words, befores])[self.order]

    def losses(self, n: np.ndarray, total: int, size: int) -> np.ndarray:
        """Sums of losses by text, from the counts of all names in the corpus."""
        count = np.empty(len(n), np.float64)
        count[self.order] = n
        pairs, words, befores = np.split(count, [len(self.word), len(self.word) + len(self.hashes)])
        p = (words[self.word] + 1) / float(total + size)
        loss = np.log(befores[self.before] + MU) - np.log(pairs + MU * p)
        return np.bincount(self.texts, loss[self.pair], len(self.n_words)).astype(float)

    def ranges(self, many: int) -> np.ndarray:
        """Where each of `many` even ranges of names begins, and the end."""
        edges = np.array([(k << 64) // many for k in range(many)], np.uint64)
        return np.append(np.searchsorted(self.names, edges), len(self.names))


def _slices(batches):
    for batch in batches:
        column, good = kernel.texts(batch.column("text")), batch.column("good")
        for a, b in kernel.slices(column, SLICE):
            words = kernel.Words(*kernel.bytes_of(column.slice(a, b - a)), kernel.ALNUM)
            hashes, code = np.unique(words.hash, return_inverse=True)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [
                    one(batch.column("doc_id").slice(a, b - a)), one(good.slice(a, b - a)), one(pa.array(words.count.astype(np.int64))),
                    pa.array([hashes.tobytes()], pa.binary()), pa.array([planes(code)], pa.binary()),
                ],
                names=["doc_ids", "good", "n_words", "hashes", "codes"],
            )


def _slice_of(row) -> Slice:
    return Slice(np.frombuffer(row["hashes"], np.uint64), unplaned(row["codes"]), np.array(row["n_words"], np.int64))


def _ask(many: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                part, good = _slice_of(row), np.array(row["good"], bool)
                n, t, at = part.counts(np.ones(len(good), bool)), part.counts(good), part.ranges(many)
                filled = np.flatnonzero(np.diff(at)).tolist()
                gaps = lambda k: planes(np.diff(part.names[at[k] : at[k + 1]], prepend=np.uint64(0)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(filled, pa.int32()), pa.array([row["slice"]] * len(filled), pa.int64()), pa.array([gaps(k) for k in filled], pa.binary()),
                        *(pa.array([planes(x[at[k] : at[k + 1]]) for k in filled], pa.binary()) for x in (n, t)),
                    ],
                    names=["range", "slice", "names", "n", "t"],
                )

    return run


def _answer(batches):
    """Blocks sorted by range: what all slices of a range hold of each name, in the order in which each slice asked.

    A row without slice holds the number of distinct words of the range.
    """
    now, held = None, []

    def settle():
        names = [np.cumsum(unplaned(x[1]), dtype=np.uint64) for x in held]
        every, place = np.unique(np.concatenate(names), return_inverse=True)
        ends = np.cumsum([len(x) for x in names])
        sums = [np.bincount(place, np.concatenate([unplaned(x[j]) for x in held]), len(every)).astype(np.uint64) for j in (2, 3)]
        slices = [None, *(x[0] for x in held)]
        n, t = ([planes(y[place[e - len(x) : e]]) for x, e in zip(names, ends)] for y in sums)
        words = int((every & np.uint64(3) == _KINDS[1]).sum())
        columns = [[now] * len(slices), slices, [None, *n], [None, *t], [words, *([0] * len(held))]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))], names=["range", "slice", "n", "t", "words"])

    for batch in batches:
        for key, *row in zip(*(batch.column(c).to_pylist() for c in ("range", "slice", "names", "n", "t"))):
            if held and key != now:
                yield settle()
                held = []
            now = key
            held.append(row)
    if held:
        yield settle()


class Corpus(NamedTuple):
    """The slices, and the number of words in all documents (n) and in target documents (t)."""

    slices: DataFrame
    n: int
    t: int


def fit(docs: DataFrame, target: DataFrame | list[int]) -> Corpus:
    """The documents as slices; target: doc_ids of the target documents."""
    spark = docs.sparkSession
    ready(spark)
    if isinstance(target, list):
        target = spark.createDataFrame([(i,) for i in target], "doc_id bigint")
    flags = materialise(target.where("doc_id is not null").select("doc_id").distinct().withColumn("flag", F.lit(True)), "flags")
    flags = F.broadcast(flags) if flags.count() <= FLAGS else flags
    flagged = docs.select("doc_id", "text").join(flags, "doc_id", "left").select("doc_id", "text", F.coalesce("flag", F.lit(False)).alias("good"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    slices = flagged.mapInArrow(_slices, f"doc_ids array<{kind}>, good array<boolean>, n_words array<bigint>, hashes binary, codes binary")
    slices = materialise(slices.withColumn("slice", F.monotonically_increasing_id()), "slices")  # numbers are fixed by writing them
    words = lambda keep: F.aggregate(F.zip_with("n_words", "good", lambda n, g: F.when(g | F.lit(not keep), n).otherwise(F.lit(0))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    total = slices.agg(F.sum(words(False)).alias("n"), F.sum(words(True)).alias("t")).first()
    return Corpus(slices, total.n or 0, total.t or 0)


def score(corpus: Corpus, range_words: int = RANGE) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (means over words), score (their difference)."""
    many = max(1, -(-corpus.n // range_words))
    asked = corpus.slices.select("slice", "good", "n_words", "hashes", "codes").mapInArrow(_ask(many), "range int, slice bigint, names binary, n binary, t binary")
    dealt = asked.repartition(many, "range").sortWithinPartitions("range")
    answers = materialise(dealt.mapInArrow(_answer, "range int, slice bigint, n binary, t binary, words bigint"), "answers")
    size = (answers.where("slice is null").agg(F.sum("words")).first()[0] or 0) + 1
    lists = answers.where("slice is not null").groupBy("slice").agg(F.collect_list(F.struct("range", "n", "t")).alias("answers"))
    kind = corpus.slices.schema["doc_ids"].dataType.elementType.simpleString()
    totals = {"n": corpus.n, "t": corpus.t}

    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["n_words", "hashes", "codes", "answers"]).to_pylist()):
                part = _slice_of(row)
                got = sorted(row["answers"] or [], key=lambda x: x["range"])
                counts = {x: np.concatenate([unplaned(g[x]) for g in got]) if got else np.zeros(0) for x in ("n", "t")}
                words = np.maximum(part.n_words, 1)
                n, t = (part.losses(counts[x], totals[x], size) / words for x in ("n", "t"))
                none = part.n_words == 0
                ids = batch.column("doc_ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(part.n_words), *(pa.array(x, mask=none) for x in (t, n, t - n))], names=["doc_id", "n_words", "target_loss", "background_loss", "score"]
                )

    joined = corpus.slices.join(lists, "slice", "left").select("doc_ids", "n_words", "hashes", "codes", "answers")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words bigint, target_loss double, background_loss double, score double")


def good_documents(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


@query("op10_lm_score")
def op10(spark, sf_dir):
    return score(fit(table(spark, sf_dir, "documents"), good_documents(table(spark, sf_dir, "labels"))))
