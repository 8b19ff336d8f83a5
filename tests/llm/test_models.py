"""Fingerprints, Jaccard join, URL filter, language, BPE, LM scores."""

import random
from array import array

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import PATH, key, rows

from groveflow.llm import bpe, components, digest, jaccard, kernel, language, lmscore, urls

# fingerprints -----------------------------------------------------------------------------------


def _digest_rows(docs):
    docs = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    for i, (d, text) in enumerate(docs):
        text, following = text or "", docs[(i + 1) % len(docs)][1] or ""
        edited = digest.edited_text(text, following)
        a, b, c = (digest.digest(x.encode()) for x in (text, edited, following))
        yield d, len(text), brute.sha(edited), a, b, digest.likeness(a, b), digest.likeness(a, c)


def test_digest_table(spark):
    got = digest.op3(spark, PATH).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(_digest_rows(rows("documents")), key=key)


@pytest.mark.parametrize(
    "docs",
    [
        [(1, None), (1, "abcdefgh"), (1, "zz"), (None, "qqqqé"), (7, "x" * 100), (3, "é" * 9)],
        [(5, "only one text")],
        [(None, "a" * 9), (None, "b" * 9)],
        [(2**62, "big" * 5), (-5, "neg" * 7)],
        [(4, "same text"), (4, "same text"), (9, "")],
    ],
)
def test_digest_cases(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bucket", F.lit(1))
    assert sorted((tuple(r) for r in digest.compare_with_next(frame).collect()), key=key) == sorted(_digest_rows(docs), key=key)


def test_digest_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert digest.compare_with_next(frame).collect() == [] and digest.fingerprints(frame).collect() == []


def test_digest_differences():
    rng = random.Random(2)
    text = bytes(rng.randrange(97, 123) for _ in range(4000))
    other = bytes(rng.randrange(0, 256) for _ in range(90))
    near = text[:2000] + b"x" + text[2000:]
    a, b, c = map(digest.digest, (text, near, other))
    assert digest.difference(a, a) == 0 and digest.difference(a, b) == digest.difference(b, a)
    assert digest.likeness(a, b) > digest.likeness(a, c)
    assert all(0 <= digest.likeness(x, y) <= 1 for x in (a, b, c, digest.digest(b"")) for y in (a, b, c, digest.digest(b"")))


# Jaccard join -----------------------------------------------------------------------------------


def test_jaccard_table(spark):
    got = sorted((tuple(r) for r in jaccard.op5(spark, PATH).collect()), key=key)
    assert got == sorted(brute.similar(rows("documents")), key=key)


def test_jaccard_cases(spark):
    base = [f"w{i}" for i in range(50)]
    docs = [(1, None), (2, " "), (None, "x y"), (9, "X y"), (5, "x  Y"), (7, " ".join(base)), (8, " ".join([*base, "q"])), (11, " ".join([*base, "q", "r"]))]
    docs += [(12, " ".join(["q0", *base, "q", "r"])), (13, "a b c d e"), (13, "a b c d e"), (14, "a b c d"), (20, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("c", F.lit(1)).withColumn("n", F.lit(1))
    assert sorted((tuple(r) for r in jaccard.similar(frame).collect()), key=key) == sorted(brute.similar(docs), key=key)
    assert jaccard.similar(frame.limit(0)).collect() == []


@pytest.mark.parametrize("few, frequent", [(24, 1 << 17), (1, 0)])
def test_jaccard_random_families(spark, monkeypatch, few, frequent):
    """Near copies around the threshold, common passages, sizes at the edge of what can link; any list of frequent tokens will do."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "FREQUENT", max(frequent, 1))
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [words(12) for _ in range(3)]
    docs = []
    for _ in range(12):
        base = words(rng.randrange(8, 90)) + passages[rng.randrange(3)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(copy[: len(copy) - rng.choice([0, 0, len(copy) // 7])])))
    got = sorted(tuple(r) for r in jaccard.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted(brute.similar(docs))


def test_jaccard_link_inside_a_group_of_sizes(spark):
    """A partner of 59 words, at the threshold to one of 49, stands in a group of 58 to 60: it needs fewer prefix tokens than both ends."""
    docs, add = [], lambda words: docs.append((len(docs), " ".join(words)))
    for f in range(20):
        shared = [f"f{f}s{i}" for i in range(48)]
        own = [f"f{f}o{i}" for i in range(11)]
        add([*shared, f"f{f}a"])
        add([*shared, *own])
        add([*shared[:-1], *own])
        add([*shared, *own, f"f{f}x"])
        for k in range(4):
            add([*shared, *(f"f{f}k{k}n{i}" for i in range(100))])
    got = sorted(tuple(r) for r in jaccard.similar(spark.createDataFrame(docs, "doc_id long, text string"), width=1).collect())
    assert got == sorted(brute.similar(docs, width=1))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(200, x) for x in range(201, 240)] + [(5, 5), (3, 2)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# URL filter -------------------------------------------------------------------------------------


def test_urls_table(spark):
    docs = dict(rows("pages", "page_id", "url"))
    got = urls.op6(spark, PATH).collect()
    assert len(got) == len(docs)
    for r in got:
        host, path, rule, label = brute.url_rule(docs[r.page_id], urls.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (label or r.verdict) and r.verdict in ("allow", "block")


def test_urls_cases(spark):
    docs = [(1, None), (2, ""), (3, "HTTP://A.NET"), (4, "http://a.net/"), (5, "x://Net/EN/?a=1"), (None, "x://example.net/en/"), (7, "a://b.org/fr/x://y"), (8, "no"), (9, "q://nÉt.net/\n/"), (9, "q://nÉt.net/\n/")]
    docs += [(10, "x://notexample.net/en/"), (11, "x://a.example.com/de/1#f"), (12, "x://example.com?/de/")]
    frame = spark.createDataFrame(docs, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("label", F.lit(1))
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in urls.judge(frame).collect()), key=key)
    assert got == sorted(((p, *brute.url_rule(u, urls.RULES)[:3]) for p, u in docs), key=key)
    assert urls.judge(frame.limit(0)).collect() == []
    assert {r.verdict for r in urls.judge(frame, rules=[]).collect()} == {"allow"}


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    rows_ = rng.random((4000, len(urls.FEATURES)))
    labels = ((rows_[:, 0] > 0.5) ^ (rows_[:, 5] > 0.7)).astype(float)
    model = urls.Boosted(rows_[:3000], labels[:3000])
    # 32 bins place each of the two cuts within 1/32 of the rows
    assert ((model.chance(rows_[3000:]) > 0.5) == labels[3000:]).mean() > 1 - 2 / 32


# language ---------------------------------------------------------------------------------------


def test_language_held_out(spark):
    langs = dict(rows("documents", "doc_id", "lang"))
    got = language.op7(spark, PATH).collect()
    assert all(r.held_out == (language.crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and langs[r.doc_id] is not None]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held) and sum(r.rejected for r in got) <= 2


def test_language_cases(spark):
    docs = [(1, None, "en"), (2, "", None), (3, "123 ..", "en"), (None, "the cat", None), (4, "éé", "fr"), (5, "the cat sat", "en"), (5, "the cat sat", "en"), (6, "x", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("kept", F.lit(1))
    got = sorted(((r.doc_id, r.lang_pred) for r in language.predict(frame, language.fit(frame), ["doc_id"]).collect()), key=key)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "fr"), (5, "en"), (5, "en"), (6, got[-2][1])], key=key) and got[-2][1] in ("en", "fr")
    assert {r.lang_pred for r in language.predict(frame, language.fit(frame.limit(0)), ["doc_id"]).collect()} == {"und"}
    assert language.predict(frame.limit(0), language.fit(frame), ["doc_id"]).collect() == []


def test_language_rejects_junk_and_left_out_languages():
    import pyarrow as pa

    rng = random.Random(3)
    docs = [(lang, text) for (_, lang), (_, text) in zip(rows("documents", "doc_id", "lang"), rows("documents")) if lang is not None and text]
    vectors = lambda texts: kernel.bytes_of(pa.array(texts, pa.large_string()))
    rest = [d for d in docs if d[0] != "fr"]
    train, held = rest[::2], [t for _, t in rest[1::2]]
    odd = [("en", "".join(rng.choice("qxzjkvw 0123456789") for _ in range(60)))]  # one outlying training text
    model = language.Centroids(language.counts(*vectors([t for _, t in train + odd])), [x for x, _ in train + odd])
    far = lambda texts: model.predict(*vectors(texts))[2].mean()
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     0123456789") for _ in range(rng.choice([400, 1000, 3000]))) for _ in range(200)]
    french = [t for x, t in docs if x == "fr" and len(t) >= 400]
    assert far(held) <= 0.01 and far(junk) >= 0.98 and far(french) >= 0.9


# BPE --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()

    def encode(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return array("I", ids).tobytes(), t.decode(ids, skip_special_tokens=False)

    return encode


def test_no_language_is_lost(spark):
    """One id holds most rows and sorts first; a language late in the alphabet keeps its centroids, and counts once."""
    words = {"aa": "abc abd abe", "zz": "xyz xyw xyv"}
    docs = [(1, words["aa"] + f" ab{i}", "aa") for i in range(3000)] + [(100 + i, words["zz"] + f" xy{i}", "zz") for i in range(40)] + [(9000 + i, words["aa"], "aa") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("h", F.lit("x")).repartition(5)
    model = language.fit(frame, sample=20)
    assert model.value.names == ["aa", "zz"]
    got = {r.doc_id: r.lang_pred for r in language.predict(frame.where("doc_id <> 1"), model, ["doc_id"]).collect()}
    assert all(v == ("zz" if k < 9000 else "aa") for k, v in got.items())


def test_bpe_table(spark, tokenizer):
    def row(doc, text):
        ids, shown = tokenizer(text)
        return doc, len(ids) // 4, brute.sha(ids), brute.sha(shown)

    assert sorted(tuple(r) for r in bpe.op9(spark, PATH).collect()) == sorted(row(*d) for d in rows("documents"))


def test_bpe_random(tokenizer):
    rng, own = random.Random(1), bpe.encoder(bpe.default_vocabulary())
    odd = ["'s", "'LL", "Σ", "İ", "\x1c", "\x85", "\u2028", "á", "<|endoftext|>", "<|startoftext|>", "aaaaaa", "zzzz", "あ", "\U0001f600", "½", "٠", "\u3000", "\x00", "<|", "|>", "the", "there", "1", "22", "...", "--", "_", "\n", " "]
    for _ in range(4000):
        text = "".join(rng.choice(odd) if rng.random() < 0.5 else rng.choice("abcdefghijklmnopqrstuvwxyzABE ") for _ in range(rng.randrange(0, 25))) * (20 if rng.random() < 0.02 else 1)
        ids = own.encoded(text)
        assert (ids, own.decode(array("I", ids))) == tokenizer(text), repr(text)


def test_bpe_cases(spark, tokenizer):
    docs = [(1, None), (2, ""), (None, "a b"), (3, "x" * 5000), (3, "x" * 5000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = bpe.encode(frame).collect()
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in got), key=key) == sorted(((d, *tokenizer(t)) for d, t in docs), key=key)
    assert bpe.encode(frame.limit(0)).collect() == []


# LM scores --------------------------------------------------------------------------------------


def _lm(docs, target):
    """Plain counts over the same classes and cells."""
    import math

    import pyarrow as pa

    def tokens(text):
        data, offsets = kernel.bytes_of(pa.array([text or ""], pa.large_string()))
        word = kernel.Words(data, offsets, kernel.ALNUM).hash
        before = np.concatenate([[np.uint64(0)], word])[: len(word)]
        return list(zip(word.tolist(), lmscore.pair_value(word, before).tolist(), before.tolist()))

    count = [({}, {}, {}) for _ in range(2)]
    for d, text in docs:
        for model in [0] + [1] * (d in target):
            for t in tokens(text):
                for table, x in zip(count[model], t):
                    table[x] = table.get(x, 0) + 1
    for d, text in docs:
        own = tokens(text)
        loss = []
        for words, pairs, first in count:
            total, s = sum(words.values()), 0.0
            for w, p, v in own:
                uni = (words.get(w, 0) + 1) / (total + len(count[0][0]) + 1)
                s -= math.log((pairs.get(p, 0) + lmscore.MU * uni) / (first.get(v, 0) + lmscore.MU))
            loss.append(s / max(len(own), 1))
        yield d, len(own), loss[1] - loss[0] if own else None


@pytest.mark.parametrize("target", [[], [2, 3]])
def test_lm_scores(spark, target):
    docs = [(1, None), (None, "a b a"), (2, "mit license MIT LICENSE a b"), (3, "a b\nc"), (3, "a b\nc"), (4, ""), (5, "zz yy xx")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("model", F.lit(1))
    got = sorted(((r.doc_id, r.n_words, r.score) for r in lmscore.score(lmscore.fit(frame, target)).collect()), key=key)
    want = sorted(_lm(docs, target), key=key)
    for (a, n, x), (b, m, y) in zip(got, want, strict=True):
        assert (a, n) == (b, m) and (x is None) == (y is None) and (x is None or abs(x - y) < 1e-5)
    assert lmscore.score(lmscore.fit(frame.limit(0), target)).collect() == []


def test_lm_table(spark):
    got = lmscore.op10(spark, PATH).collect()
    docs = dict(rows("documents"))
    assert len(got) == len(docs) and all(r.n_words == len(brute.words(docs[r.doc_id])) for r in got)
    good = {d for d, q in rows("labels", "doc_id", "quality") if q == 1}
    mean = lambda keep: np.mean([r.score for r in got if r.score is not None and keep(r.doc_id)])
    assert mean(lambda d: d in good) < mean(lambda d: d not in good)


def _lm_exact(docs, target, mu=64.0):
    """Counts of real words and pairs, nothing hashed."""
    import math
    from collections import Counter

    count = [(Counter(), Counter(), Counter()) for _ in range(2)]
    tokens = [list(zip(w, zip(["", *w], w), ["", *w])) for w in (brute.words(text) for _, text in docs)]
    for (d, _), own in zip(docs, tokens):
        for model in [0] + [1] * (d in target):
            for t in own:
                for table, x in zip(count[model], t):
                    table[x] += 1
    size = len(count[0][0]) + 1
    count = [(w, p, f, w.total()) for w, p, f in count]
    for (d, _), own in zip(docs, tokens):
        loss = [-sum(math.log((p[b] + mu * (w[a] + 1) / (total + size)) / (f[c] + mu)) for a, b, c in own) / max(len(own), 1) for w, p, f, total in count]
        yield d, len(own), loss[1], loss[0]


@pytest.mark.parametrize("span", [5000, 1 << 20])
def test_lm_counts_do_not_collide(spark, span):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["Der", "die", f"w{rng.randrange(150_000)}"]) for _ in range(3000))) for i in range(100)]
    docs += [(None, "der die"), (3, docs[3][1]), (200, ""), (201, None)]
    target = set(range(0, 100, 3))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = lmscore.fit(frame, sorted(target))
    got = sorted((tuple(r) for r in lmscore.score(model, span).collect()), key=key)
    for g, w in zip(got, sorted(_lm_exact([(d, t or "") for d, t in docs], target), key=key), strict=True):
        assert g[:2] == w[:2] and (g[4] is None) == (not w[1])
        assert g[4] is None or max(abs(g[2] - w[2]), abs(g[3] - w[3]), abs(g[4] - (w[2] - w[3]))) < 1e-9 and min(g[2:4]) > 0


def test_lm_target_takes_all_good_documents(spark):
    n = 20_100
    docs = spark.range(n + 2).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = spark.range(n + 2).select(F.col("id").alias("doc_id"), (F.col("id") < n + 1).cast("int").alias("quality"), (F.col("id") == n).cast("int").alias("toxic"))
    model = lmscore.fit(docs, lmscore.good_documents(labels.unionByName(labels)))
    assert (model.n, model.t) == (2 * (n + 2), 2 * n)
