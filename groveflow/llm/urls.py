"""URL filters: host rules, and gradient-boosted trees on lexical features for the rest.

Rules name a host and a path; they fit the host and its subdomains where the path begins like theirs, and the longest
fitting rule decides. URLs that a rule decides are the labelled ones. Boosted trees are trained on them with lexical
features (lengths, depth, digit ratio, entropy, parameter counts, hyphens, and the share of blocked URLs among the
labelled ones of the same host suffix) and judge the URLs without a rule.

The trees are fitted on at most `SAMPLE` labelled URLs (in hash order; all, if there are fewer) by histograms on the
driver: a fixed amount of work. Suffix statistics are counts over all labelled URLs and are joined by suffix.

Defined cases: a null URL or one without `://` has empty host and path, no rule, and is judged by its (possibly empty) text;
without labelled URLs everything without a rule is allowed; repeated rows get equal results and count as often as they
stand; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveflow.llm.registry import query, ready, table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 40, 3, 32, 0.2, 20
PRIOR = 10.0  # weight of the overall share in a suffix's share

FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "query_length", "hyphens", "secure", "suffix_share"]


def lexical(url: str | None, host: str, path: str, share: float) -> list[float]:
    url = url or ""
    n = max(len(url), 1)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
    query = url.partition("#")[0].partition("?")[2]
    return [
        len(url),
        len(host),
        len(path),
        sum(1 for p in path.split("/") if p),
        host.count(".") + 1 if host else 0,
        sum("0" <= c <= "9" for c in url) / n,
        entropy,
        sum(1 for p in query.split("&") if p),
        len(query),
        url.count("-"),
        url[:6].lower() == "https:",
        share,
    ]


class Boosted:
    """Gradient-boosted regression trees for the logistic loss over binned features."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(rows) else np.zeros(0) for j in range(len(FEATURES))]
        self.trees: list[list[tuple]] = []
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        self.base = math.log(rate / (1 - rate)) if len(labels) else -1.0
        bins = self._bins(rows)
        score = np.full(len(labels), self.base)
        for _ in range(TREES if 0 < labels.sum() < len(labels) else 0):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(bins, labels - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            score += self._values(tree, bins)

    def _bins(self, rows):
        return np.stack([np.searchsorted(e, rows[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(rows) else np.zeros((0, len(FEATURES)), np.int64)

    def _grow(self, bins, gradient, hessian):
        """Nodes in heap order: (feature, bin) to go left at or below it, or a leaf's value."""
        nodes: list[tuple] = [("leaf", 0.0)] * (2 ** (DEPTH + 1) - 1)
        todo = [(0, np.arange(len(gradient)))]
        while todo:
            at, rows = todo.pop()
            g, h = gradient[rows].sum(), hessian[rows].sum()
            nodes[at] = ("leaf", RATE * g / (h + 1))
            if at >= 2**DEPTH - 1 or len(rows) < 2 * LEAST:
                continue
            best = (1e-9, None, None)
            for j in range(bins.shape[1]):
                size = len(self.edges[j]) + 1
                own = bins[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(own, w, size))[:-1] for w in (gradient[rows], hessian[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = -1
                if len(gain) and gain.max() > best[0] + 1e-12:
                    best = (gain.max(), j, int(gain.argmax()))
            if best[1] is not None:
                _, j, cut = best
                nodes[at] = ("split", j, cut)
                left = bins[rows, j] <= cut
                todo += [(2 * at + 1, rows[left]), (2 * at + 2, rows[~left])]
        return nodes

    @staticmethod
    def _values(nodes, bins):
        at = np.zeros(len(bins), np.int64)
        feature = np.array([n[1] if n[0] == "split" else -1 for n in nodes])
        cut = np.array([n[2] if n[0] == "split" else 0 for n in nodes])
        value = np.array([n[1] if n[0] == "leaf" else 0.0 for n in nodes])
        for _ in range(DEPTH):
            inner = feature[at] >= 0
            right = bins[np.arange(len(bins)), np.maximum(feature[at], 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def chance(self, rows: np.ndarray) -> np.ndarray:
        bins = self._bins(rows)
        return 1 / (1 + np.exp(-(self.base + sum(self._values(t, bins) for t in self.trees) + np.zeros(len(rows)))))


def _parts(pages: DataFrame, rules) -> DataFrame:
    """host, path, rule, label of every URL, and its suffix (last label of the host)."""
    mark = F.instr("url", "://")
    rest = F.when(mark > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = pages.withColumn("rest", F.coalesce(rest, F.lit("")))
    out = out.withColumn("host", F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), upper, upper.lower()))
    out = out.withColumn("path", F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1)).drop("rest")
    rule = label = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, label = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(label)
    return out.withColumn("rule", rule).withColumn("label", label).withColumn("suffix", F.substring_index("host", ".", -1))


def _features(rows) -> np.ndarray:
    return np.array([lexical(*r) for r in rows], np.float64).reshape(-1, len(FEATURES))


def judge(pages: DataFrame, rules=None, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score (chance of block by the trees)."""
    spark = pages.sparkSession
    ready(spark)
    found = _parts(pages.select("page_id", "url"), RULES if rules is None else rules)
    blocked = (F.col("label") == "block").cast("double")
    labelled = found.where("label is not null")
    stats = labelled.groupBy("suffix").agg(F.sum(blocked).alias("blocked"), F.count("*").alias("times"))
    total = stats.agg(F.sum("blocked").alias("b"), F.sum("times").alias("n")).first()
    overall = (total.b or 0.0) / max(total.n or 0, 1)
    share = (F.coalesce("blocked", F.lit(0.0)) + PRIOR * overall) / (F.coalesce("times", F.lit(0)) + PRIOR)
    found = found.join(stats, "suffix", "left").withColumn("share", share).select("page_id", "url", "host", "path", "rule", "label", "share")
    train = found.where("label is not null").select("url", "host", "path", "share", "label")
    train = train.orderBy(F.xxhash64("url"), "url").limit(sample).collect()
    labels = np.array([float(r.label == "block") for r in train])
    model = spark.sparkContext.broadcast(Boosted(_features([tuple(r)[:4] for r in train]), labels))

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("url", "host", "path", "share")]
            chance = model.value.chance(_features(zip(*columns)))
            verdict = [x or ("block" if c > 0.5 else "allow") for x, c in zip(batch.column("label").to_pylist(), chance.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(chance, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return found.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


@query("op6_url_filter")
def op6(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))
