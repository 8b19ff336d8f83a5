"""Personal data: rules, and a skip-chain conditional random field that carries their labels to like tokens.

The rules find e-mail addresses, IP addresses, card and phone numbers. The field labels every candidate token (a run of
characters with a digit or an @). Its parts:

* each token's shape (digits, dots, letters, @, a plus before it) gives the chance of every label;
* a token that a rule covers has that rule's label; one that no rule covers bears the odds `RULE_MISSED` against each kind;
* neighbours in the text share a chain potential;
* tokens that are equal or similar (same letters, same digits, same name before the @), however far apart, share a skip
  potential. Each is linked to the next like token, so links grow with the tokens and labels still reach all of them.

Sum-product messages run over these loops a fixed number of rounds. Tokens beyond the rules whose label is then more
likely than not a kind of personal data become further spans; the rules' own spans always stay.

All potentials are ratios of counts over the whole corpus: how often each shape, each pair of neighbours and each pair of
like tokens carries which labels under the rules. The tables have a fixed number of cells.

Defined cases: a null text is empty and has no spans; repeated rows get equal results and count as often as they stand;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveflow.llm import kernel
from groveflow.llm.registry import query, ready, table

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)  # the label of everything else
LABELS = len(KINDS) + 1
RULE_MISSED = 0.01
ROUNDS, DAMPING = 10, 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\s,;:\"'()<>\[\]{}=|]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def _addresses(text: str):
    """Four numbers joined by dots, one group of four after the other in each dotted run."""
    for m in _DOTTED.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                yield at, at + size
            at += size + 1


def rules(text: str) -> list[tuple[int, int, int]]:
    """Spans (begin, end, kind) of the rules, by begin and then kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    out += [(a, b, 1) for a, b in _addresses(text)]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


class Tokens:
    """Candidate tokens of a text with shape, rule label, neighbours and like tokens."""

    def __init__(self, text: str, spans):
        self.begin, self.end, self.shape, self.label = [], [], [], []
        self.chain, self.skip = [], []
        last: dict[tuple[str, str], int] = {}
        k = 0
        widest = max((b - a for a, b, _ in spans), default=0)
        for m in _TOKEN.finditer(text):
            token = m.group().rstrip(".!?-")
            digits = sum("0" <= c <= "9" for c in token)
            if len(token) < 4 or not (digits or "@" in token):
                continue
            begin, end, i = m.start(), m.start() + len(token), len(self.begin)
            while k < len(spans) and spans[k][0] + widest <= begin:
                k += 1
            label, j = OTHER, k
            while label == OTHER and j < len(spans) and spans[j][0] < end:
                if spans[j][1] > begin:
                    label = spans[j][2]
                j += 1
            if i and begin - self.end[-1] <= 2:
                self.chain.append((i - 1, i))
            self.begin.append(begin)
            self.end.append(end)
            self.label.append(label)
            self.shape.append(self._shape(text, token, begin, digits))
            for key in self._keys(token, digits):
                if key in last:
                    self.skip.append((last[key], i))
                last[key] = i

    @staticmethod
    def _shape(text, token, begin, digits) -> int:
        letters = any(c.isalpha() for c in token)
        plus = text[begin : begin + 1] == "+" or "+" in text[max(0, begin - 8) : begin]
        return (((min(digits, 20) * 5 + min(token.count("."), 4)) * 2 + ("@" in token)) * 2 + letters) * 2 + plus

    @staticmethod
    def _keys(token, digits):
        low = token.lower()
        keys = {("same", low)}
        if digits >= 7:
            keys.add(("digits", "".join(c for c in token if "0" <= c <= "9")))
        name = low.split("@")[0]
        if len(name) >= 6:
            keys.add(("name", name))
        return keys


SHAPES = 21 * 5 * 2 * 2 * 2


class Field:
    """Log potentials from counts: label by shape, pairs of labels of neighbours and of like tokens."""

    def __init__(self, shapes: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        prior = shapes.sum(axis=0) + 1.0
        prior /= prior.sum()
        smoothed = shapes + 4 * prior
        self.unary = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))
        self.missed = np.full(LABELS, np.log(RULE_MISSED))
        self.missed[OTHER] = 0
        self.chain, self.skip = (self._ratio(c) for c in (chain, skip))

    @staticmethod
    def _ratio(pairs: np.ndarray) -> np.ndarray:
        """log p(a, b) / (p(a) p(b)), bounded; ten more pairs, half of them independent and half in agreement, smooth it."""
        pairs = pairs + pairs.T
        single = pairs.sum(axis=1) + 1.0
        single /= single.sum()
        apart = np.outer(single, single)
        joint = (pairs + 5 * apart + 5 * np.diag(single)) / (pairs.sum() + 10)
        return np.clip(np.log(joint / apart), -6, 6)

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """Chance of each label of each token by loopy sum-product."""
        n = len(tokens.begin)
        label = np.array(tokens.label)
        unary = self.unary[np.array(tokens.shape)] + self.missed
        fixed = label != OTHER
        unary[fixed] = -30.0
        unary[fixed, label[fixed]] = 0.0
        edges = np.array(tokens.chain + tokens.skip, np.int64).reshape(-1, 2)
        pair = np.concatenate([np.repeat(self.chain[None], len(tokens.chain), 0), np.repeat(self.skip[None], len(tokens.skip), 0)]) if len(edges) else np.zeros((0, LABELS, LABELS))
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair])  # symmetric
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, message)
            new = np.logaddexp.reduce((belief[source] - message[back])[:, :, None] + pair, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        belief = unary.copy()
        np.add.at(belief, target, message)
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True)) if n else belief

    def open(self, tokens: Tokens) -> bool:
        """Whether any token outside the rules may get a kind. An edge shifts the log odds of a kind against OTHER by no more
        than the widest step in its potentials; where the kinds' odds with all those steps add up to at most one, none exceeds 0.5."""
        free = np.array(tokens.label) == OTHER
        if not free.any():
            return False
        odds = self.unary[np.array(tokens.shape)] + self.missed
        odds = odds[:, :OTHER] - odds[:, OTHER:]
        for edges, pair in ((tokens.chain, self.chain), (tokens.skip, self.skip)):
            ends = np.bincount(np.array(edges, np.int64).reshape(-1), minlength=len(free))
            odds = odds + ends[:, None] * np.maximum((pair[:, :OTHER] - pair[:, OTHER:]).max(axis=0), 0)
        return bool((np.logaddexp.reduce(odds[free], axis=1) > 0).any())

    def added(self, text: str, spans) -> list[tuple[int, int, int]]:
        """Further spans: tokens outside the rules' spans that are more likely personal data than not."""
        tokens = Tokens(text, spans)
        label = np.array(tokens.label)
        if not self.open(tokens):
            return []
        chance = self.marginals(tokens)
        best = chance.argmax(axis=1)
        hit = np.flatnonzero((label == OTHER) & (best != OTHER) & (chance[np.arange(len(best)), best] > 0.5))
        return [(tokens.begin[i], tokens.end[i], int(best[i])) for i in hit.tolist()]


def _interesting(column: pa.Array) -> np.ndarray:
    """Rows that hold a digit or an @."""
    data, offsets = kernel.bytes_of(column)
    hit = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
    return np.flatnonzero(hit[offsets[1:]] > hit[offsets[:-1]])


def _observe(batches):
    """Per task: counts of labels by shape, of neighbours and of like tokens."""
    counts = Counter()
    for batch in batches:
        column = kernel.texts(batch.column("text"))
        for a, b in kernel.slices(column):
            part = column.slice(a, b - a)
            for i in _interesting(part).tolist():
                text = part[i].as_py()
                tokens = Tokens(text, rules(text))
                for shape, label in zip(tokens.shape, tokens.label):
                    counts[0, shape, label] += 1
                for kind, pairs in ((1, tokens.chain), (2, tokens.skip)):
                    for x, y in pairs:
                        counts[kind, tokens.label[x], tokens.label[y]] += 1
    if counts:
        rows = [(*k, n) for k, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows)], names=["part", "x", "y", "n"])


def fit(docs: DataFrame):
    """The field's potentials from all documents, as a broadcast; at most SHAPES * 5 + 50 rows reach the driver."""
    spark = docs.sparkSession
    ready(spark)
    found = docs.select("text").mapInArrow(_observe, "part bigint, x bigint, y bigint, n bigint").groupBy("part", "x", "y").agg(F.sum("n").alias("n")).collect()
    parts = [np.zeros((SHAPES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
    for r in found:
        parts[r.part][r.x, r.y] += r.n
    return spark.sparkContext.broadcast(Field(*parts))


def shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans) -> str:
    """Every span, or run of overlapping spans, becomes the name of its first kind in angle brackets."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, field, keep: list[str], redacted: bool = True, nested: bool = False) -> DataFrame:
    """The columns `keep` (nested: as one struct `kept`), counts per kind by the rules, base_spans, spans (text form), and, if wanted, the redacted text.

    redacted is null where nothing is found.
    """
    ready(docs.sparkSession)
    empty = ((), [0] * len(KINDS), "", "", None)

    def run(batches):
        f = field.value
        for batch in batches:
            column = kernel.texts(batch.column("text"))
            for a, b in kernel.slices(column):
                part = column.slice(a, b - a)
                rows = [empty] * (b - a)
                for i in _interesting(part).tolist():
                    text = part[i].as_py()
                    base = rules(text)
                    spans = sorted(base + f.added(text, base), key=lambda s: (s[0], s[2]))
                    if spans:
                        kinds = [k for _, _, k in base]
                        rows[i] = (base, [kinds.count(k) for k in range(len(KINDS))], shown(base), shown(spans), redact(text, spans) if redacted else None)
                names = [*(f"n_{k}" for k in KINDS), "base_spans", "spans", "redacted"]
                columns = [pa.array([r[1][k] for r in rows], pa.int64()) for k in range(len(KINDS))] + [pa.array([r[j] for r in rows], pa.string()) for j in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([batch.column("kept").slice(a, b - a), *columns], names=["kept", *names])

    rows = docs.select("text", F.struct(*keep).alias("kept"))
    kinds = ", ".join(f"n_{k} bigint" for k in KINDS)
    return rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, {kinds}, base_spans string, spans string, redacted string").select(
        "kept" if nested else "kept.*", *(f"n_{k}" for k in KINDS), "base_spans", "spans", "redacted"
    )


@query("op8_pii")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs), ["doc_id"], redacted=False)
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")
