"""BPE encoding and decoding by per-prefix dynamic programming.

The prefixes of a merge-based encoding each end in exactly one token, and two tokens may stand side by side only
if no merge crosses their boundary earlier than the merges that built them. So for every prefix of a word the
unique last token is stored: of the vocabulary entries that end there (found by a suffix-link automaton over the
vocabulary) the one that is compatible with the last token of the prefix it leaves. Back-pointers give the ids.
No merge loop runs. Words are cut by the file's own normaliser and pattern, each distinct word is encoded once per
task and kept in a table of bounded size.

Defined cases: a null or empty text has no tokens; texts with the strings of special tokens get their ids; repeated
rows get equal results; extra columns are kept or ignored as the caller says.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
import unicodedata
from array import array

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveflow.llm.registry import query, ready, table

NEVER = 1 << 60
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are packed as little-endian 32-bit integers")
KEEP_WORDS = 300_000  # distinct words that a task remembers; beyond that it starts anew


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(shown)]
    place = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [place[b] for b in range(256)]


class WordBpe:
    """Encoder for a `tokenizers` file whose model is BPE with an end-of-word suffix over byte-level symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.shown = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.separators = regex.compile("[\x1c-\x1f]")  # blanks to str.split, not to the pattern
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            made = ids[a + b]
            if made in self.parts:
                raise ValueError(f"two merges make token {made}")
            self.merge[ids[a], ids[b]] = r
            self.parts[made] = ids[a], ids[b]
            self.rank[made] = r
        # one character per base symbol: a byte inside a word, or a byte that ends it
        symbols = byte_symbols()
        self.inner = {b: chr(256 + b) for b in range(256)}
        self.final = [chr(512 + b) for b in range(256)]
        base = {ids[s]: self.inner[b] for b, s in enumerate(symbols)} | {ids[s + self.suffix]: self.final[b] for b, s in enumerate(symbols)}
        spelled = dict(base)

        def spell(t: int) -> str:
            if t not in spelled:
                a, b = self.parts[t]
                spelled[t] = spell(a) + spell(b)
            return spelled[t]

        self.automaton = ahocorasick.Automaton()
        for t in sorted(self.parts, key=self.rank.get):
            spell(t)
        self.left_spine = {t: self._spine(t, 0) for t in spelled}
        self.right_spine = {t: self._spine(t, 1) for t in spelled}
        for t, text in spelled.items():
            if t not in self.parts or self._reachable(t):
                self.automaton.add_word(text, (t, len(text)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def _spine(self, t: int, side: int) -> list[tuple[int, int]]:
        """Symbols at one edge of a token while it is built, each with the rank of the merge that uses it up."""
        out, until = [], NEVER
        while True:
            out.append((t, until))
            if t not in self.parts:
                return out
            until, t = self.rank[t], self.parts[t][side]

    def _crossed(self, a: int, b: int, below: int) -> bool:
        """Whether a merge of rank under `below` joins symbols across the boundary of a and b.

        Equal pairs in a row merge from the left: an equal rank on the left side comes first, on the right later.
        """
        merge = self.merge
        for x, x_until in self.right_spine[a]:
            for y, y_until in self.left_spine[b]:
                r = merge.get((x, y))
                if r is not None and r < x_until and r <= y_until and r < below:
                    return True
        return False

    def _reachable(self, t: int) -> bool:
        """A token whose own text is encoded as something else never appears."""
        a, b = self.parts[t]
        return not self._crossed(a, b, self.rank[t])

    def _compatible(self, a: int, b: int) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            got = self.fits[a, b] = not self._crossed(a, b, NEVER)
        return got

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode()
        text = "".join([*map(self.inner.__getitem__, raw[:-1]), self.final[raw[-1]]])
        ends: list[list[tuple[int, int]]] = [[] for _ in range(len(text) + 1)]
        for end, found in self.automaton.iter(text):
            ends[end + 1].append(found)
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)
        if len(text) > 100:  # no deep recursion: every prefix in turn
            for end in range(1, len(text) + 1):
                self._last(end, ends, last)
        else:
            self._last(len(text), ends, last)
        out, at = [], len(text)
        while at:
            t, n = last[at]
            out.append(t)
            at -= n
        return out[::-1]

    def _last(self, end: int, ends, last):
        """The last token of the prefix of length `end`, from those of the prefixes that its matches leave."""
        for t, n in ends[end]:
            rest = end - n
            if rest:
                before = last[rest]
                if before is None:
                    before = self._last(rest, ends, last)
                if not before or not self._compatible(before[0], t):
                    continue
            last[end] = t, n
            return last[end]
        last[end] = ()  # no token ends here in any encoding
        return ()

    def pieces(self, text: str):
        """Runs without white space, normalised; no word of the pattern crosses them."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if self.separators.search(text):
            return self.split.findall(text)
        return text.split()

    def encoded(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<" in text and self.cut is not None and any(t in text for t in self.special):
            parts = [p for p in self.cut.split(text) if p]
        else:
            parts = [text]
        out, known = [], self.known
        for part in parts:
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
                continue
            found = self.pieces(part)
            try:
                got = [known[w] for w in found]
            except KeyError:
                if len(known) > KEEP_WORDS:
                    known.clear()
                for w in found:
                    if w not in known:
                        known[w] = self._entry(w)
                got = [known[w] for w in found]
            out += got
        return b"".join(out)

    def _entry(self, piece: str) -> bytes:
        words = self.split.findall(piece)
        if len(words) == 1 and words[0] == piece:
            ids = self.word_ids(piece)
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join([self.known.get(w) or self._entry(w) for w in words])

    def decode(self, ids) -> str:
        """The file names no decoder, so tokens are joined by blanks."""
        return " ".join(map(self.shown.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """One encoder per process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id by default), n_tokens, ids (binary, little-endian 32-bit), decoded text.

    `vocabulary` is a file that every worker can open (part of its Python installation).
    """
    ready(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            size = batch.num_rows
            for at in range(0, size, 256):
                part = batch.slice(at, min(256, size - at))
                ids = [bpe.encoded(t or "") for t in part.column("text").to_pylist()]
                shown = [bpe.decode(array("I", i)) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("kept"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(shown, pa.string())],
                    names=["kept", "n_tokens", "ids", "decoded"],
                )

    rows = docs.select("text", F.struct(*keep).alias("kept"))
    return rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, n_tokens bigint, ids binary, decoded string").select("kept.*", "n_tokens", "ids", "decoded")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of ids and of the decoded text, hashed where the text is encoded."""
    ready(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column("text"):
                ids = bpe.encoded(t.as_py() or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(array("I", ids)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@query("op9_bpe")
def op9(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
