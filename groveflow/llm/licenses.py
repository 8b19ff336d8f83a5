"""License scans: template markup compiled to token automata.

A template is wording with `<<optional>> ... <<end>>` regions and `<<var:n>>` regions that stand for up to n words
of any kind. It becomes an automaton over words; a text carries the template's label where a run of its words leads
from the start to the accepting state, that is, where all mandatory wording stands in order and without change.
Base phrases are templates without regions, counted at every place. Only texts that hold one rare word of some
template run the automata; finding those words is an array operation.

Defined cases: a null text is empty (no words, no labels, score 0); repeated rows get equal results; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from groveflow.llm import kernel
from groveflow.llm.registry import query, ready, table

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The wording of licences and notices. Label, the word that must occur for the template to be tried, template.
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<var:1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<var:1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
_BSD_END = (
    "this software is provided by <<var:8>> as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:8>> be liable for any direct indirect incidental "
    "special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
    "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
_ISC_END = (
    "the software is provided as is and <<var:6>> disclaims all warranties with regard to this software including all implied warranties of "
    "merchantability and fitness in no event shall <<var:6>> be liable for any special direct indirect or consequential damages or any damages "
    "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
    "connection with the use or performance of this software"
)
_GPL = "<<var:3>> is free software you can redistribute it and or modify it under the terms of the "
_GPL_END = (
    "as published by the free software foundation either version <<var:2>> of the license or at your option any later version <<var:3>> is distributed "
    "in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular "
    "purpose see the "
)
_LINE = "<<optional>>copyright <<var:12>><<end>> "  # a copyright line

#: Whole texts and standard notices: a match means that nothing mandatory was changed.
WHOLE = [
    (
        "mit",
        "noninfringement",
        "<<optional>>mit license<<end>> " + _LINE + "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following "
        "conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or "
        "substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var:8>> be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("bsd-2-clause", "redistributions", _LINE + _BSD + _BSD_END),
    (
        "bsd-3-clause",
        "endorse",
        _LINE + _BSD + "<<var:1>> neither the name of <<var:12>> nor the names of <<var:3>> contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission " + _BSD_END,
    ),
    ("isc", "disclaims", "<<optional>>isc license<<end>> " + _LINE + _ISC + "provided that the above copyright notice and this permission notice appear in all copies " + _ISC_END),
    ("0bsd", "disclaims", _LINE + _ISC + _ISC_END),
    (
        "apache",
        "apache",
        _LINE + "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of "
        "the license at <<var:1>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the "
        "license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language "
        "governing permissions and limitations under the license",
    ),
    ("gpl", "gnu", _LINE + _GPL + "gnu general public license " + _GPL_END + "gnu general public license for more details"),
    ("lgpl", "lesser", _LINE + _GPL + "gnu lesser general public license " + _GPL_END + "gnu lesser general public license for more details"),
]

#: Openings and mentions: the licence is named or begins, what follows is not looked at.
TEMPLATES = [
    ("mit", "mit", "<<optional>>released<<end>> under the <<optional>>terms of the<<end>> mit <<optional>>open source<<end>> license"),
    (
        "mit",
        "hereby",
        "permission is hereby granted free of charge to any person obtaining a copy of <<var:4>> software and associated documentation files "
        "<<optional>>the software<<end>> to deal in <<var:3>> without restriction",
    ),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache", "apache", "licensed under the apache license <<optional>>version <<var:2>><<end>>"),
    ("gpl", "gnu", "licensed under <<optional>>the terms of<<end>> the gnu general public license <<optional>>version <<var:2>><<end>>"),
    ("gpl", "gnu", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "lesser", "gnu <<optional>>library or<<end>> lesser general public license"),
    ("mpl", "mozilla", "mozilla public license <<optional>>v<<end>> <<optional>>version<<end>> <<var:2>>"),
    ("cc-by-nc", "cc", "licensed under <<optional>>a<<end>> cc by nc <<optional>>sa<<end>> <<var:2>>"),
    ("cc-by", "cc", "licensed under <<optional>>a<<end>> cc by <<optional>>sa<<end>> 4 0"),
    ("cc", "commons", "creative commons attribution <<var:3>> <<optional>>international<<end>> license"),
    ("proprietary", "reserved", "all rights reserved"),
]


class Automaton:
    """States are numbers; per state the words and the any-word steps to other states, after free moves."""

    def __init__(self, template: str):
        self.steps: list[dict[str, set[int]]] = [{}]
        self.free: list[set[int]] = [set()]
        self.any: list[set[int]] = [set()]
        self.mandatory = 0
        at, opened = 0, []
        for part in re.findall(r"<<[a-z]+(?::\d+)?>>|[^\s<]+", template):
            if part == "<<optional>>":
                opened.append(at)
            elif part == "<<end>>":
                self.free[opened.pop()].add(at)
            elif part.startswith("<<var:"):
                first, ways = at, []
                for _ in range(int(part[6:-2])):
                    new = self._state()
                    self.any[at].add(new)
                    ways.append(at)
                    at = new
                for s in (first, *ways):
                    if s != at:
                        self.free[s].add(at)
            else:
                new = self._state()
                self.steps[at].setdefault(part, set()).add(new)
                self.mandatory += not opened
                at = new
        if opened:
            raise ValueError(f"open region in {template!r}")
        self.accept = at
        self.begin = self._closed({0})
        self.first = {w for s in self.begin for w in self.steps[s]}
        self.words = {w for d in self.steps for w in d}

    def _state(self) -> int:
        self.steps.append({})
        self.free.append(set())
        self.any.append(set())
        return len(self.steps) - 1

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def match(self, words, at: int) -> int | None:
        """End of the shortest accepted run of words that begins at `at`."""
        states = self.begin
        while states:
            if self.accept in states:
                return at
            if at >= len(words):
                return None
            w, moved = words[at], set()
            for s in states:
                moved |= self.any[s] | self.steps[s].get(w, set())
            states, at = self._closed(moved), at + 1
        return None


def _hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return kernel.Words(data, np.array([0, len(data)]), kernel.ALNUM).hash


class Scanner:
    def __init__(self, templates=None, base=None):
        self.base = {tuple(p.split()): label for p, label in (BASE if base is None else base).items()}
        # given templates are whole texts
        every = [(*x, True) for x in (WHOLE if templates is None else templates)] + [(*x, False) for x in (TEMPLATES if templates is None else [])]
        self.templates = [(label, rare, Automaton(t), whole) for label, rare, t, whole in every]
        for _, rare, a, _ in self.templates:
            if rare not in a.words:
                raise ValueError(f"{rare!r} is not a word of its template")
        names = sorted({w for p in self.base for w in p} | {w for _, _, a, _ in self.templates for w in a.words})
        hashes = _hash(names) if names else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.names = hashes[order], np.array([names[i] for i in order] + [""], object)
        rare = {r for _, r, _, _ in self.templates} | {p[-1] for p in self.base}
        self.rare = np.array([n in rare for n in self.names[:-1]], bool)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word among the template words; the number of names if it is none of them."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at, len(self.hashes)) if len(self.hashes) else np.zeros(len(hashes), np.int64)

    def scan(self, words) -> tuple[list[tuple[int, str]], list[tuple[int, int, bool, str]]]:
        """Base places (start, label) and template matches (start, end, whether it is a whole text, label)."""
        where: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w:
                where.setdefault(w, []).append(i)
        places = []
        for phrase, label in self.base.items():
            for i in where.get(phrase[0], ()):
                if tuple(words[i : i + len(phrase)]) == phrase:
                    places.append((i, label))
        matches = []
        for label, rare, automaton, whole in self.templates:
            if rare in where:
                for i in sorted({i for w in automaton.first for i in where.get(w, ())}):
                    if (end := automaton.match(words, i)) is not None:
                        matches.append((i, end, whole, label))
        return sorted(places), matches


def scan(docs: DataFrame, templates=None, base=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (word spans with labels).

    score: 1 where a whole licence text or notice stands unchanged (any of the given templates), 0.75 where only an opening or
    a mention does, 0.5 where only a base phrase stands, else 0.
    """
    ready(docs.sparkSession)

    def run(batches):
        scanner = Scanner(templates, base)
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("whole", pa.bool_())]))
        for batch in batches:
            column = kernel.texts(batch.column("text"))
            for a, b in kernel.slices(column):
                data, offsets = kernel.bytes_of(column.slice(a, b - a))
                w = kernel.Words(data, offsets, kernel.ALNUM)
                known = scanner.known(w.hash)
                hit = np.flatnonzero(known < len(scanner.hashes))
                hit = hit[scanner.rare[known[hit]]]
                rows = np.unique(np.searchsorted(w.first, hit, "right") - 1)
                out = [[0, None, None, "", "", 0.0, []] for _ in range(b - a)]
                for r in rows.tolist():
                    places, matches = scanner.scan(scanner.names[known[w.first[r] : w.first[r + 1]]].tolist())
                    own = sorted({label for _, label in places})
                    labels = sorted({*own, *(label for *_, label in matches)})
                    out[r] = [len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(own), ",".join(labels)]
                    best = 1.0 if any(m[2] for m in matches) else 0.75 if matches else 0.5 if places else 0.0
                    out[r] += [best, [dict(zip(("begin", "end", "whole", "label"), m)) for m in matches]]
                columns = list(zip(*out))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), kind]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(w.count, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "matches array<struct<begin: bigint, `end`: bigint, label: string, whole: boolean>>",
    )


@query("op2_licenses")
def op2(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).drop("matches")
