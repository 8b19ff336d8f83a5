"""Decontamination, licences, repeated byte strings, personal data: all rows of the small tables against plain versions."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import PATH, key, rows

from groveflow.llm import decontaminate, licenses, personal, suffixes


def test_decontaminate_table(spark):
    got = [tuple(r) for r in decontaminate.op1(spark, PATH).collect()]
    assert sorted(got) == sorted(brute.decontaminate(rows("documents"), rows("benchmark", "item_id")))


BASE = "A b c d e f g h i j k l m n o p q"
DOCS = [(1, None), (2, ""), (3, "one two three"), (4, BASE), (4, BASE), (5, "x one Two, y z"), (None, BASE.lower()), (6, "é É " + "w " * 16)]
ITEMS = [(1, "one two"), (2, "c d e f g h i j k l m n o p q r s"), (3, None), (4, ""), (None, "one two three"), (10, "w " * 13), (5, "a b c d e"), (1, "one two")]


def _contract(found):
    for r in found.collect():
        ids = sorted(str(x) for x in r.item_ids or [])
        yield r.doc_id, r.n_words, r.n_hit, len(ids), brute.sha(",".join(ids)), r.n_hit > 0 and 20 * r.n_hit >= r.n_words


def test_decontaminate_cases(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("hits", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("h", F.lit(0))
    assert sorted(_contract(decontaminate.decontaminate(docs, items)), key=key) == sorted(brute.decontaminate(DOCS, ITEMS), key=key)
    assert all(r.n_hit == 0 for r in decontaminate.decontaminate(docs, items.limit(0)).collect())
    assert decontaminate.decontaminate(docs.limit(0), items).collect() == []


def test_passage_of_many_items_and_documents(spark):
    """500 items hold one passage, a third of the documents too: documents meet one class, and every item is listed."""
    passage = " ".join(f"p{i}" for i in range(20))
    items = [(i, passage) for i in range(500)] + [(1000 + i, f"{passage} tail{i}") for i in range(3)] + [(None, passage)]
    docs = [(i, f"a{i} {passage} z{i}" if i % 3 == 0 else f"clean words {i}") for i in range(90)] + [(200, "x " * 100 + passage)]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(_contract(decontaminate.decontaminate(*frames))) == sorted(brute.decontaminate(docs, items))
    named = spark.createDataFrame([(f"i{i}", t) for i, t in items], "item_id string, text string")
    got = decontaminate.decontaminate(frames[0], named).where("n_hit > 0").collect()
    assert {len(r.item_ids) for r in got} == {504}


def test_decontaminate_random(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    items = [(i, text(rng.randrange(0, 18))) for i in range(30)] + [(100 + i, docs[i][1]) for i in range(0, 60, 7)]
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(_contract(found)) == sorted(brute.decontaminate(docs, items))


# licences ---------------------------------------------------------------------------------------


def _licence_row(doc, text):
    w, found = brute.words(text), []
    for phrase, label in licenses.BASE.items():
        phrase = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(phrase)] == phrase]
    found.sort()
    return doc, len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


def test_licences_table(spark):
    got = licenses.op2(spark, PATH).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((_licence_row(*d) for d in rows("documents")), key=key)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the MIT License.", "mit"),
        ("Under the terms of the MIT open source license", "mit"),
        ("under the terms of MIT license", "mit"),  # base phrase only: mandatory wording is missing
        ("Licensed under the Apache License, Version 2.0.", "apache"),
        ("licensed under the Apache  Software License", ""),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("All rights are reserved. All rights reserved!", "proprietary"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "mit"),
        ("Permission is hereby granted, free of cost, to any person obtaining a copy of this software and associated documentation files", ""),
        (None, ""),
        ("", ""),
    ],
)
def test_licence_templates(text, labels):
    places, matches = licenses.Scanner().scan(brute.words(text))
    assert ",".join(sorted({x for _, x in places} | {x for *_, x in matches})) == labels


def _pattern(template):
    """The template as a regular expression over words that each end with a blank."""
    import re

    parts = []
    for x in re.findall(r"<<[a-z]+(?::\d+)?>>|[^\s<]+", template):
        parts.append("(?:" if x == "<<optional>>" else ")?" if x == "<<end>>" else f"(?:[^ ]+ ){{0,{x[6:-2]}}}" if x.startswith("<<var") else x + " ")
    return re.compile("(?<![^ ])" + "".join(parts))


WORDING = {label: t for label, _, t in licenses.WHOLE}


def _text(label, holder="the authors"):
    """The template's own wording, with its optional parts, and words for what is replaceable."""
    import re

    return re.sub(r"<<var:\d+>>", holder, WORDING[label].replace("<<var:1>>", "1")).replace("<<optional>>", "").replace("<<end>>", "")


def test_licences_by_regular_expressions(spark):
    """Labels and score of all rows, of whole texts and of changed ones against a pattern for each template."""
    docs = rows("documents") + [(-i, "Preface. " + _text(x).upper() + " End") for i, x in enumerate(WORDING, 1)]
    docs += [(-100 - i, _text(x).replace(" the ", " the very ", 1 + i % 2)) for i, x in enumerate(WORDING)]
    whole, opening = ([(label, _pattern(t)) for label, _, t in x] for x in (licenses.WHOLE, licenses.TEMPLATES))
    for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        text = "".join(w + " " for w in brute.words(dict(docs)[r.doc_id]))
        found = [{label for label, p in x if p.search(text)} for x in (whole, opening)]
        base = {x for x in r.base_labels.split(",") if x}
        assert r.labels == ",".join(sorted(found[0] | found[1] | base)), r.doc_id
        assert r.score == (1.0 if found[0] else 0.75 if found[1] else 0.5 if base else 0.0)


@pytest.mark.parametrize("label", list(WORDING))
def test_changed_clause_is_no_licence(label):
    """Each mandatory word matters: without one of the last words, or with one more, the text is not whole."""
    scanner = licenses.Scanner()
    is_whole = lambda words: (label, True) in {(m[3], m[2]) for m in scanner.scan(words)[1]}
    words = _text(label, "zz zz").split()
    assert is_whole(words) and is_whole(["x", *words, "y"])
    for at in (len(words) - 2, len(words) * 2 // 3):
        at = next(i for i in range(at, len(words)) if words[i] != "zz")
        assert not is_whole(words[:at] + words[at + 1 :])
    assert not is_whole(words[: len(words) - 4] + ["not"] + words[len(words) - 4 :])


def test_licence_automaton():
    a = licenses.Automaton("a <<optional>>b <<var:2>><<end>> c")
    assert [a.match(t.split(), 0) for t in ("a c", "a b c", "a b x c", "a b x y c", "a b x y z c", "a x c", "a b")] == [2, 3, 4, 5, None, None, None]


def test_licence_cases(spark):
    docs = [(1, None), (None, "a b"), (2, "mit license MIT LICENSE"), (2, "mit license MIT LICENSE")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x"))
    assert sorted((tuple(r)[:6] for r in licenses.scan(frame).collect()), key=key) == sorted((_licence_row(*d) for d in docs), key=key)
    assert licenses.scan(frame.limit(0)).collect() == []


# repeated byte strings --------------------------------------------------------------------------


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for _ in range(200):
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6))]
        strings += strings[:1] * (rng.random() < 0.3)
        data, bounds = np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        array, rank = suffixes.suffix_array(data, bounds)
        want = sorted((s[i:], k, int(bounds[k]) + i) for k, s in enumerate(strings) for i in range(len(s)))
        assert array.tolist() == [p for *_, p in want]
        common = suffixes.common_prefixes(data, bounds, array, rank)
        for (a, *_), (b, _, p) in zip(want, want[1:]):
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[p] == n


def _removed(spark, docs, **how):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("c", F.lit(1)).withColumn("spans", F.lit(1))
    got = suffixes.remove_repeats(frame, **how).collect()
    assert all(brute.sha(bytes(r.kept)) == r.kept_sha256 for r in got)
    return sorted((tuple(r)[:5] for r in got), key=key), sorted(brute.remove_repeats(docs, how.get("length", 200)), key=key)


def test_suffixes_cases(spark):
    rng = random.Random(3)
    line = "".join(rng.choice("abcdef ") for _ in range(230))
    docs = [(1, None), (2, ""), (3, "x" * 1000), (4, line + "é" * 200 + line), (5, "q" + line[3:] + "zz"), (5, "q" + line[3:] + "zz")]
    docs += [(None, "k" * 50 + line[:199] + "!"), (7, "ab" * 300), (8, "abc" * 90), (9, line[20:225])]
    got, want = _removed(spark, docs)
    assert got == want
    assert suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").limit(0)).collect() == []


@pytest.mark.parametrize("group", [2000, 7])  # 7: groups of contexts are dealt over several shards
def test_suffixes_random(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = random.Random(4)
    docs = [(i, "".join(rng.choice(["the ", "of ", "and ", "cat "]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    got, want = _removed(spark, docs, length=20, gram=6)
    assert got == want


def test_suffixes_table(spark):
    got = sorted((tuple(r) for r in suffixes.op4(spark, PATH).collect()), key=key)
    assert got == sorted(brute.remove_repeats(rows("documents")), key=key)


# personal data ----------------------------------------------------------------------------------


def test_personal_rules():
    rng = random.Random(5)
    parts = ["a", "b.", "@", "x@y.z", ".", "..", "1", "12", "255", "256", "1.2.3.4", ".5", "+", "+1", " ", "-", "(", ")", "4111111111111111", "4111 1111-", "é", "_", "%", "0"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert [(a, k, b, personal.KINDS[k]) for a, b, k in personal.rules(text)] == brute.personal(text), text


def test_personal_long_text():
    assert personal.rules("1" * 100_000 + "a" * 100_000 + "+" + " " * 100_000 + "1.") == []


def test_personal_table(spark):
    got = personal.op8(spark, PATH).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(brute.personal_row(*d) for d in rows("documents"))
    for r, text in ((r, dict(rows("documents"))[r.doc_id]) for r in got):
        assert {f"{k}:{a}:{b}" for a, _, b, k in brute.personal(text)} <= set(r.spans.split(","))


def _field():
    """Labels of like tokens agree; a token's own shape says little."""
    shapes = np.ones((personal.SHAPES, personal.LABELS))
    return personal.Field(shapes, np.ones((5, 5)), 100 * np.eye(5))


def test_personal_skip_links():
    text = "call +1 (813) 555-2273 now. " + "word " * 500 + "again 555-2273 or 4263615752389866"
    base = personal.rules(text)
    assert [k for *_, k in base] == [3]
    assert [text[a:b] for a, b, _ in _field().added(text, base)] == ["555-2273"]  # far away, equal, no rule; the other number stays
    assert _field().added("555-2273 and 555-2273", []) == []
    assert personal.redact(text, base).startswith("call <phone> now.")


def test_personal_messages_are_exact_on_trees():
    """Two like tokens and nothing else: sum-product equals enumeration."""
    field = _field()
    text = "+1 (813) 555-2273 x 555-2273"
    tokens = personal.Tokens(text, personal.rules(text))
    one = [i for i, label in enumerate(tokens.label) if label == personal.OTHER]
    chance = field.marginals(tokens)
    assert np.allclose(chance.sum(axis=1), 1) and chance[one[-1]].argmax() == 3


def test_personal_cases(spark):
    docs = [(1, None), (2, ""), (None, "a.b@c.de"), (3, "a.b@c.de"), (3, "a.b@c.de")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = personal.find(frame, personal.fit(frame), ["doc_id"]).collect()
    assert sorted(((r.doc_id, r.n_email, r.redacted) for r in got), key=key) == sorted([(1, 0, None), (2, 0, None), (None, 1, "<email>"), (3, 1, "<email>"), (3, 1, "<email>")], key=key)
    assert personal.find(frame.limit(0), personal.fit(frame.limit(0)), ["doc_id"]).collect() == []


def test_personal_field_needs_no_rule(spark):
    """Tokens of a shape that is nearly always an address are found in texts without any rule's span or like token."""
    docs = [(i, f"write to name{'abcdefghij'[i % 10]}@host.de soon") for i in range(400)]
    docs += [(1000, "write to info@müller.de soon"), (1001, "info@müller.de and info@müller.de"), (1002, "call 12345 now"), (1003, "12345 12345")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in personal.find(frame, personal.fit(frame), ["doc_id"]).collect() if r.doc_id >= 1000}
    assert got[1000].redacted == "write to <email> soon" and got[1001].redacted == "<email> and <email>"
    assert (got[1000].n_email, got[1000].base_spans, got[1000].spans) == (0, "", "email:9:23")
    assert got[1002].redacted is None and got[1003].redacted is None


def test_personal_bound_is_no_cut():
    """Where the field is not run, it would find nothing."""
    rng, kinds = np.random.default_rng(4), 0
    field = personal.Field(rng.integers(0, 2000, (personal.SHAPES, 5)) ** 2 * (rng.random((personal.SHAPES, 5)) < 0.4), rng.integers(1, 50, (5, 5)), rng.integers(1, 50, (5, 5)))
    words = ["a@b", "12345", "x1y2", "1.2.3.4", "555-2273", "q@ü.de", "word"]
    for _ in range(300):
        tokens = personal.Tokens(" ".join(rng.choice(words, rng.integers(1, 5))), [])
        if tokens.begin and not field.open(tokens):
            kinds += 1
            assert (field.marginals(tokens)[:, :-1] <= 0.5).all()
    assert kinds
