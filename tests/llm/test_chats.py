"""Prefix trie and chat formatting: all rows of the small table and hand-made cases against plain versions."""

import hashlib
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tables import PATH, key

from groveflow.llm import chat, trie, turns

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def name(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def ordered(rows):
    """Turns (role, text) of each conversation in order."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, name(role, text), role or "", text or ""))
    return {c: [(r[3], r[4]) for r in sorted(x)] for c, x in found.items()}


def plain_trie(convs):
    """Nodes of conversations {id: [(role, text)]}, by listing every prefix."""
    members, ends = {}, {}
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
        ends.setdefault(tuple(said), []).append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    kids = {p: [q for q in below[p] if len(q) == len(p) + 1] for p in members}
    out = []
    for p, own in members.items():
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below[p] if q)
        out.append(
            (
                min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids[p]), sum(not kids[q] for q in below[p]), saved,
                sha(",".join(str(c) for c in sorted(ends.get(p, [])))),
            )
        )
    return sorted(out, key=key)


def rebuilt(convs):
    out = {}
    for c, said in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + said[h:]
    return out


def table():
    return duckdb.connect().execute(f"SELECT conv_id, turn, role, text FROM '{PATH}/conversations.parquet'").fetchall()


def test_trie_table(spark):
    got = sorted((tuple(r) for r in trie.op11(spark, PATH).collect()), key=key)
    assert got == plain_trie(rebuilt(ordered(table())))


def test_trie_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{PATH}/conversations.parquet'")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({trie._SQL})").fetchall()
    assert sorted((tuple(r) for r in trie.op11(spark, PATH).select(*names).collect()), key=key) == sorted(want, key=key)


def cases(seed=3):
    """Many copies, one common first turn, deep shared runs, long single conversations, ties, nulls."""
    rng = random.Random(seed)
    rows, said = [], lambda c, texts: rows.extend((c, i, "user" if i % 2 else None, t) for i, t in enumerate(texts))
    for c in range(0, 40):
        said(c, ["hello"] + [rng.choice("ab") for _ in range(rng.randrange(0, 6))])
    for c in range(40, 60):
        said(c, ["hello", "same", None, "end é"])
    for c in range(60, 70):
        said(c, ["deep"] * 30 + [str(c)])
    said(70, [str(i) for i in range(80)])
    rows += [(71, None, "user", "first"), (71, 1, "b", "x"), (71, 1, "a", "x"), (71, 1, "a", "x"), (None, 0, "user", "lost"), (-7, 0, "", ""), (72, 0, None, None)]
    return rows


@pytest.mark.parametrize("limit,block", [(1, 4), (2, 1 << 18), (7, 20), (1000, 8)])
def test_trie_cases(spark, limit, block):
    df = spark.createDataFrame(cases(), TURNS).repartition(5).withColumn("name", F.lit("x")).withColumn("path", F.lit(1)).withColumn("__n", F.lit(2))
    got = trie.prefix_trie(trie.conversations(df), limit, block).collect()
    convs = ordered(r for r in cases() if r[0] is not None)
    assert sorted((tuple(r) for r in got), key=key) == plain_trie(convs)


def test_trie_bursts_in_few_rounds(spark):
    """A run of 30 turns that ten conversations share is one head for each turn, found in four windows."""
    df = spark.createDataFrame([(c, i, "user", "deep" if i < 30 else str(c)) for c in range(10) for i in range(31)], TURNS)
    named = trie.conversations(df).mapInArrow(trie._named, "name binary, conv_id bigint, ids array<binary>, sizes array<int>")
    found = trie.burst(named.select("name", "ids"), 4).collect()
    assert sorted(r.depth for r in found) == [31] * 10


def test_trie_without_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(trie.conversations(none)).collect() == []
    empty = spark.createDataFrame([(1, [], []), (2, [], [])], "conv_id long, ids array<binary>, sizes array<int>")
    for limit in (1, 5):
        assert [tuple(r) for r in trie.prefix_trie(empty, limit).collect()] == [(1, 0, None, 2, 0, 1, 0, sha("1,2"))]


def test_turn_names(spark):
    rows = [("a", "b"), ("ab", ""), (None, "x"), ("", "x"), ("é", "ü" * 1000)]
    got = [bytes(r[0]) for r in spark.createDataFrame(rows, "role string, text string").select(turns.name()).collect()]
    assert got == [name(*r) for r in rows]
    assert len(set(got)) == 4


# chat format -------------------------------------------------------------------------------------


def plain_chat(rows, template=chat.TEMPLATE):
    """Expected digests, with the length of a formatted text worked out turn by turn."""
    out = []
    for conv, said in ordered(rows).items():
        size = 0
        for role, text in said:
            if role in template.roles:
                size += sum(map(len, template.roles[role])) + len(template.escape(text))
            else:
                size += sum(map(len, template.other)) + len(template.escape(role)) + len(template.escape(text))
        loss = "".join(t for r, t in said if r == "assistant")
        out.append((conv, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), size))
    return sorted(out, key=key)


def test_chat_table(spark):
    added = [(-1, 0, "user", chat.ADDED), (-1, 1, "assistant", chat.ADDED)]
    assert sorted((tuple(r) for r in chat.op13(spark, PATH).collect()), key=key) == plain_chat(table() + added)


def test_chat_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{PATH}/conversations.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({chat._SQL})").fetchall(), key=key) == sorted((tuple(r) for r in chat.op13(spark, PATH).collect()), key=key)


ODD = ["</s>", "[INST]", "[\\INST]", "[\\\\/INST]", "[", "<", "[INST", " [/INST]", "<<s>", "\\", "é[OUT]ü", "[OUT] ", "", "\n", "</s", "[[TEXT]]", "x" * 500]


def odd_rows():
    rng = random.Random(5)
    role = lambda: rng.choice(["user", "assistant", "system", "tool", "[/TEXT]", "", None, "assistant "])
    text = lambda: rng.choice([None, *ODD, "".join(rng.choice(ODD) for _ in range(6))])
    rows = [(0, i, role(), text()) for i in range(400)]  # one conversation holds most rows
    rows += [(c, i, role(), text()) for c in range(1, 30) for i in range(rng.randrange(1, 9))]
    rows += [(30, None, "user", "first"), (30, 0, "assistant", "b"), (30, 0, "assistant", "b"), (None, 1, "assistant", "nameless"), (None, 0, "user", "?")]
    return rows


def test_chat_cases(spark):
    df = spark.createDataFrame(odd_rows(), TURNS).withColumn("part", F.lit(9)).withColumn("open", F.lit(1)).repartition(4)
    parts = chat.format_chats(df).cache()
    assert sorted((tuple(r) for r in chat.read_back(parts).collect()), key=key) == plain_chat(odd_rows())
    assert parts.where("conv_id = 0").select("part").distinct().count() > 1  # the large one is dealt out
    assert chat.read_back(chat.format_chats(df.limit(0))).collect() == []


def test_chat_of_small_slices(spark, monkeypatch):
    """Slices of a few bytes: nearly every conversation is cut and put together again."""
    parts = list(chat._format(chat.TEMPLATE)(batches(sorted(odd_rows(), key=order))))
    monkeypatch.setattr(chat.kernel.slices, "__defaults__", (64,))
    small = list(chat._format(chat.TEMPLATE)(batches(sorted(odd_rows(), key=order))))
    assert sum(b.num_rows for b in small) > 3 * sum(b.num_rows for b in parts)
    for found in (parts, small):
        got = [r for b in chat._read(chat.TEMPLATE)(iter(found)) for r in b.to_pylist()]
        assert sorted((tuple(r.values()) for r in got), key=key) == plain_chat(odd_rows())
    rows = [r for b in small for r in b.to_pylist()]
    convs = [r["conv_id"] for r in rows]
    assert all(r["open"] for r in rows if convs.count(r["conv_id"]) > 1)


def order(row):
    conv, turn, role, text = row
    return conv is not None, conv or 0, turn is not None, turn or 0, name(role, text)


def batches(rows, size=50):
    import pyarrow as pa

    for i in range(0, len(rows), size):
        some = rows[i : i + size]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.string()), pa.array([r[3] for r in some], pa.string())], names=["conv_id", "role", "text"]
        )


def test_spans_are_the_assistant_texts():
    rows = [(1, 0, "user", "é"), (1, 1, "assistant", "ü [INST] "), (1, 2, "assistant", ""), (1, 3, "tool", "x"), (2, 0, "assistant", "</s>")]
    got = [r for b in chat._format(chat.TEMPLATE)(batches(rows)) for r in b.to_pylist()]
    assert got[0]["text"] == "[INST] é [/INST][OUT] ü [\\INST] </s>[OUT] </s>[ROLE] tool [TEXT] x [/TEXT]"
    assert [got[0]["text"][s["begin"] : s["end"]] for s in got[0]["loss"]] == ["ü [\\INST] ", ""]
    assert got[1]["text"] == "[OUT] <\\/s></s>"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[ROLE]"]), st.lists(st.sampled_from(ODD)).map("".join)), min_size=1, max_size=6))
def test_any_turns_come_back(said):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(said)]
    text = "".join(r["text"] for b in chat._format(chat.TEMPLATE)(batches(rows)) for r in b.to_pylist())
    assert list(chat.Reader().turns(text)) == said


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.Template(control=("[a[b]",))
    with pytest.raises(ValueError):
        list(chat.Reader().turns("no marker"))
    with pytest.raises(ValueError):
        list(chat.Reader().turns("[INST] open"))
