"""Chat formatting by columnar byte assembly.

Conversations are dealt in ranges of (conversation, turn) and sorted, so a conversation that holds a third of all turns
spans many tasks. Each slice of a batch (about half a megabyte) is formatted at once: the lengths of all segments (header, text, footer of each turn) give the
offset of every segment, these give the place of every byte, and headers and texts are scattered into one buffer that
becomes the Arrow column. A row of the result is a part: consecutive turns of one conversation out of one slice; most
conversations are one part. A part carries its loss mask as spans of code points.

Texts may hold what looks like control strings. A backslash goes between the first character of such a string and its
rest, one more if there are some already, and is taken out on reading; other texts stay as they are. Control strings
start with "[" or "<" and hold none of these later, so escapes never overlap and no text can run into a marker.

Every turn has its own markers and names its role, so that parts can be read without what stands before them; the start
token of a whole sequence is left to the tokenizer.

Defined cases: null role or text is empty; null turns stand first, equal turn numbers by the turn's name (`turns`); rows
without conv_id are one conversation of that name; repeated rows are turns of their own; an empty table has no parts;
other columns are ignored. A part is one string and so below 2 GB, which a single turn must not exceed.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveflow.llm import kernel, turns
from groveflow.llm.registry import query, ready, table
from groveflow.session import materialise


@dataclass(frozen=True)
class Template:
    """Header and footer for each known role, and (header, between, footer) around the name of any other role.

    Headers must start with a control string, and a footer must be told from text by one; `control` lists all of them.
    """

    roles: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>")}
    )
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/TEXT]")
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE]", "[TEXT]", "[/TEXT]")
    loss: str = "assistant"

    def __post_init__(self):
        if any(c[0] not in "[<" or set(c[1:]) & set("[<\\") for c in self.control):
            raise ValueError("control strings start with [ or < and hold none of these later")

    @property
    def pattern(self) -> str:
        """A control string or its escaped form: first character, backslashes, rest."""
        return r"([\[<])(\\*)(" + "|".join(re.escape(x) for x in sorted({c[1:] for c in self.control})) + ")"

    def escape(self, text: str) -> str:
        return re.sub(self.pattern, r"\1\\\2\3", text)

    def unescape(self, text: str) -> str:
        return re.sub(self.pattern, lambda m: m[0] if not m[2] else m[1] + m[2][1:] + m[3], text)


TEMPLATE = Template()
PART = "conv_id bigint, part bigint, n_turns int, text string, loss array<struct<begin: int, end: int>>, open boolean"
_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])


def _insertions(data: np.ndarray, offsets: np.ndarray, pattern) -> np.ndarray:
    """Places before which a backslash goes: after the first character of control strings inside one text."""
    if not len(data) or not (np.isin(data, (0x5B, 0x3C))).any():
        return np.zeros(0, np.int64)
    found = [(m.start(), m.end()) for m in pattern.finditer(data.tobytes())]
    if not found:
        return np.zeros(0, np.int64)
    begin, end = np.array(found, np.int64).T
    own = np.searchsorted(offsets, begin, "right") - 1
    return begin[end <= offsets[own + 1]] + 1


def assemble(conv: list, roles: pa.Array, texts: pa.Array, template: Template = TEMPLATE):
    """Parts of sorted rows: (first row of each part, texts, loss spans, lengths of the span lists).

    Five segments a turn: header, role (of other roles only), what stands between, text, footer.
    """
    n = len(conv)
    kinds = np.array([list(template.roles).index(r) if r in template.roles else len(template.roles) for r in roles.to_pylist()], np.int64)
    fixed = [(h.encode(), b"", f.encode()) for h, f in template.roles.values()] + [tuple(x.encode() for x in template.other)]
    pool = b"".join(x for f in fixed for x in f)
    size = np.array([[len(x) for x in f] for f in fixed], np.int64)
    start = (np.cumsum(size.ravel()) - size.ravel()).reshape(size.shape)
    other = kinds == len(template.roles)
    named = pa.array([r if o else "" for r, o in zip(roles.to_pylist(), other)], pa.large_string())
    pattern = re.compile(template.pattern.encode())
    sources, lengths, places = [], np.zeros((n, 5), np.int64), []
    for column in (named, texts):
        data, offsets = kernel.bytes_of(column)
        cuts = _insertions(data, offsets, pattern)
        moved = np.arange(len(data)) + np.searchsorted(cuts, np.arange(len(data)), "right")  # place in the escaped bytes
        begin = offsets + np.searchsorted(cuts, offsets, "left")
        escaped = np.full(len(data) + len(cuts), 0x5C, np.uint8)
        escaped[moved] = data
        sources.append(escaped)
        places.append(begin[:-1])
        lengths[:, 1 if column is named else 3] = np.diff(begin)
    lengths[:, [0, 2, 4]] = size[kinds]
    ends = np.cumsum(lengths.ravel())
    at = (ends - lengths.ravel()).reshape(n, 5)
    total = int(ends[-1]) if n else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    pool = np.frombuffer(pool, np.uint8)
    for j, source, begin in ((0, pool, start[kinds, 0]), (1, sources[0], places[0]), (2, pool, start[kinds, 1]), (3, sources[1], places[1]), (4, pool, start[kinds, 2])):
        out[kernel.ragged(at[:, j], lengths[:, j])] = source[kernel.ragged(begin, lengths[:, j])]
    first = np.flatnonzero([i == 0 or conv[i] != conv[i - 1] for i in range(n)])
    offsets = np.append(at[first, 0], total)
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
    masked = np.flatnonzero(kinds == list(template.roles).index(template.loss)) if template.loss in template.roles else np.zeros(0, np.int64)
    part = np.searchsorted(first, masked, "right") - 1
    zero = points[offsets[part]]
    spans = pa.StructArray.from_arrays(
        [pa.array((points[x] - zero).astype(np.int32)) for x in (at[masked, 3], at[masked, 3] + lengths[masked, 3])], fields=list(_SPAN)
    )
    column = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64).tobytes()), buffer)
    return first, column, kernel.lists(np.bincount(part, minlength=len(first)), spans)


def _format(template: Template):
    """Parts of one task's sorted rows. A part is open if its conversation may have other parts: where it touches a
    border of the task, or the slice before or after holds the same conversation."""

    def run(batches):
        count, waiting = 0, None  # a slice waits for the next one, which tells whether its last part is open

        def settle(held, after):
            conv, first, parts = held
            ids = [conv[i] for i in first]
            open_ = np.zeros(len(ids), bool)
            open_[0] = begins_open
            open_[-1] |= after
            turns_ = np.diff(np.append(first, len(conv)))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(base + first), pa.array(turns_.astype(np.int32)), parts[0].cast(pa.string()), parts[1], pa.array(open_)],
                names=["conv_id", "part", "n_turns", "text", "loss", "open"],
            )

        base, begins_open = 0, True
        for batch in batches:
            every, roles, texts = batch.column("conv_id").to_pylist(), kernel.texts(batch.column("role")), kernel.texts(batch.column("text"))
            for a, b in kernel.slices(texts):
                conv = every[a:b]
                if waiting is not None:
                    same = waiting[0][-1] == conv[0]
                    yield settle(waiting, same)
                    base, begins_open = count, same
                first, column, spans = assemble(conv, roles.slice(a, b - a), texts.slice(a, b - a), template)
                count += len(conv)
                waiting = (conv, first, (column, spans))
        if waiting is not None:
            yield settle(waiting, True)

    return run


def format_chats(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Formatted parts of conversations (conv_id, turn, role, text): conv_id, part (ascending along the conversation),
    n_turns, text, loss [(begin, end)) in code points of the text, open (the conversation may have more parts)."""
    ready(rows.sparkSession)
    order = ["conv_id", "numbered", "turn", "name"]
    some = rows.select("conv_id", F.col("turn").isNotNull().alias("numbered"), "turn", turns.name().alias("name"), turns.plain("role").alias("role"), turns.plain("text").alias("text"))
    dealt = some.repartitionByRange(*order).sortWithinPartitions(*order)
    tasks = dealt.select("conv_id", "role", "text").mapInArrow(_format(template), PART)
    # tasks are numbered along the order, so parts ascend along a conversation
    number = F.spark_partition_id().cast("bigint") * F.lit(1 << 40) + F.col("part")
    return tasks.withColumn("part", number)


# reading back ------------------------------------------------------------------------------------


class Reader:
    """Turns and loss text of formatted parts."""

    def __init__(self, template: Template = TEMPLATE):
        self.template = template
        self.control = re.compile("|".join(re.escape(c) for c in sorted(template.control, key=len, reverse=True)))
        self.known = {h: (role, f) for role, (h, f) in template.roles.items()}
        self.opened = {self.control.match(h)[0]: h for h in self.known}

    def turns(self, text: str):
        """(role, text) of each turn of a part, unescaped."""
        at, unescape = 0, self.template.unescape
        header, between, footer = self.template.other

        def upto(mark: str, begin: int) -> int:
            """Where `mark` begins: at the next control string, less what stands before it in the mark."""
            sign = self.control.search(text, begin)
            end = sign.start() - self.control.search(mark).start() if sign else len(text)
            if text[end : end + len(mark)] != mark:
                raise ValueError(f"expected {mark!r} at {end}")
            return end

        while at < len(text):
            sign = self.control.match(text, at)
            if sign is None:
                raise ValueError(f"no turn begins at {at}")
            if sign[0] in self.opened:
                role, close = self.known[self.opened[sign[0]]]
                at += len(self.opened[sign[0]])
            else:
                at += len(header)
                end = upto(between, at)
                role, close = unescape(text[at:end]), footer
                at = end + len(between)
            end = upto(close, at)
            yield role, unescape(text[at:end])
            at = end + len(close)


class _Digests:
    """Running digests of one conversation's parts."""

    def __init__(self):
        self.turns, self.loss, self.n, self.chars, self.size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, reader: Reader, text: str, loss: list):
        for role, said in reader.turns(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n += 1
        for span in loss:
            said = reader.template.unescape(text[span["begin"] : span["end"]])
            self.loss.update(said.encode())
            self.chars += len(said)
        self.size += len(text)

    def row(self):
        return self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size


_READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_READ_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _read(template: Template):
    """Digests of conversations whose parts come one after the other; only the running digests are held."""

    def run(batches):
        reader, now, state, out = Reader(template), None, None, []
        names = [x.split()[0] for x in _READ.split(", ")]

        def batch_of():
            columns = list(zip(*out)) if out else [[]] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _READ_KINDS)], names=names)
            out.clear()
            return made

        for batch in batches:
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss"))):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, *state.row()))
                    now, state = conv, _Digests()
                state.add(reader, text, loss)
            yield batch_of()
        if state is not None:
            out.append((now, *state.row()))
        yield batch_of()

    return run


def read_back(parts: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What the formatted parts say, one row for each conversation. Whole conversations are read where they are; open
    parts are put in order first (two for each task that formatted, and those of very long conversations)."""
    whole = parts.where("NOT open").mapInArrow(_read(template), _READ)
    rest = parts.where("open").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_read(template), _READ)
    return whole.unionByName(rest)


ADDED = "</s>[INST] ok [/INST]"  # both turns of conversation -1 say this: it must come back whole

_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ADDED}' UNION ALL SELECT -1, 1, 'assistant', '{ADDED}'),
e AS (
  SELECT *, sha256(length(role) || ':' || role || text) AS name,
    length(regexp_replace(text, '{TEMPLATE.pattern}', '\1\\\2\3', 'g')) AS text_size, length(regexp_replace(role, '{TEMPLATE.pattern}', '\1\\\2\3', 'g')) AS role_size
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, name)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, name) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_size + CASE role {" ".join(f"WHEN '{r}' THEN {len(h) + len(f)}" for r, (h, f) in TEMPLATE.roles.items())} ELSE role_size + {sum(map(len, TEMPLATE.other))} END)::BIGINT
    AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op13_chat_format", _SQL)
def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", ADDED), (-1, 1, "assistant", ADDED)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(materialise(format_chats(rows.unionByName(added)), "chats"))
