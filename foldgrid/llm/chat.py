"""Chat formatting: records of any layout become canonical turns, and turns become one marked text with a loss mask.

The sorted nested field paths of a record, hashed, are its schema fingerprint; the fingerprint selects a declarative
mapping (LAYOUTS), which names where turns, roles and texts stand. Control strings inside texts are escaped
reversibly: a `<`, any backslashes and a `|` get one backslash more, so no text can hold a marker of the template.

A null text or a missing one is empty. Content given as a list of parts of type and text is the texts, joined. A record that
isn't JSON, that is nested too deep to read, that holds half of a surrogate pair, or whose fingerprint no layout has, gets null
turns and a null layout; unknown_layouts() counts these by fingerprint. Each record is converted alone: null or repeated ids, repeated records and extra columns change
nothing; an empty table gives an empty result. Extra fields change the fingerprint, so a layout lists those it allows.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.DOTALL)


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns. fields: (role, path) in order; or each: a path of a list, with role and text keys.

    parts: the text is a list of parts, or a plain text where that is optional, and each part has its text under this key.
    joined: after the text at a path, and an empty line, comes the text at another path, unless that is empty.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    parts: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    optional: tuple[str, ...] = ()
    joined: dict[str, str] = field(default_factory=dict, hash=False)

    def path_sets(self) -> list[frozenset[str]]:
        """The sets of paths under which this layout is known: with and without each optional path."""
        if self.each:
            text = {f"{self.each}[].{self.text}[].{k}" for k in (self.parts, "type")} if self.parts else {f"{self.each}[].{self.text}"}
            needed = {f"{self.each}[].{self.role}", *text}
        else:
            needed = {p for _, p in self.fields}
        sets = [needed - set(self.optional) | set(x) for n in range(len(self.optional) + 1) for x in combinations(self.optional, n)]
        return [frozenset(s) for s in sets]


LAYOUTS = (
    Layout("messages", each="messages", role="role", text="content", optional=("id", "messages[].name")),
    Layout("messages of parts", each="messages", role="role", text="content", parts="text", optional=("id", "messages[].name", "messages[].content")),
    Layout("nested messages", each="data.messages", role="role", text="content", optional=("id",)),
    Layout("shares", each="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}, optional=("id", "conversations[].weight")),
    Layout("prompt", fields=(("user", "prompt"), ("assistant", "response")), optional=("id",)),
    Layout("completion", fields=(("user", "prompt"), ("assistant", "completion")), optional=("id",)),
    Layout("instruction", fields=(("system", "system"), ("user", "instruction"), ("assistant", "output")), optional=("id", "system", "input"), joined={"instruction": "input"}),
    Layout("question", fields=(("user", "question"), ("assistant", "answer")), optional=("id", "context.source")),
)


def paths(value: object, at: str = "") -> set[str]:
    """Paths of the leaves of a record; list items share one path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(found: set[str] | frozenset[str]) -> str:
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    known = {fingerprint(s): x for x in layouts for s in x.path_sets()}
    known |= {fingerprint(frozenset(o) | {f"{x.each}[]"}): x for x in layouts if x.each for o in ((), ("id",))}  # no turn at all
    return known


def _at(record: object, path: str) -> object:
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _has(record: dict, path: str) -> bool:
    above, _, key = path.rpartition(".")
    owner = _at(record, above) if above else record
    return isinstance(owner, dict) and key in owner


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _joined(value: object, key: str) -> str:
    return "".join(_text(_at(p, key)) for p in value) if key and isinstance(value, list) else _text(value)


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    if layout.each:
        rows = _at(record, layout.each) or []
        return [(layout.roles.get(r := _text(_at(x, layout.role)), r), _joined(_at(x, layout.text), layout.parts)) for x in rows]
    out = []
    for role, p in layout.fields:
        if p not in layout.optional or _has(record, p):
            more = _text(_at(record, layout.joined[p])) if p in layout.joined else ""
            out.append((role, _text(_at(record, p)) + (f"\n\n{more}" if more else "")))
    return out


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The marked text, and the spans of the assistant's texts in it (code points)."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head = OPEN + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), mask


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a marked text: what render() was given."""
    role = lambda r: re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(r))
    return [(role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


_RENDERED = "struct<layout:string,formatted:string,mask:array<struct<start:int,stop:int>>>"
_MASK = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _read(record: str | None) -> tuple[dict | None, str | None]:
    """A record and its fingerprint; null where it isn't an object that can be read and written."""
    try:
        value = json.loads(record or "")
        found = fingerprint(paths(value)) if isinstance(value, dict) else None
        json.dumps(value, ensure_ascii=False).encode()  # half of a surrogate pair has no bytes
    except (ValueError, RecursionError):  # UnicodeEncodeError is a ValueError
        return None, None
    return (value, found) if found else (None, None)


def _converted(record: str | None, known: dict[str, Layout]) -> tuple:
    value, found = _read(record)
    layout = known.get(found) if found else None
    if layout is None:
        return None, None, None
    text, mask = render(turns_of(value, layout))
    return layout.name, text, [{"start": a, "stop": b} for a, b in mask]


def unknown_layouts(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """fingerprint, n: how many records no layout knows, by their fingerprint; null for those that can't be read as an object."""

    def unknown(col: pa.Array) -> pa.Array:
        known = registry(layouts)
        read = [_read(x.as_py())[1] for x in col]
        return pa.array(["" if f in known else f or "?" for f in read], pa.string())

    found = records.select(F.arrow_udf(unknown, "string").asNondeterministic()(F.col(record)).alias("f")).where("f != ''")
    return found.groupBy(F.when(F.col("f") != "?", F.col("f")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


def format_record(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """struct(layout, formatted, mask) of a JSON record."""

    def convert(col: pa.Array) -> pa.Array:
        known = registry(layouts)
        out = [_converted(x.as_py(), known) for x in col]
        columns = [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] if r[2] is not None else [] for r in out], _MASK)]
        return pa.StructArray.from_arrays(columns, ["layout", "formatted", "mask"])

    return F.arrow_udf(convert, _RENDERED).asNondeterministic()(record)


def digest(formatted: Column, mask: Column) -> Column:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the marked text and its mask."""
    kind = "struct<n_turns:long,turns_sha256:string,loss_chars:long,loss_sha256:string,formatted_chars:long>"

    def run(texts: pa.Array, masks: pa.Array) -> pa.Array:
        rows = []
        for x, m in zip(texts.to_pylist(), masks.to_pylist(), strict=True):
            turns = read(x or "")
            loss = "".join(unescape((x or "")[s["start"] : s["stop"]]) for s in m or [])
            sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            rows.append((len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(x or "")))
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return F.arrow_udf(run, kind).asNondeterministic()(formatted, mask)


def records(rows: DataFrame) -> DataFrame:
    """conv_id and a JSON record for each conversation of rows (conv_id, turn, role, text). The layout goes by the roles,
    and by the number of the conversation among those that suit them, so that all of LAYOUTS occur.

    A conversation is one record, however long; turns of equal number go by role, then text.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: F.regexp_replace(x["role"], ",", ";")), ",")
    text = lambda k: F.get(F.col("t"), F.lit(k))["text"]
    kind = lambda n, k: F.pmod(F.coalesce(F.expr("try_cast(conv_id AS bigint)"), F.lit(0)), F.lit(n)) == k
    json_of = lambda **columns: F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))

    def instruction(user: Column, answer: Column, **first: Column) -> Column:
        """What follows the first empty line of the user's text is the input."""
        at = F.locate("\n\n", user)
        split = json_of(**first, instruction=F.substring(user, F.lit(1), at - 1), input=F.substring(user, at + 2, F.length(user)), output=answer)
        return F.when((at > 0) & (F.length(user) > at + 1), split).otherwise(json_of(**first, instruction=user, output=answer))

    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    parts = F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content")))
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    shares = F.transform("t", lambda x: F.struct(name(x["role"]).alias("from"), x["text"].alias("value")))
    plain = ~F.exists("t", lambda x: x["role"].isin("human", "gpt"))  # names that shares give to other roles
    pair = roles == "user,assistant"
    return turns.select(
        "conv_id",
        F.when(pair & kind(4, 1), json_of(prompt=text(0), response=text(1)))
        .when(pair & kind(4, 2), json_of(prompt=text(0), completion=text(1)))
        .when(pair & kind(4, 3), json_of(question=text(0), answer=text(1)))
        .when(pair, instruction(text(0), text(1)))
        .when(roles == "system,user,assistant", instruction(text(1), text(2), system=text(0)))
        .when(kind(3, 1), json_of(data=F.struct(messages.alias("messages"))))
        .when(kind(3, 2) & plain, json_of(conversations=shares))
        .when(kind(6, 3), json_of(messages=parts))
        .otherwise(json_of(messages=messages))
        .alias("record"),
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, layout, formatted, mask for every conversation."""
    made = records(rows).select("conv_id", format_record(F.col("record")).alias("r"))
    return made.select("conv_id", "r.layout", "r.formatted", "r.mask")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 24) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
