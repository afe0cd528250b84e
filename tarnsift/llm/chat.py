"""Chat formatting with schema fingerprints.

A record's layout is recognised by a hash over its nested field paths; the hash selects a declarative
mapping to canonical turns (role, text).  Turns become one training text with a loss mask over the
assistant texts; control strings inside texts are escaped so that the turns can be read back exactly.

Defined cases: null text and null role are empty; rows of one turn number are ordered by role and
text; a null conversation id is a conversation of its own; a record that no mapping knows, or whose
JSON can't be read, yields zero turns and the fingerprint it has; extra fields don't change a
fingerprint; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, table

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: A batch of formatted conversations is handed on beyond so many characters.
BATCH_CHARS = 4_000_000


# --- layouts ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    each/role/text: a list of turns and the paths in one of its items.  fixed: (role, paths joined by
    a blank line).  group/order: for tables with a row a turn.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    group: str = ""
    order: str = ""
    roles: dict[str, str] = field(default_factory=dict)


ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("turn rows", ("conv_id", "turn", "role", "text"), group="conv_id", order="turn", role="role", text="text"),
    Mapping("messages", ("messages[].role", "messages[].content"), each="messages", role="role", text="content", roles=ROLES),
    Mapping("message parts", ("messages[].role", "messages[].content[].text"), each="messages", role="role", text="content[].text", roles=ROLES),
    Mapping("from and value", ("conversations[].from", "conversations[].value"), ("system",), each="conversations", role="from", text="value", fixed=(("system", ("system",)),), roles=ROLES),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt and completion", ("prompt", "completion"), ("system",), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", ("prompt", "response"), ("system",), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question and answer", ("question", "answer"), ("context",), fixed=(("user", ("context", "question")), ("assistant", ("answer",)))),
)
KNOWN = frozenset(p for m in MAPPINGS for p in (*m.paths, *m.optional))


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of the known paths among paths; fields that no mapping uses don't count."""
    return hashlib.sha256("\n".join(sorted(KNOWN.intersection(paths))).encode()).hexdigest()[:16]


def _registry() -> dict[str, Mapping]:
    out: dict[str, Mapping] = {}
    for m in MAPPINGS:
        for bits in range(1 << len(m.optional)):
            out[fingerprint([*m.paths, *(p for i, p in enumerate(m.optional) if bits >> i & 1)])] = m
    return out


REGISTRY = _registry()


def json_paths(value: object, at: str = "") -> Iterator[str]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from json_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from json_paths(v, f"{at}[]")
    elif value is not None:
        yield at


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def _texts(value: object, path: str) -> list[str]:
    head, _, rest = path.partition(".")
    many = head.endswith("[]")
    value = value.get(head.removesuffix("[]")) if isinstance(value, dict) else None
    items = value if many and isinstance(value, list) else [value]
    out = []
    for x in items:
        if rest:
            out += _texts(x, rest)
        elif x is not None:
            out.append(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False))
    return out


def record_turns(record: object) -> tuple[str, list[tuple[str, str]]]:
    """Fingerprint and canonical turns of one record."""
    mark = fingerprint(json_paths(record))
    m = REGISTRY.get(mark)
    if m is None or m.group:
        return mark, []
    turns = [(role, "\n\n".join(s)) for role, paths in m.fixed if (s := [x for p in paths for x in _texts(record, p)])]
    for item in (record.get(m.each) or []) if m.each else []:
        role = "".join(_texts(item, m.role))
        turns.append((m.roles.get(role, role), "\n".join(_texts(item, m.text))))
    return mark, turns


# --- template --------------------------------------------------------------------------------


def escape(text: str) -> str:
    """No "<|" is left: each "<", any backslashes, "|" gets one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: Iterable[tuple[str, str]]) -> tuple[str, list[dict[str, int]]]:
    """The training text, and the code point ranges of the assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == TRAINED_ROLE:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns again, from the training text alone."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        out.append((unescape_role(role), unescape(text[: -len(END) - 1])))
    return out


# --- operators -------------------------------------------------------------------------------

FORMATTED = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("n_turns", T.LongType()),
    T.StructField("formatted", T.StringType()),
    T.StructField("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("fingerprint", pa.string()), ("n_turns", pa.int64()), ("formatted", pa.string()),
    ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def _batches(conversations: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows, chars = [], 0
    for conv_id, mark, turns in conversations:
        text, spans = format_turns(turns)
        rows.append({"conv_id": conv_id, "fingerprint": mark, "n_turns": len(turns), "formatted": text, "loss_spans": spans})
        chars += len(text)
        if chars >= BATCH_CHARS or len(rows) >= 4096:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
            rows, chars = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def format_rows(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """A table with a row a turn, recognised by its schema's fingerprint, as formatted conversations.

    Rows are dealt by conversation and sorted there; a task holds one conversation at a time.
    """
    mark = fingerprint(schema_paths(df.schema))
    m = REGISTRY.get(mark)
    if m is None or not m.group:
        raise ValueError(f"no mapping with a row a turn for fingerprint {mark}")
    rows = df.select(
        F.col(m.group).cast("long").alias("g"), F.col(m.order).cast("long").alias("o"),
        F.coalesce(F.col(m.role), F.lit("")).alias("r"), F.coalesce(F.col(m.text), F.lit("")).alias("t"),
    )
    rows = rows.repartition(partitions or shuffle_partitions(df.sparkSession), "g").sortWithinPartitions("g", "o", "r", "t")

    def run(batches):
        def conversations():
            now, turns = None, []
            for b in batches:
                for g, r, t in zip(b.column("g").to_pylist(), b.column("r").to_pylist(), b.column("t").to_pylist()):
                    if turns and g != now:
                        yield now, mark, turns
                        turns = []
                    now = g
                    turns.append((m.roles.get(r, r), t))
            if turns:
                yield now, mark, turns

        return _batches(conversations())

    return rows.mapInArrow(run, FORMATTED)


def format_records(df: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """JSON records of any known layout, mixed, as formatted conversations."""

    def run(batches):
        def conversations():
            for b in batches:
                for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    try:
                        record = json.loads(s) if s is not None else None
                    except ValueError:
                        record = None
                    yield i, *record_turns(record)

        return _batches(conversations())

    return df.select(F.col(id_col).cast("long"), F.col(json_col).cast("string")).mapInArrow(run, FORMATTED)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts and loss masks say, from nothing else."""

    def run(batches):
        for b in batches:
            out = []
            for conv, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                out.append({
                    "conv_id": conv, "n_turns": len(turns),
                    "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                    "formatted_chars": len(text),
                })
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return formatted.mapInArrow(run, _DIGEST)


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op9_chat(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return read_back(format_rows(rows.unionByName(extra)))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(len(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'))
      + len(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, len(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
