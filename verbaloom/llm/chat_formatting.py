"""Chat formatting: a record's layout is recognised by the hash of its nested field paths,
and a declarative mapping turns it into canonical turns, which a template then marks up.

``fingerprint`` hashes the sorted paths of a schema or of a JSON record (list elements are
``[]``).  ``MAPPINGS`` holds one mapping per known set of paths: either a list of turns with
the paths of role and text, or single fields that stand for turns, in order.  A record with
further fields uses the largest mapping whose paths it has; one that fits none is returned
with a null role and its fingerprint, so nothing gets lost silently.

The template writes a turn as ``<|turn|>role\\ntext</s>\\n``.  Control strings inside texts and
roles get a backslash after their first character, one more where there are some already,
which ``unescape`` takes away again; so a text that speaks of the template can't end a turn.

A conversation is never one row or one group in memory: turns are formatted row by row, and
``TurnReader`` finds turns and loss in the joined text, of which it holds one turn at a time.

Defined cases: null text and null role are empty.  Turns with equal numbers are ordered by
role and text, null turn numbers come first.  A null ``conv_id`` is a conversation of its own.
JSON records: a list of turns that holds anything but records, or a record that can't be parsed,
fits no layout; an empty list of turns gives no row.  A record that is one turn keeps its
``turn`` and, where it is a number, its ``conv_id``; a turn that is no whole number of 64 bits is null.
Roles and texts that are not strings are written as JSON, half surrogate pairs as ``?``.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructField, StructType

from verbaloom.llm.common import table

# Fixed values of the template.
TURN, END = "<|turn|>", "</s>"
LOSS_ROLES = ("assistant",)
#: Control strings of this and other common templates: an opening character, then one of these.
CONTROL = r"([<\[])({})(/?s>|/?INST\]|\|turn\|>|\|im_start\|>|\|im_end\|>)"

# Layouts: field paths -> how their turns are found.
LAYOUTS: list[tuple[set[str], dict[str, Any]]] = [
    ({"conv_id", "turn", "role", "text"}, {"rows": "turn", "role": "role", "text": "text"}),
    ({"messages[].role", "messages[].content"}, {"list": "messages", "role": "role", "text": "content"}),
    ({"conversations[].from", "conversations[].value"}, {"list": "conversations", "role": "from", "text": "value"}),
    ({"prompt", "response"}, {"fields": [("user", ["prompt"]), ("assistant", ["response"])]}),
    ({"prompt", "completion"}, {"fields": [("user", ["prompt"]), ("assistant", ["completion"])]}),
    ({"instruction", "output"}, {"fields": [("user", ["instruction"]), ("assistant", ["output"])]}),
    ({"instruction", "input", "output"}, {"fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]}),
    ({"system", "prompt", "response"}, {"fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]}),
    ({"question", "answer"}, {"fields": [("user", ["question"]), ("assistant", ["answer"])]}),
]
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(paths): mapping for paths, mapping in LAYOUTS}


def schema_paths(kind: DataType, prefix: str = "") -> set[str]:
    if isinstance(kind, StructType):
        return {p for f in kind for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)}
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return {prefix}


def record_paths(value: Any, prefix: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in record_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list):
        return {p for v in value for p in record_paths(v, f"{prefix}[]")}
    return {prefix}


def mapping_of(paths: set[str]) -> dict[str, Any] | None:
    """By fingerprint; else the mapping with the most paths that are all there."""
    exact = MAPPINGS.get(fingerprint(paths))
    if exact is not None:
        return exact
    fitting = [(len(need), mapping) for need, mapping in LAYOUTS if need <= paths]
    return max(fitting, key=lambda x: x[0])[1] if fitting else None


Turn = tuple[int | None, str, str]


def _long(value: Any) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63 else None


def _string(value: Any) -> str:
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value)
    return text.encode("utf-8", "replace").decode()


def record_turns(record: Any) -> list[Turn] | None:
    """Canonical (turn, role, text) of one record; ``None`` for an unknown layout."""
    if not isinstance(record, dict):
        return None
    empty = [m for _, m in LAYOUTS if "list" in m and record.get(m["list"]) == []]
    mapping = empty[0] if empty else mapping_of(record_paths(record))
    if mapping is None:
        return None
    if "list" in mapping:
        items = record.get(mapping["list"])
        if not isinstance(items, list) or not all(isinstance(t, dict) for t in items):
            return None
        turns = [(i, t.get(mapping["role"]), t.get(mapping["text"])) for i, t in enumerate(items)]
    elif "fields" in mapping:
        if not all(f in record for _, names in mapping["fields"] for f in names):
            return None
        parts = [(role, "\n\n".join(_string(record[f]) for f in names if record[f])) for role, names in mapping["fields"]]
        turns = [(i, *t) for i, t in enumerate(t for t in parts if t[1] or t[0] != "system")]
    else:
        if not all(mapping[k] in record for k in ("rows", "role", "text")):
            return None
        turns = [(_long(record[mapping["rows"]]), record[mapping["role"]], record[mapping["text"]])]
    return [(turn, ROLE_NAMES.get(name, name), _string(text)) for turn, name, text in ((t[0], _string(t[1]), t[2]) for t in turns)]


TURN_FIELDS = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()),
                          StructField("role", StringType()), StructField("text", StringType()),
                          StructField("layout", StringType())])


def turns_of_records(records: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """JSON records of mixed layouts as rows ``conv_id, turn, role, text, layout``."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(raw or "null")
                    paths, turns = record_paths(value), record_turns(value)
                except (ValueError, RecursionError):  # no JSON, or nested too deep
                    value, paths, turns = None, record_paths(None), None
                layout = fingerprint(p.encode("utf-8", "replace").decode() for p in paths)
                if turns is None:
                    rows.append((conv, None, None, raw, layout))
                    continue
                named = _long(value.get("conv_id"))
                rows += [(conv if named is None else named, turn, role, text, layout) for turn, role, text in turns]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5,
                 [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], names=TURN_FIELDS.names)
    return records.select(F.col(conv_id).cast("long"), F.col(record)).mapInArrow(convert, TURN_FIELDS)


def turns_of_table(df: DataFrame) -> DataFrame:
    """A table whose schema has a known layout as rows ``conv_id, turn, role, text``."""
    mapping = mapping_of(schema_paths(df.schema))
    if mapping is None:
        raise ValueError(f"no mapping for a table with the fields {sorted(schema_paths(df.schema))}")
    conv = F.col("conv_id").cast("long").alias("conv_id")
    if "rows" in mapping:
        return df.select(conv, F.col(mapping["rows"]).cast("long").alias("turn"),
                         F.coalesce(mapping["role"], F.lit("")).alias("role"), F.coalesce(mapping["text"], F.lit("")).alias("text"))
    if "list" in mapping:
        return df.select(conv, F.posexplode(mapping["list"]).alias("turn", "t")).select(
            "conv_id", F.col("turn").cast("long"), F.coalesce(F.col("t")[mapping["role"]], F.lit("")).alias("role"),
            F.coalesce(F.col("t")[mapping["text"]], F.lit("")).alias("text"))
    turns = F.array(*[
        F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *[F.when(F.col(n) != "", F.col(n)) for n in names]).alias("text"))
        for role, names in mapping["fields"]])
    return df.select(conv, F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL.format(r"\\*"), r"$1$2\\$3")


_ESCAPED = re.compile(CONTROL.format(r"\\+"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with ``piece``, its part of the formatted conversation, and the loss mask as the
    half-open range ``loss_from, loss_to`` of code points in the piece (empty outside the loss)."""
    role = escape_role(F.coalesce("role", F.lit("")))
    text = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(TURN), role, F.lit("\n"))
    start = F.length(head)
    end = F.when(F.col("role").isin(*LOSS_ROLES), start + F.length(text)).otherwise(start)
    return turns.withColumns({"piece": F.concat(head, text, F.lit(END + "\n")), "loss_from": start, "loss_to": end})


def read_piece(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    role, _, rest = piece.removeprefix(TURN).partition("\n")
    return unescape_role(role), unescape(rest[: -len(END) - 1])


class TurnReader:
    """Reads turns out of a formatted conversation that comes in parts, wherever it is cut.

    A control string is never inside a text, so a turn ends at the next ``END``; its role decides
    whether its text is under the loss mask.  What is held is the turn that is not complete yet.
    """

    def __init__(self) -> None:
        self.parts: list[str] = []

    def read(self, part: str) -> Iterator[tuple[str, str, bool]]:
        """(role, text, under the loss mask) of the turns that ``part`` completes."""
        self.parts.append(part)
        stop = END + "\n"
        if stop[-1] not in part:
            return
        held = "".join(self.parts)
        at = 0
        while (end := held.find(stop, at)) >= 0:
            piece = held[at : end + len(stop)]
            if not piece.startswith(TURN):
                raise ValueError("a formatted turn does not begin with its mark")
            role, text = read_piece(piece)
            yield role, text, role in LOSS_ROLES
            at = end + len(stop)
        self.parts = [held[at:]] if at < len(held) else []

    def close(self) -> None:
        if self.parts:
            raise ValueError("a formatted conversation ends inside a turn")


def in_order(formatted: DataFrame) -> DataFrame:
    """Pieces so that each conversation is contiguous and in order in one partition."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


DIGESTS = StructType([StructField("conv_id", LongType()), StructField("n_turns", LongType()),
                      StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()),
                      StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])


class _Digest:
    """Running figures of one conversation."""

    def __init__(self, conv: int | None):
        self.conv, self.reader = conv, TurnReader()
        self.n = self.chars = self.size = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, part: str) -> None:
        self.size += len(part)
        for role, text, under_loss in self.reader.read(part):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if under_loss:
                self.chars += len(text)
                self.loss.update(text.encode())

    def row(self) -> tuple:
        self.reader.close()
        return self.conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Reads each conversation's formatted text back, one row per conversation.

    The text is the pieces one after the other; turns, borders and the loss are found in it.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        current: _Digest | None = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=DIGESTS.names)

        for batch in batches:
            rows = []
            for conv, piece in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
                if current is None or current.conv != conv:
                    if current is not None:
                        rows.append(current.row())
                    current = _Digest(conv)
                current.add(piece)
            yield batch_of(rows)
        yield batch_of([current.row()] if current is not None else [])
    return in_order(formatted).select("conv_id", "piece").mapInArrow(read, DIGESTS)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string")
    turns = turns_of_table(table(spark, sf_dir, "conversations")).unionByName(own)
    return conversation_digests(format_turns(turns))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|\|turn\|>|\|im_start\|>|\|im_end\|>)', '\1\2\\\3', 'g') AS esc FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + length(role) + 1 + length(esc) + 5)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
