"""Chat formatting: layouts told apart by a fingerprint of their field paths, mapped to canonical turns, put in one
template with reversible escapes. DataFrame functions only."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, SHUT, CLOSE = "<turn ", ">", "</turn>\n"
#: Escapes, in the order of escaping; undone in the opposite order. None of the results holds a control character.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"))
LEARNED = "assistant"
#: Role names of other layouts.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A record's field paths and where its turns are: ``fixed`` (role, fields joined by a blank line) or a ``list`` of
    entries with a role and a text field, or ``rows`` with one turn each."""

    name: str
    paths: tuple[str, ...]
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    entries: str = ""
    role: str = ""
    text: str = ""
    rows: tuple[str, ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Layout("prompt_response", ("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question_answer", ("question", "answer"), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction_output", ("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input_output", ("instruction", "input", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_instruction_output", ("system", "instruction", "output"), fixed=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("messages", ("messages[].role", "messages[].content"), entries="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), entries="conversations", role="from", text="value"),
)
BY_FINGERPRINT = {layout.fingerprint: layout for layout in LAYOUTS}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema, ``[]`` for the elements of a list."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def _plain(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.struct(F.coalesce(named[_plain(role)], _plain(role)).alias("role"), _plain(text).alias("text"))


def _fixed(layout: Layout, get) -> Column:
    texts = [(role, F.array_join(F.filter(F.array(*[_plain(get(f)) for f in fields]), lambda x: x != "") if len(fields) > 1 else F.array(_plain(get(fields[0]))), "\n\n"))
             for role, fields in layout.fixed]
    return F.array(*[_turn(F.lit(role), text) for role, text in texts])


def _listed(entries: Column, layout: Layout) -> Column:
    return F.transform(entries, lambda x: _turn(x[layout.role], x[layout.text]))


def _widest(paths: set[str]) -> Layout | None:
    """Of the layouts whose field paths are all there, the one with the most, then the first: other fields are extra ones."""
    inside = [layout for layout in LAYOUTS if paths.issuperset(layout.paths)]
    return max(inside, key=lambda layout: len(layout.paths), default=None)


def canonical_turns(records: DataFrame, id_column: str) -> DataFrame:
    """(id, layout, turns) of a table whose schema, without the id of nested records, is one of ``LAYOUTS``.

    The mapping is the one with the fingerprint of the schema's field paths; where there are extra columns or fields, that of
    the most paths among them. An unknown layout raises ValueError. Rows by turn are sorted by turn, then role and text, null turns first, repeated rows kept. Null roles and texts become
    empty, a null list of turns an empty one.
    """
    layout = BY_FINGERPRINT.get(fingerprint_of(field_paths(records.schema)))
    layout = layout or BY_FINGERPRINT.get(fingerprint_of(field_paths(records.drop(id_column).schema))) or _widest(set(field_paths(records.schema)))
    if layout is None:
        raise ValueError(f"no mapping for the field paths {field_paths(records.schema)}")
    if layout.rows:
        key, turn, role, text = layout.rows
        entry = F.struct(F.col(turn).alias("turn"), _turn(F.col(role), F.col(text)).alias("said"))
        grouped = records.groupBy(F.col(key).alias(id_column)).agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
        return grouped.select(id_column, F.lit(layout.name).alias("layout"), F.col("_entries.said").alias("turns"))
    if layout.fixed:
        turns = _fixed(layout, F.col)
    else:
        turns = _listed(F.coalesce(F.col(layout.entries), F.array()), layout)
    return records.select(id_column, F.lit(layout.name).alias("layout"), turns.alias("turns"))


def canonical_json(records: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """(id, layout, turns) of JSON records, each with a layout of its own.

    A record's variant schema, stripped of scalar types, is hashed and compared with the layouts' own. Malformed JSON,
    null and unknown layouts give a null layout and no turns; the row stays.
    """
    parsed = records.select(id_column, F.try_parse_json(json_column).alias("_v"))
    shape = F.regexp_replace(F.schema_of_variant("_v"), r": (STRING|VOID|BIGINT|DOUBLE|BOOLEAN|DECIMAL\(\d+,\d+\))", "")
    hashed = parsed.withColumn("_shape", F.md5(shape))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for known in LAYOUTS:
        if known.rows:
            continue
        top = sorted(known.paths)
        form = "OBJECT<" + ", ".join(top) + ">" if known.fixed else f"OBJECT<{known.entries}: ARRAY<OBJECT<{', '.join(sorted((known.role, known.text)))}>>>"
        match = F.col("_shape") == hashlib.md5(form.encode()).hexdigest()
        if known.fixed:
            found = _fixed(known, lambda field: F.try_variant_get("_v", f"$.{field}", "string"))
        else:
            listed = F.try_variant_get("_v", f"$.{known.entries}", f"array<struct<`{known.role}`:string,`{known.text}`:string>>")
            found = _listed(listed, known)
        layout, turns = F.when(match, F.lit(known.name)).otherwise(layout), F.when(match, found).otherwise(turns)
    return hashed.select(id_column, layout.alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def segments(turns: Column) -> Column:
    """array<struct<text, learned>>: the formatted text in order, the loss mask beside each piece."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SHUT)).alias("text"), F.lit(False).alias("learned")),
        F.struct(escape(t["text"]).alias("text"), (t["role"] == LEARNED).alias("learned")),
        F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("learned")))))


def format_chats(canonical: DataFrame) -> DataFrame:
    """The rows with ``segments`` and ``formatted`` (their texts joined) in place of turns; no turns give an empty text."""
    rest = [c for c in canonical.columns if c != "turns"]
    marked = canonical.select(*rest, segments(F.col("turns")).alias("segments"))
    return marked.withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_turns(formatted: Column) -> Column:
    """The turns back from a formatted text."""
    bodies = F.filter(F.split(formatted, re.escape(CLOSE)), lambda x: x != "")
    return F.transform(bodies, lambda x: F.struct(
        unescape(F.substr(F.split_part(x, F.lit(SHUT), F.lit(1)), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.split_part(x, F.lit(SHUT), F.lit(2))).alias("text")))


def learned_text(segments_column: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(segments_column, lambda s: s["learned"]), lambda s: s["text"]), ""))


def digests(formatted: DataFrame, id_column: str) -> DataFrame:
    """One row per conversation, read back from the formatted output."""
    read = formatted.select(id_column, "layout", "formatted", read_turns(F.col("formatted")).alias("turns"), learned_text(F.col("segments")).alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        id_column, F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"), "layout")
