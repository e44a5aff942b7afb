"""Chat formatting by schema fingerprints.

The nested field paths of a record (or of a table's schema), as far as any known layout
names them, are hashed; the hash selects a declarative mapping from that layout to
canonical turns (role, text). A template then writes each turn between marks. Control
strings inside texts and roles are escaped, so the output can be read back exactly, and
the loss mask is the text between the marks of assistant turns.

A turn is formatted on its own; turns of a conversation follow one another by turn,
role and text. Reading back streams through the joined turns and holds about a megabyte or one turn at a
time, so a conversation may have any number of turns.

Edge cases: null text and null role are empty strings, null and empty lists of messages have no turns; a role without marks of its own
is written out. Null turn numbers come last. Rows with a null conversation id form one
conversation. Repeated rows are turns of their own. A record that is not just one of the layouts loses nothing: it
is given back whole, without a layout (a table raises an error). So is a record with a text (a string of several words) in a field
that no layout names; names, numbers and ids in such fields are not turns. Context stands before the question, earlier pairs of a history are
turns, what an assistant reasons stands before what it says, calls of tools and functions behind. Of tables columns that no layout names are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- layouts


@dataclass(frozen=True)
class Layout:
    """fields: (role, path) of single texts in order, a path that may be missing with "?" behind it; then a list of
    messages at `path` with keys for role and text.

    A message's text may also be a list of parts with a text each, and what it reasons and calls of tools may stand beside it.
    history: a list of earlier (user, assistant) pairs.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    path: str = ""
    role: str = ""
    text: str = ""
    history: str = ""
    rows: tuple[str, ...] = ()  # conversation id, turn, role and text columns of a table with a row for each turn

    def variants(self) -> Iterator[frozenset[str]]:
        """Every set of paths that is this layout."""
        if self.rows:
            yield frozenset(self.rows)
            return
        must = frozenset(p for _, p in self.fields if p[-1] != "?")
        may = [p[:-1] for _, p in self.fields if p[-1] == "?"]
        lists: list[frozenset[str]] = [frozenset()]
        if self.path:
            m = f"{self.path}[]."
            part = frozenset({f"{m}{self.text}[].type", f"{m}{self.text}[].text"})
            texts = [frozenset({m + self.text}), part, part | {m + self.text}, frozenset()]
            beside = [frozenset(m + x for x in some) for k in range(len(BESIDE) + 1) for some in combinations(BESIDE, k)]
            lists = [frozenset({m + self.role}) | t | c for t in texts for c in beside if t or c]
            lists += [frozenset({self.path}), frozenset({f"{self.path}[]"})]  # null and the empty list
        before = [frozenset(), *(frozenset({self.history + x}) for x in ("[][]", "[]", ""))] if self.history else [frozenset()]
        for k in range(len(may) + 1):
            for some in combinations(may, k):
                for listed in lists:
                    for earlier in before:
                        yield must | frozenset(some) | listed | earlier


REASONS, CALLS = "reasoning_content", ("tool_calls", "function_call")
BESIDE = (REASONS, *CALLS)
_SYSTEM = (("system", "system?"), ("system", "system_prompt?"))
_ASKED = (*_SYSTEM, ("user", "context?"))
LAYOUTS = (
    Layout("turn rows", rows=("conv_id", "turn", "role", "text")),
    Layout("messages", _SYSTEM, path="messages", role="role", text="content"),
    Layout("conversations", _SYSTEM, path="conversations", role="from", text="value"),
    Layout("dialogue", _SYSTEM, path="dialogue", role="speaker", text="text"),
    Layout("nested messages", path="data.messages", role="role", text="content"),
    Layout("prompt and completion", (*_ASKED, ("user", "prompt"), ("assistant", "completion")), history="history"),
    Layout("prompt and response", (*_ASKED, ("user", "prompt"), ("assistant", "response")), history="history"),
    Layout("instruction", (*_SYSTEM, ("user", "instruction"), ("user", "input?"), ("user", "context?"), ("assistant", "output")), history="history"),
    Layout("instruction and response", (*_SYSTEM, ("user", "instruction"), ("user", "input?"), ("user", "context?"), ("assistant", "response")), history="history"),
    Layout("question and answer", (*_ASKED, ("user", "question"), ("assistant", "answer")), history="history"),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "prompter": "user"}


def fingerprint(paths) -> str:
    """Hash of a set of field paths, whatever their order."""
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


class Registry:
    def __init__(self, layouts=LAYOUTS):
        sets = [(v, x) for x in layouts for v in x.variants()]
        self.by_hash = {fingerprint(v): x for v, x in sets}
        self.rows = [v for v, x in sets if x.rows]
        self.known = frozenset().union(*(v for v, x in sets if not x.rows))

    def select(self, paths) -> Layout | None:
        """The layout whose paths are just those of `paths` that any layout names; fields that none names are not turns.

        A row for each turn is known by its columns, whatever others there are.
        """
        named = next((v for v in self.rows if v <= set(paths)), self.known & set(paths))
        return self.by_hash.get(fingerprint(named))


def record_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a parsed record; a list's elements share "[]". A null field is there, and calls of tools are one field."""
    if isinstance(value, dict):
        out: set[str] = set()
        for k, v in value.items():
            out |= {f"{prefix}.{k}"} if k in CALLS else record_paths(v, f"{prefix}.{k}" if prefix else str(k))
        return out
    if isinstance(value, list):
        return set().union(*(record_paths(v, prefix + "[]") for v in value)) if value else {prefix + "[]"}
    return {prefix}


def schema_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a table's schema."""
    if isinstance(kind, T.StructType):
        return set().union(*({f"{prefix}.{f.name}"} if f.name in CALLS else schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind.fields)) if kind.fields else set()
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, prefix + "[]")
    return {prefix}


def _at(record, path: str):
    for k in path.split("."):
        record = record.get(k) if isinstance(record, dict) else None
    return record


def _role(name) -> str:
    name = "" if name is None else str(name)
    return ROLES.get(name.lower(), name)


def _text(value) -> str:
    """A text, or the texts of a list of parts; what is neither, as JSON."""
    if isinstance(value, list):
        return "\n".join(x["text"] if isinstance(x, dict) and isinstance(x.get("text"), str) and x.get("type", "text") == "text" else _text(x) for x in value)
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def _message(message, layout: Layout) -> tuple[str, str]:
    if not isinstance(message, dict):
        return "", _text(message)
    parts = [_text(message.get(REASONS)), _text(message.get(layout.text))] + [json.dumps(message[c], ensure_ascii=False) for c in CALLS if message.get(c)]
    return _role(message.get(layout.role)), "\n".join(p for p in parts if p)


_TEXT = re.compile(r"\S\s+\S")


def _leaves(value, prefix: str = "") -> Iterator[tuple[str, object]]:
    """(path, value) of the fields of a record that hold no others."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from [(f"{prefix}.{k}", None)] if k in CALLS else _leaves(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v, prefix + "[]")
    else:
        yield prefix, value


def _left_over(record, layout: Layout, known: frozenset[str]) -> bool:
    """Is there a text in a field that the layout would drop?"""
    parts = f"{layout.path}[].{layout.text}[]" if layout.path else None  # parts of other kinds are written out whole
    return any(isinstance(v, str) and p not in known and not (parts and p.startswith(parts)) and _TEXT.search(v) for p, v in _leaves(record))


def record_turns(record, registry: Registry) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout, turns) of one parsed record."""
    layout = registry.select(record_paths(record)) if isinstance(record, dict) else None
    if layout is None or layout.rows or _left_over(record, layout, registry.known):
        return None, []
    earlier = (record.get(layout.history) if layout.history else None) or []
    if not isinstance(earlier, list) or not all(isinstance(e, list) and len(e) == 2 for e in earlier):
        return None, []
    turns: list[tuple[str, str]] = []
    for role, path in layout.fields:
        if path[-1] == "?" and path[:-1] not in record:
            continue
        if role != "system" and earlier:  # the history stands behind the system's words
            turns += [(r, _text(x)) for pair in earlier for r, x in zip(("user", "assistant"), pair, strict=True)]
            earlier = []
            turns.append((role, ""))
        value = _text(_at(record, path.rstrip("?")))
        if turns and turns[-1][0] == role:  # two fields of one turn
            turns[-1] = (role, "\n\n".join(x for x in (turns[-1][1], value) if x))
        else:
            turns.append((role, value))
    if layout.path:
        turns += [_message(m, layout) for m in _at(record, layout.path) or []]
    return layout.name, turns


def json_turns(df: DataFrame, id_col: str, json_col: str, layouts=LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text, layout) of records in a column of JSON strings.

    What is no record of a known layout is one row with its JSON as text and no turn, role or layout; null has no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(it):
        registry = Registry(layouts)
        for batch in it:
            ids, rows = batch.column(0), []
            for i, s in enumerate(batch.column(1).to_pylist()):
                if s is None:
                    continue
                try:
                    name, turns = record_turns(json.loads(s), registry)
                except (ValueError, RecursionError):
                    name, turns = None, []
                rows += [(i, k, r, t, name) for k, (r, t) in enumerate(turns)] if name else [(i, None, None, s, None)]
            col = lambda k, kind: pa.array([r[k] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([ids.take(col(0, pa.int64())), col(1, pa.int64()), col(2, pa.string()), col(3, pa.string()), col(4, pa.string())], ["conv_id", "turn", "role", "text", "layout"])

    return df.select(id_col, json_col).mapInArrow(run, f"conv_id {kind}, turn long, role string, text string, layout string")


def table_turns(df: DataFrame, id_col: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) of a table, by the fingerprint of its schema."""
    layout = Registry(layouts).select(schema_paths(df.schema))
    if layout is None:
        raise ValueError("no layout has the fields of this table")
    if layout.rows:
        conv, turn, role, text = (F.col(c) for c in layout.rows)
        return df.select(conv.alias("conv_id"), turn.cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    there, parts = schema_paths(df.schema), []
    for role, path in layout.fields:
        if path.rstrip("?") in there:
            field = F.coalesce(F.col(path.rstrip("?")), F.lit(""))
            if parts and parts[-1][0] == role:
                parts[-1][1].append(F.when(field != "", field))
            else:
                parts.append((role, [field]))
    turn = lambda role, text: F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))
    each = [turn(F.lit(r), F.concat_ws("\n\n", *p)) for r, p in parts]
    turns = [F.array(*each)] if each else []
    if layout.history and f"{layout.history}[][]" in there:
        pairs = F.transform(F.coalesce(F.col(layout.history), F.array()), lambda e: F.array(turn(F.lit("user"), F.coalesce(e[0], F.lit(""))), turn(F.lit("assistant"), F.coalesce(e[1], F.lit("")))))
        first = parts[0][0] == "system"
        turns = [F.array(*x) for x in (each[:first],) if x] + [F.flatten(pairs)] + [F.array(*each[first:])]
    if layout.path:
        item = f"{layout.path}[]."
        parted = f"{item}{layout.text}[].text" in there

        def message(m):
            text = []
            if parted:
                text.append(F.array_join(F.transform(m[layout.text], lambda x: F.when(F.coalesce(x["type"], F.lit("text")) == "text", F.coalesce(x["text"], F.lit(""))).otherwise(F.to_json(x))), "\n"))
            elif item + layout.text in there:
                text.append(m[layout.text])
            if item + REASONS in there:
                text.insert(0, m[REASONS])
            for c in CALLS:
                if item + c in there:
                    text.append(F.when(F.size(m[c]) > 0, F.to_json(m[c])) if c == "tool_calls" else F.to_json(m[c]))
            text = [F.when(x != "", x) for x in text]
            role = m[layout.role]
            return turn(F.coalesce(known[F.lower(role)], role, F.lit("")), F.concat_ws("\n", *text))

        turns.append(F.transform(F.coalesce(F.col(layout.path), F.array()), message))
    e = df.select(F.col(id_col).alias("conv_id"), F.posexplode(F.concat(*turns)).alias("turn", "m"))
    return e.select("conv_id", F.col("turn").cast("long"), "m.role", "m.text")


# ---------------------------------------------------------------- template

MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": ("<s>[OUT] ", " [/OUT]</s>"), "system": ("<s><<SYS>> ", " <</SYS>>")}
OTHER = ("<s>[ROLE] ", " [/ROLE]", "</s>")
_CONTROL = re.compile(r"</?s>|\[/?(?:INST|OUT|ROLE)\]|<</?SYS>>")
_TURN = re.compile(r"<s>(?:\[INST\] (?P<user>.*?) \[/INST\]|\[OUT\] (?P<assistant>.*?) \[/OUT\]</s>|<<SYS>> (?P<system>.*?) <</SYS>>|\[ROLE\] (?P<role>.*?) \[/ROLE\](?P<other>.*?)</s>)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str | None, text: str | None) -> str:
    role, text = role or "", text or ""
    if role in MARKS:
        a, b = MARKS[role]
        return a + escape(text) + b
    return OTHER[0] + escape(role) + OTHER[1] + escape(text) + OTHER[2]


class Reader:
    """Reads a formatted string back that comes in pieces, cut anywhere: what is held is the turn that is not yet complete."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str, bool]]:
        """(role, text, is the text under the loss mask?) of the turns that are complete now."""
        held, at = self.rest + piece, 0
        while m := _TURN.match(held, at):
            kind, at = m.lastgroup, m.end()
            if kind == "other":
                yield unescape(m["role"]), unescape(m["other"]), False
            else:
                yield kind, unescape(m[kind]), kind == "assistant"
        self.rest = held[at:]

    def close(self) -> None:
        if self.rest:
            raise ValueError(f"this cannot be read back as turns: {self.rest[:80]!r}")


def read_turns(formatted: str) -> Iterator[tuple[str, str, bool]]:
    """(role, text, is the text under the loss mask?) of each turn in a formatted string."""
    reader = Reader()
    yield from reader.feed(formatted)
    reader.close()


def format_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with `formatted`; a conversation is its rows put together by turn, role, text."""

    @F.pandas_udf("string")
    def write(role, text):
        import pandas as pd

        clean = lambda v: v if isinstance(v, str) else ""
        return pd.Series([format_turn(clean(r), clean(t)) for r, t in zip(role, text, strict=True)], dtype=object)

    return turns.select("conv_id", "turn", "role", "text").withColumn("formatted", write("role", "text"))


def digests(formatted: DataFrame) -> DataFrame:
    """What reading back each formatted conversation gives: one row per conversation."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = formatted.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted")

    def run(it):
        now, state, done, reader = None, None, [], Reader()

        def read(pieces: list[str]):
            whole = "".join(pieces)  # turns that follow one another are read as one string
            for role, text, masked in reader.feed(whole):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                if masked:
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "replace"))
            state[4] += len(whole)

        def close():
            if state:
                reader.close()
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of(rows):
            kinds = [ids.type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in it:
            ids, held, size = batch.column(0), [], 0
            for conv, piece in zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or conv != now:
                    if held:
                        read(held)
                    close()
                    now, state, held, size = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], [], 0
                held.append(piece)
                size += len(piece)
                if size > 1 << 20:
                    read(held)
                    held, size = [], 0
            if held:
                read(held)
            if done:
                yield batch_of(done)
                done = []
        close()
        if done:
            yield batch_of(done)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversations(formatted: DataFrame) -> DataFrame:
    """conv_id and the whole formatted string, for conversations that fit one value."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("a"), "turn", "role", "text", "formatted")))
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["formatted"]), "").alias("formatted"))


def query(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(format_turns(table_turns(table).unionByName(extra)))
