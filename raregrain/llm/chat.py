"""Chat formatting: records of any layout become canonical turns, then one template with a loss mask.

A record's nested field paths (array places left out, so that ``messages[].role`` is one path however many
messages there are) are hashed to a fingerprint. Registered mappings, plain data, name the paths they
cover: each says which path holds the list of turns and which fields are role and text, or which single
fields are one turn each. A fingerprint is bound to the first mapping whose required paths it has; only
distinct fingerprints are matched. Records that no mapping covers are returned as such, not dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Mapping:
    """``turns`` is the path of a list of objects with fields ``role``, ``text`` and maybe ``order``; or
    ``single`` lists ``(path, role)`` of fields that are one turn each, left out when null or missing. Paths may be
    nested: ``a.b`` is a field of a field, ``a[].b`` that field of every object in a list. Several values of a text
    are put together, those of ``turns`` and ``single`` are a turn each."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    single: tuple[tuple[str, str], ...] = ()
    required: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> set[str]:
        if self.turns:
            return {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}
        return set(self.required)


#: Tried in this order.
MAPPINGS = (
    Mapping("rows", turns="turns", role="role", text="text", order="turn"),
    Mapping("messages", turns="messages", role="role", text="content"),
    Mapping("message_parts", turns="messages", role="role", text="content[].text"),
    Mapping("nested_messages", turns="data.messages", role="role", text="content"),
    Mapping("message_tree", turns="mapping.messages", role="author.role", text="content.parts[]"),
    Mapping("from_value", turns="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("instruction", single=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), required=("instruction", "output")),
    Mapping("prompt_response", single=(("system", "system"), ("prompt", "user"), ("response", "assistant")), required=("prompt", "response")),
    Mapping("prompt_completion", single=(("prompt", "user"), ("completion", "assistant")), required=("prompt", "completion")),
    Mapping("question_answer", single=(("question", "user"), ("answer", "assistant")), required=("question", "answer")),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """Paths of all leaves; an empty or null container is a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def choose(paths: set[str], mappings: Sequence[Mapping] = MAPPINGS) -> Mapping | None:
    return next((m for m in mappings if m.paths() <= paths), None)


def values_at(value: object, path: str) -> list:
    """All values at a path; nothing where a part of it is missing or of another kind."""
    if not path:
        return [value]
    if path.startswith("[]"):
        return [v for x in value for v in values_at(x, path[2:].removeprefix("."))] if isinstance(value, list) else []
    if not isinstance(value, dict):
        return []
    if path in value:  # also a name that holds a dot itself
        return [value[path]]
    cuts = [i for i, c in enumerate(path) if i and (c == "." or path.startswith("[]", i)) and path[:i] in value]
    return next((found for i in cuts if (found := values_at(value[path[:i]], path[i:].removeprefix(".")))), [])


def canonical(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """``(role, text)`` in order; null becomes empty. Turns without an order field stay as listed; with one,
    they are sorted by it (null first), then role, then text."""
    def text(value: object) -> str:
        return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    def body(turn: dict) -> str:
        """The text; where one turn has another kind of content than its path says, that content as it is."""
        found = values_at(turn, mapping.text)
        if not found:
            held = [values_at(turn, mapping.text[:i]) for i in range(len(mapping.text) - 1, 0, -1) if mapping.text[i] in ".["]
            found = next((v for v in held if v), [])
        return "".join(map(text, found))

    if not mapping.turns:
        found = [(role, v) for path, role in mapping.single for v in values_at(record, path)]
        return [(role, text(v)) for role, v in found if v is not None]
    listed = [t for v in values_at(record, mapping.turns) for t in (v if isinstance(v, list) else [v])]
    turns = [t for t in listed if isinstance(t, dict)]
    first = lambda t, path: next(iter(values_at(t, path)), None) if path else None
    rows = [(text(first(t, mapping.role)), body(t), first(t, mapping.order)) for t in turns]
    if mapping.order:
        rows.sort(key=lambda r: (r[2] is not None, r[2] if r[2] is not None else 0, r[0], r[1]))
    return [(mapping.roles.get(role, role), body) for role, body, _ in rows]


def escape(text: str) -> str:
    """No ``<|`` is left: a run ``<``, backslashes, ``|`` gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def render(turns: Sequence[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """Formatted text, and the code-point spans of the texts that carry loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        stop = formatted.index(END, line)
        turns.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : stop])))
        at = stop + len(END) + 1
    return turns


def format_chats(records: DataFrame, key: str, record: str, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``<key>, fingerprint, mapping, formatted, loss`` for every row; ``record`` is a JSON text.

    ``loss`` lists the ``start, stop`` code points that carry loss. A null, unreadable or unmapped record
    has null ``mapping`` and ``formatted``; a record without turns formats to the empty text. Repeated rows
    are formatted each; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Mapping | None] = {}
        for batch in batches:
            rows = []
            for text in batch.column("record").to_pylist():
                try:
                    value = json.loads(text) if text is not None else None
                except ValueError:
                    value = None
                if not isinstance(value, dict):
                    rows.append((None, None, None, None))
                    continue
                paths = field_paths(value)
                mark = fingerprint(paths)
                if mark not in known:
                    known[mark] = choose(paths, mappings)
                if known[mark] is None:
                    rows.append((mark, None, None, None))
                    continue
                formatted, spans = render(canonical(value, known[mark]))
                rows.append((mark, known[mark].name, formatted, [{"start": a, "stop": b} for a, b in spans]))
            kinds = [pa.string(), pa.string(), pa.large_string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            columns[2] = columns[2].cast(pa.string())
            yield pa.record_batch([batch.column("key"), *columns], ["key", "fingerprint", "mapping", "formatted", "loss"])

    rows = records.select(F.col(key).cast("bigint").alias("key"), F.col(record).alias("record"))
    out = rows.mapInArrow(run, "key bigint, fingerprint string, mapping string, formatted string, loss array<struct<start:bigint,stop:bigint>>")
    return out.withColumnRenamed("key", key)


def turn_records(turns: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One JSON record ``{"turns": [{turn, role, text}]}`` per key of a table with a row per turn.

    A conversation is one text in the end, so its rows meet in one task; what is dealt out are
    conversations.
    """
    row = F.struct(F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"))
    listed = turns.groupBy(F.col(key).cast("bigint").alias(key)).agg(F.collect_list(row).alias("turns"))
    return listed.select(key, F.to_json(F.struct("turns"), {"ignoreNullFields": "false"}).alias("record"))


def digests(formatted: DataFrame, key: str) -> DataFrame:
    """What can be read back from formatted texts: turns, the text under the loss mask, and the length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns = read_back(text)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.record_batch([batch.column("key"), *columns], ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    read = formatted.where("formatted is not null").select(F.col(key).alias("key"), "formatted", "loss").mapInArrow(
        run, "key bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
    return read.withColumnRenamed("key", key)
