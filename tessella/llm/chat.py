"""Chat formatting: records of many layouts become canonical turns, then one template text per conversation.

Which mapping fits a record is decided by its schema fingerprint: the nested paths of its fields (list elements as [],
marks inside names escaped), sorted and hashed. A registry of declarative mappings, kept by fingerprint, says which path is
a role and which a text; a record whose fingerprint is unknown is matched once against the required and optional paths of
each mapping, and the answer is kept for the next record of that shape. A text may be a list of parts; their texts are
joined by line feeds, and a part that is no text stands there as JSON.

A turn is written as <|turn|>role, a newline, the text, <|end|>. Inside roles and texts every control string is
replaced by an escape (a backslash, c, its number, a semicolon; a backslash doubles; in roles a newline is \\n), so the
output splits at its marks without doubt and read_turns() gives back the exact texts. The loss mask covers the texts of
assistant turns.

Nulls: a null text or role is the empty string. What gives no turn is returned with layout null and the problem by name:
a null record, one that is no JSON, no object, nested too deep or without a fitting mapping, and an element of a list of
turns that is no object (with its JSON as text). Half of a surrogate pair, which UTF-8 can't write, becomes U+FFFD. Order:
(conversation, order column with nulls first), then the record's own list; records that tie keep together, in an order
that their content fixes, and repeated rows are repeated turns. Conversations of any length are read turn by turn. An
empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|turn|>", "<|end|>"
#: Control strings of this and of widespread templates (fixed values).
CONTROL = (START, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ROLES = {"human": "user", "user": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "assistant": "assistant", "system": "system"}

_ESCAPED = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_BACK = re.compile(r"\\(?:c(\d+);|(.))", re.DOTALL)
_NUMBER = {c: k for k, c in enumerate(CONTROL)}


@dataclass(frozen=True)
class Mapping:
    """turns: a list path and the role and text paths in its elements, or None; fixed: (role, paths joined by a blank line)."""

    name: str
    turns: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = field(default=())

    def required(self) -> set[str]:
        if self.turns:
            return {f"{self.turns[0]}[].{self.turns[1]}", f"{self.turns[0]}[].{self.turns[2]}"}
        return {p for _, paths in self.fixed for p in paths} - set(self.optional)

    def fits(self, have: set[str]) -> bool:
        """Whether all required paths are there, as a value or as a list of parts."""
        return all(p in have or any(h.startswith(f"{p}[]") for h in have) for p in self.required())


MAPPINGS = (
    Mapping("messages", ("messages", "role", "content"), (("system", ("system",)),), ("system",)),
    Mapping("sharegpt", ("conversations", "from", "value"), (("system", ("system",)),), ("system",)),
    Mapping("instruction", None, (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), ("system", "input")),
    Mapping("prompt_response", None, (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), ("system",)),
    Mapping("prompt_completion", None, (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question_answer", None, (("user", ("context", "question")), ("assistant", ("answer",))), ("context",)),
    Mapping("turn", None, (("*", ("role", "text")),)),
)


_MARKS = re.compile(r"[\\.\[\]\n]")


def paths_of(record: object) -> set[str]:
    """Paths of all leaves: a.b for fields, a[].b through lists; an empty list or object is a leaf. The marks of a path are
    escaped inside names, so no name looks like a path."""
    out, open_ = set(), [("", record)]
    while open_:
        at, value = open_.pop()
        if isinstance(value, dict) and value:
            for k, v in value.items():
                name = _MARKS.sub(lambda m: "\\" + m[0], k)
                open_.append((f"{at}.{name}" if at else name, v))
        elif isinstance(value, list) and value:
            open_ += [(f"{at}[]", v) for v in value]
        else:
            out.add(at)
    return out


def schema_fingerprint(record: object) -> str:
    return hashlib.sha256("\n".join(sorted(paths_of(record))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


_KNOWN: dict[str, Mapping | None] = {}


def mapping_for(record: object) -> tuple[str, Mapping | None]:
    """The fingerprint and the first mapping all of whose required paths are there."""
    mark = schema_fingerprint(record)
    if mark not in _KNOWN:
        have = paths_of(record)
        if len(_KNOWN) > 100_000:  # unknown shapes are derived anew; only the memory of them is bounded
            _KNOWN.clear()
        _KNOWN[mark] = next((m for m in MAPPINGS if m.fits(have)), None)
    return mark, _KNOWN[mark]


def _writable(text: str) -> str:
    """text without halves of surrogate pairs."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def _text(value: object) -> str:
    if isinstance(value, list) and value and all(isinstance(x, str | dict) for x in value):  # parts
        return "\n".join(_text(x["text"] if isinstance(x, dict) and isinstance(x.get("text"), str) else x) for x in value)
    return "" if value is None else _writable(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True))


def canonical(record: dict, m: Mapping) -> list[tuple[str | None, str]]:
    """Role and text of each turn; the role of an element that is no turn is null, its JSON the text."""
    if m.name == "turn":
        return [(_text(record["role"]), _text(record["text"]))]
    fixed = [(role, "\n\n".join(_text(record[p]) for p in paths if record.get(p) not in (None, ""))) for role, paths in m.fixed if any(p in record for p in paths)]
    if m.turns is None:
        return fixed
    many, role, text = m.turns
    turns = [(_text(t.get(role)), _text(t.get(text))) if isinstance(t, dict) else (None, _writable(json.dumps(t, ensure_ascii=False))) for t in record[many]]
    return fixed + [(r if r is None else ROLES.get(r.lower(), r), x) for r, x in turns]


def _read(raw: str | None) -> tuple[str | None, Mapping | None, list, str | None]:
    """Fingerprint, mapping, turns and problem of a record."""
    mark = None
    try:
        record = None if raw is None else json.loads(raw)
        if not isinstance(record, dict):
            return None, None, [], "null" if raw is None else "no object"
        mark, m = mapping_for(record)
        return (mark, None, [], "no mapping") if m is None else (mark, m, canonical(record, m), None)
    except RecursionError:
        return mark, None, [], "nested too deep"
    except ValueError:
        return None, None, [], "no JSON"


def escaped(text: str, *, role: bool = False) -> str:
    out = _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"\\c{_NUMBER[m[0]]};", text)
    return out.replace("\n", "\\n") if role else out


def unescaped(text: str) -> str:
    return _BACK.sub(lambda m: CONTROL[int(m[1])] if m[1] else "\n" if m[2] == "n" else m[2], text)


def formatted(role: str, text: str) -> tuple[str, tuple[int, int]]:
    """The written turn and the span of its text in it."""
    head, body = f"{START}{escaped(role, role=True)}\n", escaped(text)
    return f"{head}{body}{END}", (len(head), len(head) + len(body))


def read_turns(written: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    out = []
    for part in written.split(END)[:-1]:
        head, _, body = part.removeprefix(START).partition("\n")
        out.append((unescaped(head), unescaped(body)))
    return out


def canonical_turns(records: DataFrame, conv_col: str, order_col: str, record_col: str) -> DataFrame:
    """(conv_id, ord, tie, step, role, text, layout, schema_fp, problem) of a table of JSON records, one row for each turn
    and one for each record or element that gives none."""
    schema = "conv_id long, ord long, tie long, step int, role string, text string, layout string, schema_fp string, problem string"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 5]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, at, tie, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mark, m, turns, problem = _read(raw)
                if m is None:
                    rows.append((conv, at, tie, 0, None, None, None, mark, problem))
                odd = "no object in a list of turns"
                rows += [(conv, at, tie, k, r, x, *((None, mark, odd) if r is None else (m.name, mark, None))) for k, (r, x) in enumerate(turns)]
            cols = zip(*rows, strict=True) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    narrow = records.select(F.col(conv_col).cast("long"), F.col(order_col).cast("long"), F.xxhash64(F.col(record_col).cast("string")), F.col(record_col).cast("string"))
    return narrow.mapInArrow(convert, schema)


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, ord, tie, step, written, loss_start, loss_end): the turns' parts of the formatted text with the span of the
    loss mask in the part (null where nothing is learned). The parts of a conversation in order are its whole text."""
    schema = "conv_id long, ord long, tie long, step int, role string, text string, written string, loss_start int, loss_end int"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            done = [formatted(r or "", x or "") for r, x in zip(roles, texts, strict=True)]
            spans = [s if r == "assistant" else (None, None) for (_, s), r in zip(done, roles, strict=True)]
            more = [pa.array([w for w, _ in done], pa.string()), pa.array([a for a, _ in spans], pa.int32()), pa.array([b for _, b in spans], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "written", "loss_start", "loss_end"])

    known = turns.where("layout is not null").select("conv_id", "ord", "tie", "step", "role", "text")
    return known.mapInArrow(write, schema)


def conversation_digests(parts: DataFrame) -> DataFrame:
    """One row for each conversation, from its written parts alone. A task reads its conversations in order and keeps
    running hashes, so a conversation of any length needs no more memory than a batch."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    order = [F.col("conv_id").asc_nulls_first(), F.col("ord").asc_nulls_first(), "tie", "step"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def ended(states: list[list]) -> pa.RecordBatch:
            rows = [(c, n, t.hexdigest(), lc, lh.hexdigest(), fc) for c, n, t, lc, lh, fc in states]
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            done = []
            cols = (batch.column(k).to_pylist() for k in ("conv_id", "written", "loss_start", "loss_end"))
            for conv, written, start, end in zip(*cols, strict=True):
                if now is None or now[0] != conv:
                    done += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(written):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescaped(written[start:end])
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += len(written)
            if done:
                yield ended(done)
        if now:
            yield ended([now])

    sorted_ = parts.repartition("conv_id").sortWithinPartitions(*order)
    return sorted_.select("conv_id", "written", "loss_start", "loss_end").mapInArrow(read, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True)))


def turn_records(conversations: DataFrame) -> DataFrame:
    """A table with one row for each turn as JSON records of the turn layout."""
    record = F.to_json(F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")), {"ignoreNullFields": "false"})
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), record.alias("record"))


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose turns say control strings, as one record of the messages layout at turn 0. A conversation that
    has this id already is read together with it."""
    said = "</s>[INST] ok [/INST]"
    record = json.dumps({"messages": [{"role": r, "content": said} for r in ("user", "assistant")]})
    return spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit(record).alias("record"))
