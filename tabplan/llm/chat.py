"""Chat formatting: records of unlike layouts become canonical turns, chosen by a fingerprint of their schema."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, slices

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


# ---- schema fingerprints ----------------------------------------------------------------


_SPECIAL = re.compile(r"[.\[\]{}\\]")


def _step(key: str) -> str:
    """A field's name in a path: what paths are made of gets a backslash, and so does an empty name."""
    return _SPECIAL.sub(r"\\\g<0>", key) or "\\"


def nested_paths(value: Any, path: str = "") -> set[str]:
    """The paths of all fields, with [] for the elements of an array; values and their types don't matter. However deep a value is nested, the stack isn't."""
    found, left = set(), [(path, value)]
    while left:
        path, value = left.pop()
        if isinstance(value, dict) and value:
            left += [(f"{path}.{_step(k)}" if path else _step(k), v) for k, v in value.items()]
        elif isinstance(value, list) and value:
            left += [(path + "[]", v) for v in value]
        else:
            found.add(path + ("{}" if isinstance(value, dict) else "[]" if isinstance(value, list) else ""))
    return found


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


class Mapping(NamedTuple):
    """How records of one layout become turns; a declaration, not code.

    parts: (role, names of fields whose texts are joined by an empty line) in order; or
    messages: (the array's name, the role's field, the text's field). Fields of `ignored`
    names, on the top level, tell nothing of the layout, whatever they hold. `roles` renames
    roles; those that it doesn't name stay.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    messages: tuple[str, str, str] | None = None
    ignored: tuple[str, ...] = ("id", "source", "metadata")
    roles: tuple[tuple[str, str], ...] = ()

    def layouts(self) -> Iterator[set[str]]:
        """All sets of paths that the mapping serves."""
        for bits in range(1 << len(self.optional)):
            yield {*self.required, *(p for i, p in enumerate(self.optional) if bits >> i & 1)}


#: Names that layouts with speakers of their own give to the two sides.
SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("prompter", "user"), ("model", "assistant"))
MAPPINGS = (
    Mapping("prompt", ("prompt", "completion"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question", ("question", "answer"), ("context",), (("user", ("context", "question")), ("assistant", ("answer",)))),
    Mapping("messages", ("messages[].role", "messages[].content"), (), messages=("messages", "role", "content")),
    Mapping("no_messages", ("messages[]",), (), messages=("messages", "role", "content")),
    Mapping("shared", ("conversations[].from", "conversations[].value"), (), messages=("conversations", "from", "value"), roles=SPEAKERS),
    Mapping("turns", ("turns[].role", "turns[].text"), (), messages=("turns", "role", "text")),
)


class Registry:
    """Mappings by the fingerprints of the layouts that they serve."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.known: dict[str, Mapping] = {}
        for m in mappings:
            for paths in m.layouts():
                if (same := self.known.setdefault(fingerprint(paths), m)) is not m:
                    raise ValueError(f"mappings {same.name} and {m.name} serve the same layout")
        self.ignored = {n for m in mappings for n in m.ignored}

    def select(self, record: dict) -> tuple[str, Mapping | None]:
        """(the record's fingerprint, the mapping for it): that of all its fields, or without those that a mapping ignores."""
        whole = fingerprint(nested_paths(record))
        if (found := self.known.get(whole)) is None and not self.ignored.isdisjoint(record):
            bare = self.known.get(fingerprint(nested_paths({k: v for k, v in record.items() if k not in self.ignored})))
            if bare is not None and all(k in bare.ignored for k in record if k in self.ignored):
                found = bare
        return whole, found


def as_text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def to_turns(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """The turns of a parsed record; ValueError where its values are no turns, as a message that is a mere text.

    Null texts count as empty; parts without any text make no turn but for those required.
    """
    if mapping.messages:
        array, role, text = mapping.messages
        if not isinstance(record[array], list) or not all(isinstance(m, dict) for m in record[array]):
            raise ValueError(f"{array} holds what is no message")
        roles = dict(mapping.roles)
        return [(roles.get(r := as_text(m.get(role)), r), as_text(m.get(text))) for m in record[array]]
    turns = []
    for role, names in mapping.parts:
        texts = [as_text(record[n]) for n in names if n in record]
        if any(texts) or any(n in mapping.required for n in names):
            turns.append((role, "\n\n".join(t for t in texts if t)))
    return turns


def parse_record(text: str | None) -> dict:
    """The JSON object of a record; ValueError says why it is none. Halves of surrogate pairs, which UTF-8 can't hold, make it none."""
    if text is None:
        raise ValueError("null")
    try:
        record = json.loads(text)
        if "\\u" in text:
            json.dumps(record, ensure_ascii=False).encode()
    except RecursionError:
        raise ValueError("nested too deeply") from None
    except UnicodeEncodeError:
        raise ValueError("half of a surrogate pair") from None
    if not isinstance(record, dict):
        raise ValueError("no object")
    return record


# ---- the template -------------------------------------------------------------------------

_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    """Put a backslash into each "<|", one more into "<\\|" and so on: no control string is left, and unescape() takes them out."""
    return _OPEN.sub(r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    """As escape(), in one line."""
    return escape(role.replace("&", "&amp;").replace("\n", "&nl;"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("&nl;", "\n").replace("&amp;", "&")


def render(turns: list[tuple[str, str]], learned: str = LEARNED) -> tuple[str, list[int]]:
    """The formatted conversation, and where its loss mask begins and ends, in code points: around the texts of the learned role."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == learned:
            mask += [at + len(head), at + len(head) + len(body)]
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        line, end = formatted.find("\n", at), formatted.find(END, at)
        if not formatted.startswith(START, at) or line < 0 or end < line or formatted[end + len(END) : end + len(END) + 1] != "\n":
            raise ValueError(f"no turn at {at}")
        turns.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


# ---- DataFrames -----------------------------------------------------------------------------


def to_records(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, record): a JSON record of the messages layout for each conversation of a table with a row for each turn.

    Turns stand by turn, then role, then text; nulls first. Null roles and texts are
    empty; repeated rows are turns of their own. Rows without a conversation make one
    together, whose id is null. A conversation is one record however long, so its rows meet in one place.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gathered = rows.groupBy(F.col(conv_col).cast("long").alias("id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return gathered.select("id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def format_records(records: DataFrame, id_col: str = "id", record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, layout, fingerprint, formatted, mask, error) of each record, a text of JSON.

    The hash of a record's nested field paths selects the mapping that makes its turns; where
    none serves it, fields that a mapping ignores are left out of it. mask holds begin and
    end, in code points, of each text that is to be learned.

    Records that can't be formatted keep their row, with the reason in `error` and null
    layout and formatted: null ones, broken JSON, JSON that is no object, is nested too
    deeply to be read or holds half of a surrogate pair, layouts that no mapping serves (a
    new one asks for a mapping, not for code; unknown_layouts() counts them), and messages
    that are no objects. Repeated rows stay apart; other columns play no part; an empty table
    gives an empty one.
    """
    known = Registry(mappings)
    schema = pa.schema([("id", pa.int64()), ("layout", pa.string()), ("fingerprint", pa.string()), ("formatted", pa.string()), ("mask", pa.list_(pa.int64())), ("error", pa.string())])

    def row(name: int | None, text: str | None) -> tuple:
        mark = None
        try:
            mark, mapping = known.select(record := parse_record(text))
            if mapping is None:
                raise ValueError("unknown layout")
            return name, mapping.name, mark, *render(to_turns(record, mapping)), None
        except ValueError as e:
            return name, None, mark, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for part in slices(batches):
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if out.add(row(name, text), 2 * len(text or "") + 64):
                    yield from out.flush()
        yield from out.flush()

    return records.select(F.col(id_col).cast("long").alias("id"), F.col(record_col).cast("string").alias("record")).mapInArrow(run, "id long, layout string, fingerprint string, formatted string, mask array<long>, error string")


def unknown_layouts(formatted: DataFrame) -> DataFrame:
    """(fingerprint, n): how many records of each layout no mapping served."""
    return formatted.where("fingerprint is not null and layout is null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


def read_formatted(formatted: DataFrame) -> DataFrame:
    """(id, roles, texts, learned, formatted_chars) of rows (id, formatted, mask): the turns read back, and the unescaped texts under the mask.

    Records that were not formatted, whose `formatted` is null, have no turns.
    """
    schema = pa.schema([("id", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("learned", pa.list_(pa.string())), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for part in slices(batches):
            for name, text, mask in zip(*(c.to_pylist() for c in part.columns), strict=True):
                text, mask = text or "", mask or []
                turns = read_back(text)
                learned = [unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2], strict=True)]
                if out.add((name, [r for r, _ in turns], [t for _, t in turns], learned, len(text)), 2 * len(text) + 64):
                    yield from out.flush()
        yield from out.flush()

    return formatted.select("id", "formatted", "mask").mapInArrow(run, "id long, roles array<string>, texts array<string>, learned array<string>, formatted_chars long")
