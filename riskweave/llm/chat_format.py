"""Chat formatting by schema fingerprint.

A record is JSON of any layout. Its fingerprint is a hash of its nested field paths (list items share
one path); it selects a declarative mapping that says where the turns, roles and texts are. Turns are
written in one template whose control strings, where they occur inside a text, are broken by a
backslash and backslashes are doubled, so that a text can be read back exactly. Assistant texts are
under the loss mask, given as spans of code points.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where each layout keeps its turns. "paths" must occur; any of "optional" may. A mapping has either "each" (a list of turns) or "turns" (fields in order; joined fields make one turn). "roles" are the layout's own names of roles.
MAPPINGS: list[dict] = [
    {"name": "messages", "paths": ["messages", "messages[].content", "messages[].role"], "optional": [], "each": "messages", "role": "role", "text": "content"},
    {"name": "conversations", "paths": ["conversations", "conversations[].from", "conversations[].value"], "optional": ["system"], "each": "conversations", "role": "from", "text": "value", "first": ["system"], "roles": {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}},
    {"name": "prompt", "paths": ["prompt", "response"], "optional": ["system"], "turns": [["system", ["system"]], ["user", ["prompt"]], ["assistant", ["response"]]]},
    {"name": "completion", "paths": ["prompt", "completion"], "optional": [], "turns": [["user", ["prompt"]], ["assistant", ["completion"]]]},
    {"name": "instruction", "paths": ["instruction", "output"], "optional": ["input", "system"], "turns": [["system", ["system"]], ["user", ["instruction", "input"]], ["assistant", ["output"]]]},
    {"name": "question", "paths": ["question", "answer"], "optional": ["context"], "turns": [["user", ["context", "question"]], ["assistant", ["answer"]]]},
    {"name": "empty messages", "paths": ["messages"], "optional": [], "each": "messages", "role": "role", "text": "content"},
]
MAX_DEPTH = 40  #: paths of a record are followed so far; what lies deeper has its place at that depth
#: Strings with a meaning in common chat templates; none may occur inside a formatted text.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
FORMATTED = "conv_id long, layout string, fingerprint string, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>"


def field_paths(value, at: str = "", depth: int = MAX_DEPTH) -> set[str]:
    if depth and isinstance(value, dict):
        return set().union(*({p} | field_paths(v, p, depth - 1) for k, v in value.items() for p in [f"{at}.{k}" if at else k]))
    if depth and isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]", depth - 1) for v in value))
    return set()


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(mappings: list[dict]) -> dict[str, dict]:
    """Each mapping under the fingerprints of its paths with any of its optional ones."""
    return {fingerprint([*m["paths"], *extra]): m for m in reversed(mappings) for n in range(len(m["optional"]) + 1) for extra in itertools.combinations(m["optional"], n)}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: dict, mapping: dict) -> list[tuple[str, str]] | None:
    """The turns of a record; None if its list of turns is no list of objects (the paths alone do not tell)."""
    if "each" in mapping:
        items = record[mapping["each"]] or []
        if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
            return None
        turns = [("system", _text(record[k])) for k in mapping.get("first", []) if k in record]
        own = mapping.get("roles", {})
        for item in items:
            role = _text(item.get(mapping["role"]))
            turns.append((own.get(role, role), _text(item.get(mapping["text"]))))
        return turns
    return [(role, "\n".join(_text(record[k]) for k in keys if k in record)) for role, keys in mapping["turns"] if any(k in record for k in keys)]


def template(turns: list[tuple[str, str]]) -> tuple[str, list[dict[str, int]]]:
    """The formatted conversation and the spans of its assistant texts."""
    out, spans, n = [], [], 0
    for role, text in turns:
        body, head = escape(text), f"<|im_start|>{quote(role, safe='')}\n"
        if role == "assistant":
            spans.append({"start": n + len(head), "end": n + len(head) + len(body)})
        out += [head, body, "<|im_end|>\n"]
        n += len(head) + len(body) + len(out[-1])
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unquote(role), unescape(body)) for role, body in _TURN.findall(formatted)]


def format_chats(records: DataFrame, conv_id: str = "conv_id", record: str = "record", mappings: list[dict] | None = None) -> DataFrame:
    """One row per record (a JSON string): conv_id, layout, fingerprint, n_turns, formatted, loss_spans.

    A record that is null, not a JSON object (or nested too deep to be read, or with half a surrogate pair) or of an unknown layout keeps
    its row with a null layout and a null `formatted`; its fingerprint (of the object) says what mapping to
    add. So does one whose list of turns holds anything but objects. Null texts count as empty, roles are
    kept as they are but for a mapping's own names, values that are not strings are written as JSON.
    Repeated rows stay repeated, an empty table gives no rows, other columns are ignored.
    """
    by_print = registry(mappings or MAPPINGS)
    names = [x.split()[0] for x in FORMATTED.split(", ")]

    def one(conv, raw) -> tuple:
        try:
            value = json.loads(raw) if raw is not None else None
            if raw and "\\u" in raw:
                json.dumps(value, ensure_ascii=False).encode()  # half a surrogate pair is no text
        except (ValueError, RecursionError):
            value = None
        if not isinstance(value, dict):
            return conv, None, None, None, None, None
        mark = fingerprint(field_paths(value))
        if (mapping := by_print.get(mark)) is None:
            return conv, None, mark, None, None, None
        if (turns := canonical_turns(value, mapping)) is None:
            return conv, None, mark, None, None, None
        text, spans = template(turns)
        return conv, mapping["name"], mark, len(turns), text, spans

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(c, r) for c, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return records.select(F.col(conv_id).cast("long"), F.col(record).cast("string")).mapInArrow(run, FORMATTED)


def records_of(turns: DataFrame) -> DataFrame:
    """Conversations given by row and turn as JSON records (conv_id, record), in the layout that fits their roles.

    Turns are ordered by (turn, role, text); null texts and roles count as empty. A conversation is one
    record, as it becomes one formatted string.
    """
    row = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    text = lambda i: F.col("t")[i]["content"]
    pair = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    told = F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")))
    many = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    return convs.select("conv_id", F.when(is_("user", "assistant"), pair).when(is_("system", "user", "assistant"), told).otherwise(many).alias("record"))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string"


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say when read back: turns, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, layout, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                turns = read_back(text or "")
                masked = "".join(unescape(text[s["start"] : s["end"]]) for s in spans or [])
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text or ""), layout))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    names = [x.split()[0] for x in DIGESTS.split(", ")]
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in DIGESTS.split(", ")])
    return formatted.select("conv_id", "layout", "formatted", "loss_spans").mapInArrow(run, DIGESTS)
