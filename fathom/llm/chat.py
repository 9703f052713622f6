"""Chat formatting by schema fingerprints.

A record is a JSON object in one of many layouts. The hash of its nested field
paths selects a declarative mapping, which turns the record into canonical
turns (role, text). Turns are written in a template with control strings; such
strings inside texts are escaped so that the output can be read back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

# For each layout, where its turns come from.
#   each: the list whose items are turns, with the fields of role and text;
#   turns: a role and the fields whose texts, joined by a blank line, make the turn.
# Fields in optional may be absent; a turn without any of its fields is left out.
MAPPINGS: list[dict[str, Any]] = [
    {"name": "turn", "each": "", "role": "role", "text": "text", "optional": ["text", "role"]},
    {"name": "messages", "each": "messages", "role": "role", "text": "content", "optional": ["system"]},
    {"name": "conversations", "each": "conversations", "role": "from", "text": "value", "optional": ["system"]},
    {"name": "dialogue", "each": "turns", "role": "speaker", "text": "text", "optional": ["system"]},
    {"name": "prompt and response", "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])], "optional": ["system"]},
    {"name": "prompt and completion", "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])], "optional": ["system"]},
    {"name": "instruction", "turns": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])], "optional": ["system", "input"]},
    {"name": "question and answer", "turns": [("user", ["context", "question"]), ("assistant", ["answer"])], "optional": ["context"]},
]
# Other names of the three roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def paths(value: Any, at: str = "") -> set[str]:
    """The paths of all leaves; items of a list share one path, [] stands for an item. A backslash tells a key's own "." or "[" from these."""
    if isinstance(value, dict):
        named = ((re.sub(r"[\\.\[]", r"\\\g<0>", k), v) for k, v in value.items())
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in named)) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(found: Iterable[str]) -> str:
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()[:16]


def _required(mapping: dict[str, Any]) -> tuple[set[str], list[str]]:
    if "each" in mapping:
        at = f"{mapping['each']}[]." if mapping["each"] else ""
        every = {at + mapping["role"], at + mapping["text"]}
    else:
        every = {f for _, fields in mapping["turns"] for f in fields}
    return every - set(mapping["optional"]), mapping["optional"]


def registry() -> dict[str, dict[str, Any]]:
    """The mapping for the fingerprint of each layout, with and without its optional fields."""
    out: dict[str, dict[str, Any]] = {}
    for mapping in MAPPINGS:
        required, optional = _required(mapping)
        for n in range(len(optional) + 1):
            for some in combinations(optional, n):
                if found := required | set(some):
                    out.setdefault(fingerprint(found), mapping)
        if mapping.get("each"):  # an empty list of turns
            out.setdefault(fingerprint({f"{mapping['each']}[]"}), mapping)
    return out


def _text(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical(record: Any, mappings: dict[str, dict[str, Any]]) -> list[tuple[str, str]] | None:
    """The turns of a record as (role, text); None where no mapping has its fingerprint."""
    mapping = mappings.get(fingerprint(paths(record)))
    if mapping is None or not isinstance(record, dict):
        return None
    if "each" in mapping:
        items = record[mapping["each"]] if mapping["each"] else [record]
        turns = [(ROLES.get(r := _text(x.get(mapping["role"])), r), _text(x.get(mapping["text"]))) for x in items]
        return [("system", _text(record["system"])), *turns] if "system" in record and mapping["each"] else turns
    turns = []
    for role, fields in mapping["turns"]:
        if any(f in record for f in fields):
            turns.append((role, "\n\n".join(t for f in fields if (t := _text(record.get(f))))))
    return turns


def escape(text: str) -> str:
    """No "<|" is left: a backslash goes between, one more where some are there already."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    """As escape, and on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and the range of it that counts for the loss (empty but for assistants)."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    end = len(head) + len(body) if role == "assistant" else len(head)
    return f"{head}{body}{END}\n", len(head), end


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; raises where it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END + "\n", line)
        out.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


def format_records(records: DataFrame, id_col: str, order_col: str, record_col: str) -> DataFrame:
    """The turns of all records, formatted: id, order, nth, formatted, loss_start, loss_end.

    record_col holds JSON. nth counts the turns of a record from 0. loss_start and
    loss_end are code points of formatted. A record that isn't JSON, is nested too
    deep to be read, holds an unpaired surrogate in a turn, or whose fingerprint no mapping has, gives
    one row with a null formatted. The formatted
    conversation of an id is its rows' formatted texts, joined in the order of
    (order, nth). A null record is such an unknown one; an empty list of turns
    gives no row. Rows stay in their partitions.
    """
    frame = records.select(F.col(id_col), F.col(order_col), F.col(record_col))
    schema = frame.select(
        id_col, order_col, F.lit(0).alias("nth"), F.lit(None).cast("string").alias("formatted"), F.lit(0).alias("loss_start"), F.lit(0).alias("loss_end")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mappings = registry()
        for batch in batches:
            of, nth, lines = [], [], []
            for i, data in enumerate(batch.column(2).to_pylist()):
                try:
                    turns = canonical(json.loads(data), mappings) if data is not None else None
                    made = [(None, 0, 0)] if turns is None else [format_turn(*t) for t in turns]
                    for line, _, _ in made:
                        (line or "").encode()
                except (ValueError, RecursionError):  # not JSON, nested too deep for a conversation, or half of a surrogate pair
                    made = [(None, 0, 0)]
                of += [i] * len(made)
                nth += range(len(made))
                lines += made
            take = pa.array(of, pa.int64())
            text, start, end = zip(*lines, strict=True) if lines else ((), (), ())
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(nth, pa.int32())]
            columns += [pa.array(text, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frame.mapInArrow(run, schema)


def read_back(formatted: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """Per id, what its formatted turns hold when read back, in order.

    A conversation may hold any share of the rows: its turns pass by as a stream,
    sorted by Spark, and only digests and counts are kept.
    """
    ordered = formatted.repartition(F.col(id_col)).sortWithinPartitions(id_col, order_col, "nth", "formatted")
    frame = ordered.select(id_col, "formatted", "loss_start", "loss_end")
    zero = F.lit(0).cast("long")
    schema = frame.select(
        id_col,
        zero.alias("n_turns"),
        F.lit("").alias("turns_sha256"),
        zero.alias("loss_chars"),
        F.lit("").alias("loss_sha256"),
        zero.alias("formatted_chars"),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> list:
            return [key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]

        key, first = None, True
        for batch in batches:
            rows = []
            for k, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first or k != key:
                    if not first:
                        rows.append(closed())
                    key, first = k, False
                    n = loss_chars = chars = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                if text is None:
                    continue
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                learnt = unescape(text[start:end])
                loss.update(learnt.encode())
                loss_chars += len(learnt)
                chars += len(text)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=arrow)
        if not first:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, closed(), strict=True))], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return frame.mapInArrow(run, schema)
