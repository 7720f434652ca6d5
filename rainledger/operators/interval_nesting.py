"""Nested answers turned into flat node tables that are linked by interval labels.

A depth-first traversal numbers every node when it is entered (pre) and left (post). A node lies
under another exactly if its interval lies within the other's, so parents, children and any
descendants are found by comparing numbers, without paths or recursion.
"""

from __future__ import annotations

import json
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "answer_id bigint, kind string, pre int, post int, parent_pre int, pos int, reasoning string, location string, recency_in_months string,"
    " classification string, severity string, evidence string, confidence string, evidence_found_verbatim string"
)
_EVENT_FIELDS = ("reasoning", "location", "recency_in_months")
_IMPACT_FIELDS = ("classification", "severity", "evidence", "confidence", "evidence_found_verbatim")
_OPENING = re.compile(r"[{\[]")
_FENCE = re.compile(r"```[A-Za-z]*\s*(.*?)```", re.S)
_INVALID = object()


def _refuse(_):
    raise ValueError("not a JSON value")


_DECODER = json.JSONDecoder(parse_constant=_refuse)


def _decode(text: str):
    """The JSON value that a text holds, whatever stands around it; _INVALID if there is none or it is cut off."""
    text = text.lstrip("\ufeff \t\r\n")
    if (fence := _FENCE.search(text)) and not text.startswith(("{", "[", '"')):
        text = fence.group(1)
    text = text.strip("\ufeff \t\r\n")
    try:
        if text.startswith(('"', "{", "[")) or text == "null":
            return _DECODER.raw_decode(text)[0]
        start = 0
        while m := _OPENING.search(text, start):
            value, start = _DECODER.raw_decode(text, m.start())
            if isinstance(value, dict) or isinstance(value, list) and (not value or any(isinstance(x, (dict, type(None))) for x in value)):
                return value
    except (ValueError, RecursionError):
        pass
    return _INVALID


def _items(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _field(node: dict, name: str):
    """By name, else by name in any case."""
    if name in node:
        return node[name]
    return next((v for k, v in node.items() if k.lower() == name), None)


def _has(node: dict, names: tuple[str, ...]) -> bool:
    return any(k.lower() in names for k in node)


def _find_events(value):
    """The array of events of an answer, through strings of JSON, wrappers and single objects of any depth; None if there is none."""
    if isinstance(value, str):
        inner = _decode(value) if _OPENING.search(value) else _INVALID
        return None if inner is _INVALID else _find_events(inner)
    if isinstance(value, list):
        if len(value) == 1 and isinstance(value[0], (dict, str)) and not (isinstance(value[0], dict) and _has(value[0], _EVENT_FIELDS + _IMPACT_FIELDS + ("impacts",))):
            return _find_events(value[0])
        return value
    if isinstance(value, dict):
        if _has(value, ("events",)):
            events = _field(value, "events")
            return _find_events(events) if isinstance(events, str) else _items(events)
        if _has(value, _EVENT_FIELDS + _IMPACT_FIELDS + ("impacts",)):
            return [value]
        for inner in value.values():
            if isinstance(inner, (dict, list, str)) and (found := _find_events(inner)) is not None and not (isinstance(inner, list) and not any(isinstance(x, dict) for x in inner)):
                return found
    return None


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def label_answer(answer_id: int, events: list):
    """Node rows of one answer by depth-first traversal: the answer, its events, their impacts."""
    rows, clock = [], 0

    def enter(kind, parent, pos, node, names):
        nonlocal clock
        row = [answer_id, kind, clock, None, parent, pos] + [_text(_field(node, n)) if n in names else None for n in _EVENT_FIELDS + _IMPACT_FIELDS]
        clock += 1
        rows.append(row)
        return row

    def leave(row):
        nonlocal clock
        row[3] = clock
        clock += 1

    top = enter("answer", None, 0, {}, ())
    for i, event in enumerate(events):
        if not isinstance(event, dict):
            continue
        node = enter("event", top[2], i, event, _EVENT_FIELDS)
        impacts = _items(_field(event, "impacts"))
        if not any(isinstance(x, dict) for x in impacts) and _has(event, _IMPACT_FIELDS):
            impacts = [event]
        for j, impact in enumerate(impacts):
            if isinstance(impact, dict):
                leave(enter("impact", node[2], j, impact, _IMPACT_FIELDS))
        leave(node)
    leave(top)
    return rows


def answer_nodes(answers: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Node table of all answers (see NODE_SCHEMA), made in one pass without a shuffle.

    A null, empty, invalid or cut-off payload, or one nested deeper than the JSON parser reads, has no nodes at all; a valid one without events has its
    answer node alone. Null array entries keep their position but are no nodes. A field whose value is
    no string is given as JSON text. Repeated ids give repeated nodes.
    """

    def run(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))
        schema = pa.schema([(name, {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())) for name, kind in (part.split() for part in NODE_SCHEMA.split(","))])
        for batch in batches:
            rows = []
            for answer_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = _decode(payload)
                if value is not _INVALID and (events := _find_events(value)) is not None:
                    rows.extend(label_answer(answer_id, events))
            columns = zip(*rows) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, schema.types)], schema=schema)

    return answers.select(F.col(id_col).cast("bigint").alias("id"), F.col(payload_col).alias("payload")).where("payload is not null and id is not null").mapInArrow(run, NODE_SCHEMA)


def nodes_of(nodes: DataFrame, kind: str) -> DataFrame:
    """The flat table of one node type."""
    fields = {"event": _EVENT_FIELDS, "impact": _IMPACT_FIELDS}.get(kind, ())
    return nodes.where(F.col("kind") == kind).select("answer_id", "pre", "post", "parent_pre", "pos", *fields)


def within(inner: DataFrame, outer: DataFrame, how: str = "inner") -> DataFrame:
    """Each inner node beside the outer nodes whose interval contains it; outer columns get the prefix outer_."""
    out = outer.select(*[F.col(c).alias(c if c == "answer_id" else f"outer_{c}") for c in outer.columns])
    o, i = out.alias("o"), inner.alias("i")
    inside = (F.col("o.answer_id") == F.col("i.answer_id")) & (F.col("o.outer_pre") < F.col("i.pre")) & (F.col("i.post") < F.col("o.outer_post"))
    joined = i.join(o, inside, how)
    return joined.select(F.coalesce("i.answer_id", "o.answer_id").alias("answer_id"), *[f"i.{c}" for c in inner.columns if c != "answer_id"], *[f"o.{c}" for c in out.columns if c != "answer_id"])
