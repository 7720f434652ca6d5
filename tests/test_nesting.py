import json

import pytest

from rainledger.operators.interval_nesting import answer_nodes, nodes_of, within

IMPACT = {"classification": "Wetland Loss", "severity": 2, "evidence": "x", "confidence": 0.5}
EVENT = {"location": "P", "recency_in_months": 0, "impacts": [IMPACT, None, IMPACT]}
BODY = json.dumps({"events": [EVENT, None, {"location": "Q"}]})
FULL = [(0, 0), (0, 2), (2, -1)]
CASES = {
    "plain": (BODY, FULL), "fence": (f"```json\n{BODY}\n```", FULL), "talk before": (f"Here are [2] impacts:\n{BODY}\n\nDone.", FULL), "mark": ("﻿" + BODY, FULL),
    "string": (json.dumps(BODY), FULL), "call": (json.dumps({"name": "f", "arguments": BODY}), FULL), "wrapper": (json.dumps({"result": json.loads(BODY), "usage": {"n": 1}}), FULL),
    "other case": (BODY.replace('"events"', '"Events"'), FULL), "list": (json.dumps([EVENT]), [(0, 0), (0, 2)]), "list of one answer": (f"[{BODY}]", FULL), "one event": (json.dumps(EVENT), [(0, 0), (0, 2)]),
    "object for array": (json.dumps({"events": {"location": "P", "impacts": IMPACT}}), [(0, 0)]), "flat event": (json.dumps({"events": [{"location": "P", **IMPACT}]}), [(0, 0)]),
    "empty impacts": ('{"events": [{"location": "P", "impacts": []}]}', [(0, -1)]), "null impacts": ('{"events": [{"location": "P", "impacts": null}]}', [(0, -1)]), "only nulls": ('{"events": [{"location": "P", "impacts": [null]}]}', [(0, -1)]),
    "no events": ('{"events": []}', []), "null events": ('{"events": null}', []), "cut off": (BODY[:-5], []), "cut fence": ("```json\n" + BODY[:60], []), "error": ("Error: timeout after 120 s", []), "empty": ("", []), "null text": ("null", []), "number": ("12", []),
    "not JSON": ('{"events": [NaN]}', []), "very deep": ("[" * 5000 + "]" * 5000, []), "null": (None, []),
}


def test_cases(spark):
    names = list(CASES)
    rows = spark.createDataFrame([(i, CASES[n][0], "pre", 1) for i, n in enumerate(names)], "extraction_id long, payload string, kind string, pos int")
    nodes = answer_nodes(rows, "extraction_id", "payload")
    linked = within(nodes_of(nodes, "impact"), nodes_of(nodes, "event"), "right")
    got = {}
    for r in linked.collect():
        got.setdefault(names[r["answer_id"]], []).append((r["outer_pos"], -1 if r["pos"] is None else r["pos"]))
    for n in names:
        assert sorted(got.get(n, [])) == sorted(CASES[n][1]), n


def test_intervals_nest_and_levels_agree(spark):
    nodes = answer_nodes(spark.createDataFrame([(1, BODY)], "i long, p string"), "i", "p").collect()
    assert len({n["pre"] for n in nodes} | {n["post"] for n in nodes}) == 2 * len(nodes)
    for a in nodes:
        for b in nodes:
            assert a["post"] < b["pre"] or b["post"] < a["pre"] or a is b or (a["pre"] < b["pre"] and b["post"] < a["post"]) or (b["pre"] < a["pre"] and a["post"] < b["post"])
        if a["parent_pre"] is not None:
            parent = next(x for x in nodes if x["pre"] == a["parent_pre"])
            assert parent["pre"] < a["pre"] and a["post"] < parent["post"]


def test_empty_table(spark):
    assert answer_nodes(spark.createDataFrame([], "i long, p string"), "i", "p").count() == 0


@pytest.mark.parametrize("value", ['{"events": [{"location": ["a", 1], "impacts": [{"severity": "2", "extra": {"x": []}}]}]}'])
def test_odd_types_are_json_text(spark, value):
    nodes = {n["kind"]: n for n in answer_nodes(spark.createDataFrame([(1, value)], "i long, p string"), "i", "p").collect()}
    assert nodes["event"]["location"] == '["a", 1]' and nodes["impact"]["severity"] == "2"
