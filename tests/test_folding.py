import copy
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafpress.operators import folding as X


def texts(m):
    return [b["text"] for b in m["blocks"] if b["kind"] == "text"]


def at(m, i, offset):
    return {"para": m["blocks"][i]["id"], "offset": offset}


def do(m, *ops):
    return X.apply_batch(m, list(ops))[0]


def test_all_wire_operations_are_there():
    assert len(set(X.OPERATIONS) - {"setTracking"}) == 67


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=20), st.text(max_size=8), st.integers(0, 20))
def test_insert_delete_inverse(text, more, place):
    m = X.empty([text])
    n = X._units(text)
    place = min(place, n)
    try:
        there = do(m, {"op": "insertText", "at": at(m, 0, place), "text": more})
    except X.Refused:
        return  # inside a surrogate pair
    back = do(there, {"op": "deleteRange", "from": at(m, 0, place), "to": at(m, 0, place + X._units(more))})
    assert texts(back) == [text]


def test_split_merge_inverse():
    m = X.empty(["Hello world"])
    s = do(m, {"op": "addBookmark", "name": "b", "from": at(m, 0, 2), "to": at(m, 0, 8)}, {"op": "splitParagraph", "at": at(m, 0, 5)})
    assert texts(s) == ["Hello", " world"]
    back = do(s, {"op": "mergeWithNext", "para": s["blocks"][0]["id"]})
    assert texts(back) == ["Hello world"]


def test_refusal_changes_nothing():
    m = X.empty(["a", "b"])
    before = copy.deepcopy(m)
    for bad in ({"op": "insertText", "at": {"para": 99, "offset": 0}, "text": ""}, {"op": "nope"}, {"op": "insertText"}, {"action": "replaceText", "selector": {"find": "x"}, "text": ""}):
        with pytest.raises(X.Refused):
            X.apply_batch(m, [{"op": "insertText", "at": at(m, 0, 0), "text": "zzz"}, bad])
    assert m == before


def test_tracked_edits():
    m = do(X.empty(["one two three"]), {"op": "setTracking", "author": "A"})
    m = do(m, {"op": "replaceText", "from": at(m, 0, 4), "to": at(m, 0, 7), "text": "2"})
    assert texts(m) == ["one two2 three"]
    assert texts(do(m, {"op": "acceptAll", "author": None})) == ["one 2 three"]
    assert texts(do(m, {"op": "rejectAll", "author": "A"})) == ["one two three"]
    assert texts(do(m, {"op": "acceptAll", "author": "B"})) == ["one two2 three"]


def test_format_survives_whole_run_replacement():
    m = X.empty(["bold"])
    m = do(m, {"op": "setRunProps", "from": at(m, 0, 0), "to": at(m, 0, 4), "patch": {"bold": True}}, {"op": "replaceText", "from": at(m, 0, 0), "to": at(m, 0, 4), "text": "strong"})
    assert any(s["kind"] == "props" and (s["start"], s["end"]) == (0, 6) for s in m["blocks"][0]["spans"])


def test_actions():
    m = X.empty(["a cat and a cat", "dog"])
    assert texts(do(m, {"action": "replaceText", "selector": {"find": "cat", "all": True}, "text": "mouse"})) == ["a mouse and a mouse", "dog"]
    assert texts(do(m, {"action": "replaceText", "selector": {"find": "cat", "occurrence": 2}, "text": "x"})) == ["a cat and a x", "dog"]
    with pytest.raises(X.Refused, match="2 matches"):
        do(m, {"action": "replaceText", "selector": {"find": "cat"}, "text": "x"})
    moved = do(m, {"action": "moveBlocks", "blocks": [m["blocks"][1]["id"]], "before": m["blocks"][0]["id"]})
    assert texts(moved) == ["dog", "a cat and a cat"]
    styled = do(m, {"action": "setBlockStyle", "block": m["blocks"][0]["id"], "style": "Heading1", "create": True})
    assert styled["blocks"][0]["props"] == {"style": "Heading1"} and "Heading1" in styled["styles"]


def test_tables():
    m = do(X.empty([]), {"op": "insertBlock", "at": {"start": True}, "block": {"kind": "table", "rows": [["a", "b", "c"], ["d", "e", "f"], ["g", "h", "i"]]}})
    t = m["blocks"][0]["id"]
    width = lambda m: {sum(c["span"] for c in r["cells"]) for r in m["blocks"][0]["rows"]} | {len(m["blocks"][0]["grid"])}
    m = do(m, {"op": "mergeCells", "table": t, "from": [0, 0], "to": [1, 1]})
    assert width(m) == {3}
    for op in ({"op": "insertColumn", "table": t, "at": 1, "width": 5}, {"op": "deleteColumn", "table": t, "at": 0}, {"op": "insertRow", "table": t, "at": 1}, {"op": "deleteRow", "table": t, "at": 0}):
        m = do(m, op)
        assert len(width(m)) == 1
    assert m["blocks"][0]["rows"][0]["cells"][0]["merge"] == "restart"


def test_declarations_and_ranges():
    m = X.empty(["text here"])
    m = do(
        m, {"op": "upsertStyle", "style": {"id": "S"}}, {"op": "setThemeColors", "colors": {"accent1": "FF0000"}}, {"op": "setThemeColors", "colors": {"accent1": None, "dk1": "0"}}, {"op": "setDocumentSettings", "patch": {"a": 1}},
        {"op": "addNumberingDefinition", "definition": {"levels": []}}, {"op": "restartNumbering", "restart": {"num": 1, "start": 3}}, {"op": "addComment", "from": at(m, 0, 0), "to": at(m, 0, 4), "comment": {"text": "c"}},
        {"op": "setCommentText", "id": "1", "text": "d", "done": True}, {"op": "insertField", "at": at(m, 0, 9), "field": {"instr": "FORMTEXT", "result": "r"}}, {"op": "setSources", "sources": [1]}, {"op": "setPageColor", "color": "FFF"},
    )
    assert m["theme"]["colors"] == {"dk1": "0"} and m["numbering"]["num"]["2"]["overrides"] == {"0": 3} and m["comments"]["1"]["done"]
    key = next(iter(m["fields"]))
    m = do(m, {"op": "setFormText", "field": key, "text": "filled"}, {"op": "removeComment", "id": "1"})
    assert texts(m) == ["text herefilled"] and not m["comments"]
    with pytest.raises(X.Refused):
        do(m, {"op": "toggleCheckbox", "field": key})


def test_random_sequences_keep_spans_inside():
    rng = random.Random(11)
    for _ in range(40):
        m = X.empty(["alpha beta", "gamma", ""])
        for _ in range(40):
            b = rng.choice([b for b in m["blocks"] if b["kind"] == "text"])
            n = X._units(b["text"])
            lo, hi = sorted((rng.randint(0, n), rng.randint(0, n)))
            a, z = {"para": b["id"], "offset": lo}, {"para": b["id"], "offset": hi}
            op = rng.choice(
                [
                    {"op": "insertText", "at": a, "text": rng.choice(["x", "yy", ""])}, {"op": "deleteRange", "from": a, "to": z}, {"op": "replaceText", "from": a, "to": z, "text": "Q"}, {"op": "setRunProps", "from": a, "to": z, "patch": {"b": 1}},
                    {"op": "addComment", "from": a, "to": z, "comment": {"text": ""}}, {"op": "splitParagraph", "at": a}, {"op": "mergeWithNext", "para": b["id"]}, {"op": "setTracking", "author": rng.choice([None, "A"])},
                    {"op": "acceptAll"}, {"op": "rejectAll"}, {"op": "insertBlock", "at": {"after": b["id"]}, "block": {"text": "n"}},
                ]
            )
            try:
                m = do(m, op)
            except X.Refused:
                continue
            for b in m["blocks"]:
                assert all(0 <= s["start"] <= s["end"] <= X._units(b["text"]) for s in b["spans"]), (op, b)
        assert len({b["id"] for b in m["blocks"]}) == len(m["blocks"])


def test_fold_over_documents(spark):
    models = spark.createDataFrame([(i, json.dumps(X.empty([f"doc {i}"]))) for i in range(5)], "doc_id long, model string")
    edits = [(1, 1, json.dumps([{"op": "insertText", "at": {"para": 1, "offset": 0}, "text": "B"}])), (1, 0, json.dumps([{"op": "insertText", "at": {"para": 1, "offset": 0}, "text": "A"}])), (2, 0, json.dumps([{"op": "no"}])), (3, 0, None), (99, 0, "[]")]
    got = {r.doc_id: (json.loads(r.model)["blocks"][0]["text"], r.version) for r in X.fold_edits(models, spark.createDataFrame(edits, "doc_id long, batch long, ops string")).collect()}
    assert got == {0: ("doc 0", 0), 1: ("BAdoc 1", 2), 2: ("doc 2", 0), 3: ("doc 3", 1), 4: ("doc 4", 0)}
