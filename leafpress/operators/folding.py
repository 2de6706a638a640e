"""The ordered edit engine: batches of operations folded over a document's model, one document a task.

A model is a plain dict (see `empty`), JSON in the table. Offsets are UTF-16 code units of a block's text. An
operation that can't be done raises Refused and leaves the model as it was; a batch is atomic: the
first refusal drops the whole batch. Formatting, comments and bookmarks are spans over a block's text and
move with it; tracked edits mark spans instead of changing text.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


class Refused(ValueError):
    """An operation that can't be applied, with its reason."""


OPERATIONS: dict[str, Callable[[dict, dict], None]] = {}


def operation(name: str) -> Callable:
    def add(f):
        OPERATIONS[name] = f
        return f

    return add


def empty(texts: list[str] | None = None) -> dict:
    """A model with a paragraph for each text."""
    model = {
        "next": 1, "blocks": [], "styles": {}, "numbering": {"abstract": {}, "num": {}}, "theme": {"fonts": {}, "colors": {}}, "settings": {}, "sources": [], "comments": {}, "bookmarks": {}, "fields": {},
        "notes": {"footnote": {}, "endnote": {}}, "sections": {}, "parts": {}, "media": {}, "charts": {}, "drawings": {}, "sdts": {}, "links": {}, "maths": {}, "textboxes": {}, "background": None, "track": None,
    }
    for t in texts or []:
        model["blocks"].append(_paragraph(model, t))
    return model


def _id(model: dict) -> int:
    model["next"] += 1
    return model["next"] - 1


def _paragraph(model: dict, text: str = "", **more) -> dict:
    return {"id": _id(model), "kind": "text", "text": text, "props": {}, "spans": [], **more}


def _units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def _cut(text: str, a: int, b: int | None = None) -> str:
    raw = text.encode("utf-16-le", "surrogatepass")
    try:
        return raw[2 * a : None if b is None else 2 * b].decode("utf-16-le")
    except UnicodeDecodeError:
        raise Refused("offset inside a character") from None


def _all(blocks: list[dict]):
    for b in blocks:
        yield b
        for row in b.get("rows", ()):
            for cell in row["cells"]:
                yield from _all(cell["blocks"])


def _blocks(model: dict):
    yield from _all(model["blocks"])
    for part in model["parts"].values():
        yield from _all(part.get("blocks", []))
    for kind in model["notes"].values():
        for note in kind.values():
            yield from _all(note["blocks"])
    for box in model["textboxes"].values():
        yield from _all(box["blocks"])


def _block(model: dict, node: int, kind: str | None = "text") -> dict:
    b = next((b for b in _blocks(model) if b["id"] == node), None)
    if b is None or kind and b["kind"] != kind:
        raise Refused(f"no {kind or 'block'} {node}")
    return b


def _home(model: dict, node: int) -> tuple[list[dict], int]:
    """The list that holds a block, and its place."""
    lists = [model["blocks"], *(p["blocks"] for p in model["parts"].values() if "blocks" in p)]
    while lists:
        own = lists.pop()
        for i, b in enumerate(own):
            if b["id"] == node:
                return own, i
            lists += [c["blocks"] for r in b.get("rows", ()) for c in r["cells"]]
    raise Refused(f"no block {node}")


def _at(model: dict, pos: dict) -> tuple[dict, int]:
    b, at = _block(model, pos["para"]), pos["offset"]
    if not 0 <= at <= _units(b["text"]):
        raise Refused("offset out of range")
    return b, at


def _range(model: dict, op: dict) -> tuple[dict, int, int]:
    (b, lo), (c, hi) = _at(model, op["from"]), _at(model, op["to"])
    if b is not c or lo > hi:
        raise Refused("a range lies in one paragraph, forwards")
    if any(s["kind"] == "locked" and s["start"] < hi and lo < s["end"] for s in b["spans"]):
        raise Refused("protected content")
    return b, lo, hi


def _splice(b: dict, lo: int, hi: int, text: str) -> None:
    """Text instead of [lo, hi); spans shift, shrink or go, and one that holds the place grows."""
    b["text"] = _cut(b["text"], 0, lo) + text + _cut(b["text"], hi)
    n = _units(text)
    kept = []
    for s in b["spans"]:
        def moved(x: int, end: bool) -> int:
            if x < lo or x == lo and (hi > lo or end and s["end"] > s["start"] or not end and s["kind"] != "props"):
                return x
            return lo if x < hi else x + n - (hi - lo)

        a, z = moved(s["start"], False), moved(s["end"], True)
        replaced = hi > lo and s["start"] <= lo and s["end"] >= hi
        if replaced or s["start"] < lo and (s["end"] > hi or s["end"] == hi and s["kind"] == "props"):
            z = s["end"] + n - (hi - lo)
        # A range whose text goes whole: bookmarks collapse, all else goes with it.
        if a < z or s["kind"] == "bookmark" or s["start"] == s["end"]:
            kept.append(s | {"start": a, "end": max(a, z)})
    b["spans"] = kept


def _mark(b: dict, lo: int, hi: int, kind: str, **more) -> None:
    b["spans"].append({"kind": kind, "start": lo, "end": hi, **more})


def _patch(props: dict, patch: dict) -> None:
    """Absent keeps, null unsets, a value sets."""
    for k, v in patch.items():
        if v is None:
            props.pop(k, None)
        elif isinstance(v, dict) and isinstance(props.get(k), dict):
            _patch(props[k], v)
        else:
            props[k] = v


def _need(table: dict, key, what: str) -> dict:
    if str(key) not in table:
        raise Refused(f"no {what} {key}")
    return table[str(key)]


# --- text ----------------------------------------------------------------------------------------


@operation("insertText")
def _(model, op):
    b, at = _at(model, op["at"])
    _splice(b, at, at, op["text"])
    if op.get("props"):
        _mark(b, at, at + _units(op["text"]), "props", props=op["props"])
    if model["track"]:
        _mark(b, at, at + _units(op["text"]), "ins", id=_id(model), author=model["track"])


@operation("replaceText")
def _(model, op):
    b, lo, hi = _range(model, op)
    if model["track"]:
        _mark(b, lo, hi, "del", id=_id(model), author=model["track"])
        _splice(b, hi, hi, op["text"])
        _mark(b, hi, hi + _units(op["text"]), "ins", id=_id(model), author=model["track"])
        return
    # The new text takes the format at the start of the old one, also where that format ends with it.
    format = [dict(s) for s in b["spans"] if s["kind"] == "props" and s["start"] <= lo < s["end"] and lo < hi]
    _splice(b, lo, hi, op["text"])
    end = lo + _units(op["text"])
    for s in format:
        if not any(x["kind"] == "props" and x.get("props") == s["props"] and x["start"] <= lo and x["end"] >= end for x in b["spans"]):
            _mark(b, lo, end, "props", props=s["props"])


@operation("deleteRange")
def _(model, op):
    b, lo, hi = _range(model, op)
    if model["track"]:
        _mark(b, lo, hi, "del", id=_id(model), author=model["track"])
    else:
        _splice(b, lo, hi, "")


@operation("setRunProps")
def _(model, op):
    b, lo, hi = _range(model, op)
    _mark(b, lo, hi, "props", props=op["patch"])


@operation("replaceInlines")
def _(model, op):
    b = _block(model, op["para"])
    b["text"], b["spans"] = "", []
    for run in op["inlines"]:
        at = _units(b["text"])
        b["text"] += run["text"]
        if run.get("props"):
            _mark(b, at, at + _units(run["text"]), "props", props=run["props"])


@operation("setParaProps")
def _(model, op):
    _patch(_block(model, op["para"])["props"], op["patch"])


@operation("replaceParaProps")
def _(model, op):
    _block(model, op["para"])["props"] = copy.deepcopy(op["props"])


@operation("splitParagraph")
def _(model, op):
    b, at = _at(model, op["at"])
    own, i = _home(model, b["id"])
    new = _paragraph(model, _cut(b["text"], at))
    new["props"] = copy.deepcopy(b["props"])
    new["spans"] = [s | {"start": max(0, s["start"] - at), "end": s["end"] - at} for s in b["spans"] if s["end"] > at]
    b["spans"] = [s | {"end": min(s["end"], at)} for s in b["spans"] if s["start"] < at or s["start"] == s["end"] == at]
    b["text"] = _cut(b["text"], 0, at)
    own.insert(i + 1, new)


@operation("mergeWithNext")
def _(model, op):
    own, i = _home(model, _block(model, op["para"])["id"])
    if i + 1 >= len(own) or own[i + 1]["kind"] != "text":
        raise Refused("no paragraph follows")
    b, c = own[i], own.pop(i + 1)
    n = _units(b["text"])
    b["text"] += c["text"]
    b["spans"] += [s | {"start": s["start"] + n, "end": s["end"] + n} for s in c["spans"]]


@operation("insertAtom")
def _(model, op):
    b, at = _at(model, op["at"])
    atom = op["atom"]
    char = {"tab": "\t", "break": "\n", "noBreakHyphen": "‑", "softHyphen": "\xad"}.get(atom["kind"], "￼")
    _splice(b, at, at, char)
    _mark(b, at, at + 1, "atom", atom=atom)
    if atom["kind"] in ("footnote", "endnote"):
        model["notes"][atom["kind"]][str(atom["id"])] = {"blocks": [_paragraph(model, atom.get("text", ""))]}


# --- blocks --------------------------------------------------------------------------------------


def _made(model: dict, block: dict) -> dict:
    if block.get("kind", "text") == "table":
        return {"id": _id(model), "kind": "table", "props": {}, "grid": block.get("grid") or [1] * max((len(r) for r in block["rows"]), default=0), "rows": [{"id": _id(model), "props": {}, "cells": [_cell(model, t) for t in r]} for r in block["rows"]]}
    return _paragraph(model, block.get("text", ""), props=copy.deepcopy(block.get("props", {})))


def _cell(model: dict, text: str = "") -> dict:
    return {"id": _id(model), "span": 1, "merge": None, "props": {}, "blocks": [_paragraph(model, text)]}


@operation("insertBlock")
def _(model, op):
    at = op["at"]
    if "after" in at:
        own, i = _home(model, at["after"])
        own.insert(i + 1, _made(model, op["block"]))
    elif "before" in at:
        own, i = _home(model, at["before"])
        own.insert(i, _made(model, op["block"]))
    else:
        model["blocks"].insert(0 if at.get("start") else len(model["blocks"]), _made(model, op["block"]))


@operation("deleteBlock")
def _(model, op):
    own, i = _home(model, op["node"])
    del own[i]


@operation("moveBlock")
def _(model, op):
    own, i = _home(model, op["node"])
    target = op["to"].get("before", op["to"].get("after"))
    if target == op["node"]:
        raise Refused("a block can't stand beside itself")
    moved = own[i]
    if any(b["id"] == target for b in _all([moved])):
        raise Refused("a block can't move into itself")
    _home(model, target)
    del own[i]
    there, j = _home(model, target)
    there.insert(j + ("after" in op["to"]), moved)


# --- tables --------------------------------------------------------------------------------------


def _find(model: dict, node: int, kind: str) -> tuple[dict, dict]:
    for t in _blocks(model):
        for r in t.get("rows", ()):
            if kind == "row" and r["id"] == node:
                return t, r
            for c in r["cells"]:
                if kind == "cell" and c["id"] == node:
                    return t, c
    raise Refused(f"no {kind} {node}")


@operation("setTableProps")
def _(model, op):
    _patch(_block(model, op["table"], "table")["props"], op["patch"])


@operation("setRowProps")
def _(model, op):
    _patch(_find(model, op["row"], "row")[1]["props"], op["patch"])


@operation("setCellProps")
def _(model, op):
    _patch(_find(model, op["cell"], "cell")[1]["props"], op["patch"])


@operation("insertRow")
def _(model, op):
    t = _block(model, op["table"], "table")
    if not 0 <= op["at"] <= len(t["rows"]):
        raise Refused("row out of range")
    like = next((r for r in t["rows"] if r["id"] == op.get("template")), t["rows"][min(op["at"], len(t["rows"]) - 1)] if t["rows"] else None)
    cells = [_cell(model) | {"span": c["span"], "props": copy.deepcopy(c["props"])} for c in like["cells"]] if like else [_cell(model) for _ in t["grid"]]
    # A merge that runs through the new row goes on in it.
    if 0 < op["at"] < len(t["rows"]):
        for a, b in zip(cells, t["rows"][op["at"]]["cells"]):
            a["merge"] = "continue" if b["merge"] == "continue" else None
    t["rows"].insert(op["at"], {"id": _id(model), "props": {}, "cells": cells})


@operation("deleteRow")
def _(model, op):
    t = _block(model, op["table"], "table")
    if not 0 <= op["at"] < len(t["rows"]) or len(t["rows"]) == 1:
        raise Refused("no such row, or the last one")
    gone = t["rows"].pop(op["at"])
    if op["at"] < len(t["rows"]):
        for a, b in zip(gone["cells"], t["rows"][op["at"]]["cells"]):
            if a["merge"] == "restart" and b["merge"] == "continue":
                b["merge"] = "restart"


@operation("insertColumn")
def _(model, op):
    t = _block(model, op["table"], "table")
    if not 0 <= op["at"] <= len(t["grid"]):
        raise Refused("column out of range")
    t["grid"].insert(op["at"], op.get("width", 1))
    for r in t["rows"]:
        col = 0
        for i, c in enumerate([*r["cells"], None]):
            if c is None or col >= op["at"]:
                r["cells"].insert(i, _cell(model))
                break
            if col < op["at"] < col + c["span"]:
                c["span"] += 1
                break
            col += c["span"]


@operation("deleteColumn")
def _(model, op):
    t = _block(model, op["table"], "table")
    if not 0 <= op["at"] < len(t["grid"]) or len(t["grid"]) == 1:
        raise Refused("no such column, or the last one")
    del t["grid"][op["at"]]
    for r in t["rows"]:
        col = 0
        for i, c in enumerate(r["cells"]):
            if col <= op["at"] < col + c["span"]:
                if c["span"] > 1:
                    c["span"] -= 1
                else:
                    del r["cells"][i]
                break
            col += c["span"]


@operation("mergeCells")
def _(model, op):
    t = _block(model, op["table"], "table")
    (r0, c0), (r1, c1) = op["from"], op["to"]
    if not (0 <= r0 <= r1 < len(t["rows"])):
        raise Refused("rows out of range")
    for r in range(r0, r1 + 1):
        cells = t["rows"][r]["cells"]
        if not 0 <= c0 <= c1 < len(cells):
            raise Refused("cells out of range")
        first = cells[c0]
        for c in cells[c0 + 1 : c1 + 1]:
            first["span"] += c["span"]
            first["blocks"] += [b for b in c["blocks"] if b.get("text")]
        del cells[c0 + 1 : c1 + 1]
        if r1 > r0:
            first["merge"] = "restart" if r == r0 else "continue"


# --- ranges and fields ----------------------------------------------------------------------------


@operation("addComment")
def _(model, op):
    b, lo, hi = _range(model, op)
    key = str(max([0, *map(int, model["comments"])]) + 1)
    model["comments"][key] = {"text": op["comment"]["text"], "author": op["comment"].get("author", ""), "done": False}
    _mark(b, lo, hi, "comment", id=key)


def _unmark(model: dict, kind: str, key) -> None:
    for b in _blocks(model):
        if "spans" in b:
            b["spans"] = [s for s in b["spans"] if not (s["kind"] == kind and s.get("id") == key)]


@operation("removeComment")
def _(model, op):
    _need(model["comments"], op["id"], "comment")
    del model["comments"][str(op["id"])]
    _unmark(model, "comment", str(op["id"]))


@operation("setCommentText")
def _(model, op):
    c = _need(model["comments"], op["id"], "comment")
    c["text"] = op["text"]
    if op.get("done") is not None:
        c["done"] = op["done"]


@operation("addBookmark")
def _(model, op):
    if op["name"] in model["bookmarks"]:
        raise Refused("the name is taken")
    b, lo, hi = _range(model, op)
    model["bookmarks"][op["name"]] = {"para": b["id"]}
    _mark(b, lo, hi, "bookmark", id=op["name"])


@operation("removeBookmark")
def _(model, op):
    _need(model["bookmarks"], op["name"], "bookmark")
    del model["bookmarks"][op["name"]]
    _unmark(model, "bookmark", op["name"])


@operation("insertField")
def _(model, op):
    b, at = _at(model, op["at"])
    key = str(_id(model))
    result = op["field"].get("result", "")
    model["fields"][key] = {"instr": op["field"]["instr"], "result": result, "checked": op["field"].get("checked", False), "props": {}}
    _splice(b, at, at, result)
    _mark(b, at, at + _units(result), "field", id=key)


def _result(model: dict, key, text: str) -> None:
    f = _need(model["fields"], key, "field")
    f["result"] = text
    for b in _blocks(model):
        for s in list(b.get("spans", ())):
            if s["kind"] == "field" and s["id"] == str(key):
                lo = s["start"]
                b["spans"].remove(s)
                _splice(b, lo, s["end"], text)
                _mark(b, lo, lo + _units(text), "field", id=str(key))
                return


@operation("toggleCheckbox")
def _(model, op):
    f = _need(model["fields"], op["field"], "field")
    if "FORMCHECKBOX" not in f["instr"]:
        raise Refused("no check box")
    f["checked"] = not f["checked"]


@operation("setFormText")
def _(model, op):
    if "FORMTEXT" not in _need(model["fields"], op["field"], "field")["instr"]:
        raise Refused("no form text")
    _result(model, op["field"], op["text"])


@operation("setFieldResultProps")
def _(model, op):
    _patch(_need(model["fields"], op["field"], "field")["props"], op["patch"])


@operation("updateBlockField")
def _(model, op):
    _need(model["fields"], op["field"], "field")["blocks"] = [b.get("text", "") for b in op["blocks"]]


def _headings(model: dict, first: int, last: int) -> list[tuple[int, str]]:
    out = []
    for b in model["blocks"]:
        level = b.get("props", {}).get("level") or {f"Heading{i}": i for i in range(1, 10)}.get(b.get("props", {}).get("style", ""))
        if b["kind"] == "text" and level and first <= level <= last and b["text"].strip():
            out.append((level, b["text"].strip()))
    return out


@operation("regenerateBlockField")
def _(model, op):
    f = _need(model["fields"], op["field"], "field")
    word = f["instr"].split()[0].upper() if f["instr"].split() else ""
    o = op.get("options", {})
    if word == "TOC":
        f["blocks"] = ["\t" * (level - 1) + text for level, text in _headings(model, o.get("first", 1), o.get("last", 9))]
    elif word == "INDEX":
        f["blocks"] = sorted({t.strip() for t in o.get("terms", []) if t.strip()})
    else:
        raise Refused("no generated field")


@operation("setLinkTarget")
def _(model, op):
    _need(model["links"], op["link"], "link")["target"] = op["target"]


# --- declarations ---------------------------------------------------------------------------------


@operation("setSources")
def _(model, op):
    model["sources"] = copy.deepcopy(op["sources"])


@operation("addNumberingDefinition")
def _(model, op):
    d = op["definition"]
    a = str(max([0, *map(int, model["numbering"]["abstract"])]) + 1)
    model["numbering"]["abstract"][a] = {"levels": d["levels"]}
    model["numbering"]["num"][str(max([0, *map(int, model["numbering"]["num"])]) + 1)] = {"abstract": a, "overrides": {}}


@operation("restartNumbering")
def _(model, op):
    old = _need(model["numbering"]["num"], op["restart"]["num"], "numbering")
    new = str(max(map(int, model["numbering"]["num"])) + 1)
    model["numbering"]["num"][new] = {"abstract": old["abstract"], "overrides": {str(op["restart"].get("ilvl", 0)): op["restart"].get("start", 1)}}


@operation("setThemeFonts")
def _(model, op):
    _patch(model["theme"]["fonts"], op["fonts"])


@operation("setThemeColors")
def _(model, op):
    _patch(model["theme"]["colors"], op["colors"])


@operation("upsertStyle")
def _(model, op):
    s = op["style"]
    if s.get("basedOn") == s["id"]:
        raise Refused("a style based on itself")
    model["styles"][s["id"]] = copy.deepcopy(s)


@operation("setDocumentSettings")
def _(model, op):
    _patch(model["settings"], op["patch"])


@operation("setPageColor")
def _(model, op):
    model["background"] = op.get("color")


# --- sections --------------------------------------------------------------------------------------


@operation("setSectionProps")
def _(model, op):
    _patch(_need(model["sections"], op["sect"], "section").setdefault("props", {}), op["patch"])


def _slot(op: dict) -> str:
    if op["kind"] not in ("header", "footer") or op["variant"] not in ("default", "first", "even"):
        raise Refused("no such slot")
    return f"{op['kind']}.{op['variant']}"


@operation("setHeaderFooter")
def _(model, op):
    s, key = _need(model["sections"], op["sect"], "section"), str(_id(model))
    model["parts"][key] = {"kind": op["kind"], "blocks": [_made(model, b) for b in op["content"]]}
    s.setdefault("slots", {})[_slot(op)] = key


@operation("linkHeaderFooter")
def _(model, op):
    _need(model["parts"], op["part"], "part")
    _need(model["sections"], op["sect"], "section").setdefault("slots", {})[_slot(op)] = str(op["part"])


@operation("setWatermark")
def _(model, op):
    s = _need(model["sections"], op["sect"], "section")
    s["watermark"] = op.get("text")


@operation("insertSectionBreak")
def _(model, op):
    own, i = _home(model, op["after"])
    key = str(_id(model))
    model["sections"][key] = {"type": op.get("kind", "nextPage"), "props": {}, "after": own[i]["id"]}


@operation("deleteSectionBreak")
def _(model, op):
    _need(model["sections"], op["sect"], "section")
    del model["sections"][str(op["sect"])]


# --- notes, controls, objects, parts ---------------------------------------------------------------


@operation("setNoteContent")
def _(model, op):
    note = _need(model["notes"]["endnote" if op["endnote"] else "footnote"], op["id"], "note")
    note["blocks"] = [_paragraph(model, "".join(r["text"] for r in op["content"]))]


@operation("removeNote")
def _(model, op):
    kind = "endnote" if op["endnote"] else "footnote"
    _need(model["notes"][kind], op["id"], "note")
    del model["notes"][kind][str(op["id"])]
    for b in _blocks(model):
        for s in list(b.get("spans", ())):
            if s["kind"] == "atom" and s["atom"]["kind"] == kind and str(s["atom"]["id"]) == str(op["id"]):
                b["spans"].remove(s)
                _splice(b, s["start"], s["end"], "")


@operation("setSdtContent")
def _(model, op):
    s = _need(model["sdts"], op["sdt"], "content control")
    if s.get("locked") or s.get("bound"):
        raise Refused("the content control is locked or bound")
    s["text"] = "".join(r["text"] for r in op["inlines"])


@operation("removeSdtShell")
def _(model, op):
    if _need(model["sdts"], op["sdt"], "content control").get("locked"):
        raise Refused("the content control is locked")
    del model["sdts"][str(op["sdt"])]


@operation("setMathTokens")
def _(model, op):
    m = _need(model["maths"], op["math"], "formula")
    if len(m["tokens"]) != len(op["tokens"]):
        raise Refused("as many tokens as before are needed")
    m["tokens"] = list(op["tokens"])


def _drawing(key: str, fields: tuple[str, ...]) -> Callable:
    def apply(model, op):
        d = _need(model["drawings"], op[key], "drawing")
        for f in fields:
            if f in op:  # absent keeps, null unsets
                _patch(d, {f: op[f]})

    return apply


OPERATIONS["setDrawingGeometry"] = _drawing("drawing", ("geom",))
OPERATIONS["setDrawingZOrder"] = _drawing("drawing", ("z",))
OPERATIONS["setDrawingWrap"] = _drawing("drawing", ("wrap", "pos", "z_order"))
OPERATIONS["setShapeStyle"] = _drawing("shape", ("fill", "outline"))


@operation("replaceImageMedia")
def _(model, op):
    d = _need(model["drawings"], op["drawing"], "drawing")
    if not op["mime"].startswith("image/"):
        raise Refused("no image")
    key = next((k for k, m in model["media"].items() if m == {"bytes": op["bytes"], "mime": op["mime"]}), None) or str(_id(model))
    model["media"][key] = {"bytes": op["bytes"], "mime": op["mime"]}
    d["media"] = key


@operation("removeInks")
def _(model, op):
    model["drawings"] = {k: d for k, d in model["drawings"].items() if d.get("kind") != "ink"}


@operation("insertInk")
def _(model, op):
    b = _block(model, op["para"])
    key = str(_id(model))
    model["drawings"][key] = {"kind": "ink", **op["ink"]}
    at = _units(b["text"])
    _splice(b, at, at, "￼")
    _mark(b, at, at + 1, "atom", atom={"kind": "drawing", "id": key})


@operation("setChartData")
def _(model, op):
    _patch(_need(model["charts"], op["part"], "chart"), op["patch"])


@operation("setTextboxContent")
def _(model, op):
    _need(model["textboxes"], op["textbox"], "text box")["blocks"] = [_made(model, b) for b in op["blocks"]]


@operation("replacePartXml")
def _(model, op):
    from xml.parsers import expat

    try:
        expat.ParserCreate().Parse(op["xml"], True)
    except expat.ExpatError as why:
        raise Refused(f"no well-formed XML: {why}") from None
    _need(model["parts"], op["part"], "part")["xml"] = op["xml"]


@operation("replacePartBytes")
def _(model, op):
    _need(model["parts"], op["part"], "part")["bytes"] = op["bytes"]


# --- revisions -------------------------------------------------------------------------------------


def _resolve(model: dict, chosen: Callable[[dict], bool], accept: bool) -> int:
    """Inner revisions first: the shortest span of a block before the ones around it."""
    gone = ("del", "moveFrom") if accept else ("ins", "moveTo")
    n = 0
    for b in list(_blocks(model)):
        while True:
            marks = [s for s in b.get("spans", ()) if s["kind"] in ("ins", "del", "moveFrom", "moveTo") and chosen(s)]
            if not marks:
                break
            s = min(marks, key=lambda s: (s["end"] - s["start"], s["start"]))
            b["spans"].remove(s)
            n += 1
            if s["kind"] in gone:
                _splice(b, s["start"], s["end"], "")
        for s in [s for s in b.get("spans", ()) if s["kind"] == "propsChange" and chosen(s)]:
            b["spans"].remove(s)
            n += 1
            if not accept:
                b["props"] = copy.deepcopy(s["old"])
    return n


def _one(accept: bool) -> Callable:
    def apply(model, op):
        if not _resolve(model, lambda s: s.get("id") == op["rev"], accept):
            raise Refused(f"no revision {op['rev']}")

    return apply


def _every(accept: bool) -> Callable:
    def apply(model, op):
        _resolve(model, lambda s: op.get("author") is None or s.get("author") == op["author"], accept)

    return apply


OPERATIONS |= {"acceptRevision": _one(True), "rejectRevision": _one(False), "acceptAll": _every(True), "rejectAll": _every(False)}


@operation("setTracking")
def _(model, op):
    """Beyond the wire table: later edits are tracked under an author, or no longer."""
    model["track"] = op.get("author")


# --- agent actions ---------------------------------------------------------------------------------


def matches(model: dict, selector: dict) -> list[tuple[int, int, int]]:
    """(para, from, to) of a selector: anchors, or a literal with an occurrence or all. Ambiguity is refused."""
    if "anchor" in selector:
        a = selector["anchor"]
        return [(a["para"], a["from"], a["to"])]
    find, hits = selector["find"], []
    if not find:
        raise Refused("an empty literal matches nothing")
    for b in _all(model["blocks"]):
        at = b["text"].find(find) if b["kind"] == "text" else -1
        while at >= 0:
            start = _units(b["text"][:at])
            hits.append((b["id"], start, start + _units(find)))
            at = b["text"].find(find, at + len(find))
    if selector.get("all"):
        return hits
    if "occurrence" in selector:
        if not 1 <= selector["occurrence"] <= len(hits):
            raise Refused(f"{len(hits)} matches")
        return [hits[selector["occurrence"] - 1]]
    if len(hits) != 1:
        raise Refused(f"{len(hits)} matches: {hits[:8]}")
    return hits


def compile_action(model: dict, action: dict) -> list[dict]:
    """An agent action as native operations on the model as it is now."""
    kind = action["action"]
    span = lambda h: {"from": {"para": h[0], "offset": h[1]}, "to": {"para": h[0], "offset": h[2]}}
    if kind == "replaceText":
        return [{"op": "replaceText", **span(h), "text": action["text"]} for h in reversed(matches(model, action["selector"]))]
    if kind == "insertParagraphAfter":
        return [{"op": "insertBlock", "at": {"after": action["block"]}, "block": {"text": action["text"], "props": {"style": action["style"]} if action.get("style") else {}}}]
    if kind == "setBlockStyle":
        if action["style"] not in model["styles"] and not action.get("create"):
            raise Refused(f"no style {action['style']}")
        made = [] if action["style"] in model["styles"] else [{"op": "upsertStyle", "style": {"id": action["style"], "kind": "paragraph"}}]
        return [*made, {"op": "setParaProps", "para": action["block"], "patch": {"style": action["style"]}}]
    if kind == "deleteBlock":
        return [{"op": "deleteBlock", "node": action["block"]}]
    if kind == "moveBlocks":
        return [{"op": "moveBlock", "node": b, "to": {"before": action["before"]}} for b in action["blocks"]]
    if kind == "deleteTableColumn":
        return [{"op": "deleteColumn", "table": action["table"], "at": action["column"] - 1}]
    if kind == "addComment":
        return [{"op": "addComment", **span(h), "comment": {"text": action["text"], "author": action.get("author", "")}} for h in matches(model, action["selector"])]
    if kind == "acceptRevisions":
        return [{"op": "acceptAll", "author": action["author"]}]
    if kind == "updateToc":
        return [{"op": "regenerateBlockField", "field": k, "options": action.get("options", {})} for k, f in model["fields"].items() if f["instr"].strip().upper().startswith("TOC")]
    if kind == "setHeaderFooter":
        return [{"op": "setHeaderFooter", "sect": action["section"], "kind": action["kind"], "variant": action.get("variant", "default"), "content": [{"text": t} for t in action["text"].split("\n")]}]
    if kind == "replaceImage":
        return [{"op": "replaceImageMedia", "drawing": action["drawing"], "bytes": action["bytes"], "mime": action["mime"]}]
    raise Refused(f"unknown action {kind}")


def apply_batch(model: dict, ops: list[dict]) -> tuple[dict, list[dict]]:
    """The model after all operations and actions, and those that ran; Refused leaves the given model untouched."""
    work, ran = copy.deepcopy(model), []
    for op in ops:
        for native in compile_action(work, op) if "action" in op else [op]:
            if native.get("op") not in OPERATIONS:
                raise Refused(f"unknown operation {native.get('op')}")
            try:
                OPERATIONS[native["op"]](work, native)
            except (KeyError, TypeError) as why:
                raise Refused(f"malformed {native['op']}: {why}") from None
            ran.append(native)
    return work, ran


def fold_edits(models: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, model, version, receipts: batches of `edits` (doc_id, batch, ops as JSON) folded in order over `models` (doc_id, model as JSON).

    Documents are independent, so they spread over the cluster; edits of one document are in order of
    batch. A refused batch leaves a receipt with its reason and nothing else. Documents without edits
    keep their model; edits of unknown documents are left out. Null ops count as none.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text in left.model:
            model, version, receipts = json.loads(text), 0, []
            for batch, ops in zip(*(right.sort_values("batch")[c] for c in ("batch", "ops"))):
                try:
                    model, ran = apply_batch(model, json.loads(ops or "[]"))
                    version += 1
                    receipts.append({"batch": int(batch), "applied": len(ran)})
                except Refused as why:
                    receipts.append({"batch": int(batch), "refused": str(why)})
            rows.append((key[0], json.dumps(model), version, json.dumps(receipts)))
        return pd.DataFrame(rows, columns=["doc_id", "model", "version", "receipts"])

    return models.select("doc_id", "model").groupBy("doc_id").cogroup(edits.select("doc_id", "batch", "ops").groupBy("doc_id")).applyInPandas(run, "doc_id long, model string, version long, receipts string")
