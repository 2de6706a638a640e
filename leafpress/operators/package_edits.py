"""Edits that reach the package: native operations on a document's own parts, written back byte for byte but for them.

Paragraphs are named by their number in document order when a batch begins (docx.blocks' block_ix);
paragraphs that a batch makes get the next numbers. Tables are named the same way. Offsets are UTF-16
code units of a paragraph's text as docx.segments has it. A batch is atomic: what can't be done
raises Refused, and the package stays as it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.functions.text import OBJECT
from leafpress.operators import folding
from leafpress.operators.folding import Refused
from leafpress.sources import docx, zipio
from leafpress.sources.docx import CONTENT_TYPES, MAIN, SEGMENTS, W_STRICT, ZERO_WIDTH, R, W
from leafpress.sources.markup import BadEdit, Element, Tree, fragment

# The order that the schema wants of properties.
ORDERS = {
    "rPr": "rStyle rFonts b bCs i iCs caps smallCaps strike dstrike outline shadow emboss imprint noProof snapToGrid vanish webHidden color spacing w kern position sz szCs highlight u effect bdr shd fitText vertAlign rtl cs em lang eastAsianLayout specVanish oMath rPrChange",
    "pPr": "pStyle keepNext keepLines pageBreakBefore framePr widowControl numPr suppressLineNumbers pBdr shd tabs suppressAutoHyphens kinsoku wordWrap overflowPunct topLinePunct autoSpaceDE autoSpaceDN bidi adjustRightInd snapToGrid spacing ind contextualSpacing mirrorIndents suppressOverlap jc textDirection textAlignment textboxTightWrap outlineLvl divId cnfStyle rPr sectPr pPrChange",
    "tblPr": "tblStyle tblpPr tblOverlap bidiVisual tblStyleRowBandSize tblStyleColBandSize tblW jc tblCellSpacing tblInd tblBorders shd tblLayout tblCellMar tblLook tblCaption tblDescription tblPrChange",
    "trPr": "cnfStyle divId gridBefore gridAfter wBefore wAfter cantSplit trHeight tblHeader tblCellSpacing jc hidden ins del trPrChange",
    "tcPr": "cnfStyle tcW gridSpan hMerge vMerge tcBorders shd noWrap tcMar textDirection tcFitText vAlign hideMark headers cellIns cellDel cellMerge tcPrChange",
    "sectPr": "headerReference footerReference footnotePr endnotePr type pgSz pgMar paperSrc pgBorders lnNumType pgNumType cols formProt vAlign noEndnote titlePg textDirection bidi rtlGutter docGrid printerSettings sectPrChange",
}
_STYLE = {"rPr": "rStyle", "pPr": "pStyle", "tblPr": "tblStyle"}
_WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml."
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"

OPERATIONS: dict[str, Callable[[Package, dict], None]] = {}


def operation(*names: str) -> Callable:
    def add(f):
        OPERATIONS.update(dict.fromkeys(names, f))
        return f

    return add


def units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def _cut(text: str, a: int, b: int | None = None) -> str:
    return folding._cut(text, a, b)


def is_word(e: Element) -> bool:
    return e.name()[0] in (W, W_STRICT)


def live(e: Element) -> Iterator[Element]:
    """Children as a reader that knows no extensions sees them: of alternate content, the fallback's."""
    for c in e:
        if c.local == "AlternateContent":
            for f in c:
                if f.local == "Fallback":
                    yield from live(f)
        else:
            yield c


def live_walk(e: Element) -> Iterator[Element]:
    for c in live(e):
        yield c
        yield from live_walk(c)


def kid(e: Element, local: str) -> Element | None:
    return next((c for c in e if c.local == local), None)


class Package:
    """A package's bytes and the trees of the parts that were looked at."""

    def __init__(self, content: bytes):
        self.content = content
        self.entries = {e.name: e for e in zipio.directory(content)}
        self.names = {n.lower(): n for n in self.entries}
        self.trees: dict[str, Tree] = {}
        self.new: dict[str, bytes | None] = {}
        rels = self.tree("_rels/.rels")
        main = next((r for r in rels.root if r.attrs.get("Type", "").endswith("/officeDocument")), None) if rels else None
        self.main = (main.attrs["Target"].lstrip("/") if main is not None else "word/document.xml")
        doc = self.tree(self.main)
        if doc is None:
            raise Refused("no main part")
        self.root = doc.root
        self.prefix = next((p for p, u in self.root.scope().items() if u in (W, W_STRICT) and p), None)
        self.space = W_STRICT if W_STRICT in self.root.scope().values() else W
        if self.prefix is None:
            self.prefix = "w"
            self.root.set_attr("xmlns:w", self.space)
            self.root.changed = self.root.retagged = True
        self.paras = [e for e in live_walk(self.root) if e.local == "p" and is_word(e)]
        self.tables = [e for e in live_walk(self.root) if e.local == "tbl" and is_word(e)]
        self.track: str | None = None
        self._last = max([0, *(int(v) for e in self.root.walk() for k, v in e.attrs.items() if k == f"{self.prefix}:id" and v.lstrip("-").isdigit())])

    # --- parts

    def bytes(self, name: str) -> bytes | None:
        name = self.names.get(name.lower(), name)
        if name in self.new:
            return self.new[name]
        return zipio.read(self.content, self.entries[name]) if name in self.entries else None

    def tree(self, name: str, make: str | None = None) -> Tree | None:
        name = self.names.get(name.lower(), name)
        if name not in self.trees:
            data = self.bytes(name)
            if data is None and make is None:
                return None
            self.trees[name] = Tree(data if data is not None else make.encode())
            if data is None:
                self.new[name] = make.encode()
                self.names[name.lower()] = name
        return self.trees[name]

    def relate(self, kind: str, target: str, mode: str | None = None) -> str:
        """Id of a new relationship of the main part; target is a part's name, or an address if mode is External."""
        folder, _, own = self.main.rpartition("/")
        rels = self.tree(f"{folder}/_rels/{own}.rels".lstrip("/"), f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_REL}"/>').root
        taken = {r.attrs.get("Id") for r in rels}
        rid = next(f"rId{i}" for i in range(1, len(taken) + 2) if f"rId{i}" not in taken)
        attrs = {"Id": rid, "Type": f"{R}/{kind}", "Target": target if mode else "/" + target}
        rels.append(Element("Relationship", attrs | ({"TargetMode": mode} if mode else {})))
        return rid

    def related(self, rid: str) -> Element | None:
        folder, _, own = self.main.rpartition("/")
        rels = self.tree(f"{folder}/_rels/{own}.rels".lstrip("/"))
        return next((r for r in rels.root if r.attrs.get("Id") == rid), None) if rels else None

    def target(self, rel: Element) -> str:
        t = rel.attrs["Target"]
        if t.startswith("/"):
            return t[1:]
        steps: list[str] = []
        for s in [*self.main.split("/")[:-1], *t.split("/")]:
            if s == "..":
                steps = steps[:-1]
            elif s not in ("", "."):
                steps.append(s)
        return "/".join(steps)

    def declare(self, name: str, content_type: str) -> None:
        types = self.tree(CONTENT_TYPES).root
        if not any(o.attrs.get("PartName", "").lower() == "/" + name.lower() for o in types):
            types.append(Element("Override", {"PartName": "/" + name, "ContentType": content_type}))

    def side(self, kind: str, tag: str) -> Element:
        """Root of the main part's styles, numbering, settings, comments or notes; made if there is none."""
        folder, _, own = self.main.rpartition("/")
        rels = self.tree(f"{folder}/_rels/{own}.rels".lstrip("/"))
        rel = next((r for r in rels.root if r.attrs.get("Type", "").endswith("/" + kind)), None) if rels else None
        if rel is not None and self.bytes(self.target(rel)) is not None:
            return self.tree(self.target(rel)).root
        name = f"{folder}/{kind}.xml".lstrip("/")
        root = self.tree(name, f'<?xml version="1.0" encoding="UTF-8"?><w:{tag} xmlns:w="{self.space}"/>').root
        self.relate(kind, name)
        self.declare(name, f"{_WORD}{kind}+xml")
        return root

    def save(self) -> bytes:
        changed = {n: d for n, d in self.new.items()}
        for n, t in self.trees.items():
            if t.root.changed and changed.get(n, b"") is not None:
                data = t.dump()
                if n in self.new or data != t.data:
                    changed[n] = data
        return zipio.rewrite(self.content, changed)

    # --- elements

    def w(self, local: str, _children=(), _text: str = "", **attrs) -> Element:
        return Element(f"{self.prefix}:{local}", {f"{self.prefix}:{k}": str(v) for k, v in attrs.items()}, list(_children), _text)

    def val(self, e: Element | None, name: str = "val") -> str | None:
        return None if e is None else e.attrs.get(f"{e.tag.rpartition(':')[0]}:{name}" if ":" in e.tag else name, e.attrs.get(f"{self.prefix}:{name}"))

    def t(self, text: str, local: str = "t") -> Element:
        e = self.w(local, (), text)
        e.attrs["xml:space"] = "preserve"
        return e

    def mark(self, local: str, **more) -> Element:
        self._last += 1
        return self.w(local, id=self._last, author=self.track or "", **more)

    def next_id(self) -> int:
        self._last += 1
        return self._last

    def para(self, n: int) -> Element:
        if not isinstance(n, int) or not 0 <= n < len(self.paras) or self.paras[n].parent is None:
            raise Refused(f"no paragraph {n}")
        return self.paras[n]

    def table(self, n: int) -> Element:
        if not isinstance(n, int) or not 0 <= n < len(self.tables) or self.tables[n].parent is None:
            raise Refused(f"no table {n}")
        return self.tables[n]

    def paragraph(self, spec: dict) -> Element:
        p = self.w("p")
        if spec.get("text"):
            p.append(self.w("r", [self.t(spec["text"])]))
        patch(self, p, "pPr", spec.get("props") or {})
        self.paras.append(p)
        return p

    # --- text

    def runs(self, e: Element) -> Iterator[Element]:
        for c in live(e):
            if c.local == "r":
                yield c
            elif c.local != "p":
                yield from self.runs(c)

    def pieces(self, p: Element) -> list[tuple[Element, Element, str]]:
        """(run, piece, its text) of a paragraph."""
        out = []
        for run in self.runs(p):
            for c in live(run):
                if c.local in ("t", "delText"):
                    out.append((run, c, c.text if c.attrs.get("xml:space") == "preserve" else c.text.strip(" \t\r\n")))
                elif c.local == "br":
                    out.append((run, c, OBJECT if self.val(c, "type") in ("page", "column") else "\n"))
                elif c.local == "sym":
                    out.append((run, c, chr(0xF000 + int(self.val(c, "char") or "0", 16) % 256)))
                elif c.local in ZERO_WIDTH:
                    out.append((run, c, ""))
                elif c.local in SEGMENTS:
                    out.append((run, c, SEGMENTS[c.local]))
        return out

    def text(self, p: Element) -> str:
        return "".join(x for _, _, x in self.pieces(p))

    def rewrite(self, piece: Element, text: str) -> None:
        piece.set_text(text)
        piece.set_attr("xml:space", "preserve")

    def cut(self, p: Element, at: int) -> tuple[Element, int]:
        """A place between runs at an offset, as (parent, place); a run that the offset falls into is split."""
        upto, last = 0, None
        for run, piece, text in self.pieces(p):
            n = units(text)
            if n and upto < at < upto + n:
                if piece.local not in ("t", "delText"):
                    raise Refused("offset inside a character")
                left, right = _cut(text, 0, at - upto), _cut(text, at - upto)
                self.rewrite(piece, left)
                more = piece.clone()
                self.rewrite(more, right)
                piece.parent.insert(piece.index() + 1, more)
                return self._split(run, more)
            if n and at == upto:
                return self._split(run, piece)
            upto, last = upto + n, run
        if at != upto:
            raise Refused("offset out of range")
        if last is not None:
            return last.parent, last.index() + 1
        props = kid(p, "pPr")
        return p, props.index() + 1 if props is not None else 0

    def _split(self, run: Element, piece: Element) -> tuple[Element, int]:
        at = piece.index()
        if piece.parent is not run:
            raise Refused("inside alternate content")
        if not any(isinstance(c, Element) and c.local != "rPr" for c in run.children[:at]):
            return run.parent, run.index()
        props = kid(run, "rPr")
        right = Element(run.tag, run.attrs, [props.clone()] if props is not None else [])
        for c in run.children[at:]:
            if isinstance(c, Element):
                right.append(c.detach())
        run.parent.insert(run.index() + 1, right)
        return run.parent, run.index() + 1

    def span(self, op: dict) -> tuple[Element, int, int]:
        if op["from"]["para"] != op["to"]["para"] or op["from"]["offset"] > op["to"]["offset"]:
            raise Refused("a range lies in one paragraph, forwards")
        p = self.para(op["from"]["para"])
        text = self.text(p)
        if not 0 <= op["from"]["offset"] <= op["to"]["offset"] <= units(text):
            raise Refused("offset out of range")
        for x in ("from", "to"):
            _cut(text, 0, op[x]["offset"])  # refused inside a character
        if any(kid(e, "sdtPr") is not None and any(c.local == "lock" and self.val(c) in ("contentLocked", "sdtContentLocked") for c in kid(e, "sdtPr")) for e in p.up() if e.local == "sdt"):
            raise Refused("protected content")
        return p, op["from"]["offset"], op["to"]["offset"]

    def within(self, p: Element, lo: int, hi: int) -> list[Element]:
        """The runs that make up [lo, hi), after cuts at both ends."""
        self.cut(p, lo)
        self.cut(p, hi)
        out, upto = [], 0
        for run in self.runs(p):
            n = sum(units(x) for r, _, x in self.pieces(p) if r is run)
            if n and lo <= upto and upto + n <= hi:
                out.append(run)
            upto += n
        return out

    def put(self, p: Element, at: int, text: str, props: dict | None = None, like: Element | None = None) -> None:
        if not text:
            return
        if like is None and not props and not self.track:
            upto = 0
            found = None
            for _, piece, own in self.pieces(p):
                n = units(own)
                if piece.local == "t" and n and (upto < at <= upto + n or at == 0 == upto):
                    found = (piece, own, at - upto)
                    break
                upto += n
            if found:
                piece, own, inner = found
                self.rewrite(piece, _cut(own, 0, inner) + text + _cut(own, inner))
                return
        if like is None:
            upto = 0
            for run, _, own in self.pieces(p):
                upto += units(own)
                like = run
                if upto >= at:
                    break
        parent, place = self.cut(p, at)
        while parent.local in ("del", "moveFrom"):  # what is new doesn't go with what was deleted
            parent, place = parent.parent, parent.index() + (place > 0)
        old = kid(like, "rPr") if like is not None else None
        run = self.w("r", [*([old.clone()] if old is not None else []), self.t(text)])
        patch(self, run, "rPr", props or {})
        if self.track:
            run = self.mark("ins", date="1970-01-01T00:00:00Z")
            run.append(self.w("r", [*([old.clone()] if old is not None else []), self.t(text)]))
            patch(self, kid(run, "r"), "rPr", props or {})
        parent.insert(place, run)

    def take(self, p: Element, lo: int, hi: int) -> None:
        if self.track:
            for run in self.within(p, lo, hi):
                if run.parent.local == "del":
                    continue
                for c in [c for c in run if c.local == "t"]:
                    c.rename(f"{self.prefix}:delText")
                parent, place = run.parent, run.index()
                wrap = self.mark("del", date="1970-01-01T00:00:00Z")
                wrap.append(run.detach())
                parent.insert(place, wrap)
            return
        upto = 0
        for run, piece, text in self.pieces(p):
            a, b = max(lo, upto), min(hi, upto + units(text))
            if a < b:
                if a == upto and b == upto + units(text):
                    piece.detach()
                    if run.parent is not None and all(c.local == "rPr" for c in run):
                        run.detach()
                elif piece.local in ("t", "delText"):
                    self.rewrite(piece, _cut(text, 0, a - upto) + _cut(text, b - upto))
            upto += units(text)


# --- properties --------------------------------------------------------------------------------------


def place(props: Element, child: Element) -> None:
    """Put a property where the schema wants it."""
    order = ORDERS.get(props.local, "").split()
    rank = order.index(child.local) if child.local in order else len(order)
    for c in props:
        if (order.index(c.local) if c.local in order else len(order)) > rank:
            props.insert(c.index(), child)
            return
    props.append(child)


def reorder(props: Element) -> bool:
    """Put all properties in the schema's order; False if they stood so."""
    order = ORDERS.get(props.local, "").split()
    own = list(props)
    want = sorted(own, key=lambda c: order.index(c.local) if c.local in order else len(order))
    if all(a is b for a, b in zip(own, want)):
        return False
    for c in own:
        c.detach()
    for c in want:
        props.append(c)
    return True


def patch(pkg: Package, owner: Element, kind: str, values: dict) -> None:
    """Absent keeps, null takes out, true and false switch, a value sets, an object sets attributes."""
    if not values:
        return
    props = owner if owner.local == kind else kid(owner, kind)
    if props is None:
        props = pkg.w(kind)
        before = kid(owner, "tblPrEx") if kind == "trPr" else None
        owner.insert(before.index() + 1 if before is not None else 0, props)
    for key, value in values.items():
        local = _STYLE.get(kind, key) if key == "style" else key
        old = kid(props, local)
        if isinstance(value, dict) and old is not None:
            for k, v in value.items():
                old.set_attr(f"{pkg.prefix}:{k}", None if v is None else str(v))
            continue
        if old is not None:
            old.detach()
        if value is None:
            continue
        if isinstance(value, dict):
            new = pkg.w(local, **{k: v for k, v in value.items() if v is not None})
        elif isinstance(value, bool):
            new = pkg.w(local) if value else pkg.w(local, val="0")
        else:
            new = pkg.w(local, val=value)
        place(props, new)


# --- text operations ---------------------------------------------------------------------------------


@operation("insertText")
def _(pkg, op):
    p = pkg.para(op["at"]["para"])
    if not 0 <= op["at"]["offset"] <= units(pkg.text(p)):
        raise Refused("offset out of range")
    pkg.put(p, op["at"]["offset"], op["text"], op.get("props"))


@operation("replaceText")
def _(pkg, op):
    p, lo, hi = pkg.span(op)
    if pkg.track:
        pkg.take(p, lo, hi)
        pkg.put(p, hi, op["text"])
        return
    upto = 0
    for _run, piece, own in pkg.pieces(p):  # inside one text no run needs to be cut
        n = units(own)
        if piece.local == "t" and upto <= lo and upto < hi <= upto + n:
            pkg.rewrite(piece, _cut(own, 0, lo - upto) + op["text"] + _cut(own, hi - upto))
            return
        upto += n
    like = next(iter(pkg.within(p, lo, hi)), None) if hi > lo else None
    pkg.put(p, lo, op["text"], like=like)
    n = units(op["text"])
    pkg.take(p, lo + n, hi + n)


@operation("deleteRange")
def _(pkg, op):
    pkg.take(*pkg.span(op))


@operation("setRunProps")
def _(pkg, op):
    p, lo, hi = pkg.span(op)
    for run in pkg.within(p, lo, hi):
        patch(pkg, run, "rPr", op["patch"])


@operation("replaceInlines")
def _(pkg, op):
    p = pkg.para(op["para"])
    for c in [c for c in p if c.local != "pPr"]:
        c.detach()
    for x in op["inlines"]:
        run = pkg.w("r", [pkg.t(x["text"])])
        patch(pkg, run, "rPr", x.get("props") or {})
        p.append(run)


@operation("setParaProps")
def _(pkg, op):
    patch(pkg, pkg.para(op["para"]), "pPr", op["patch"])


@operation("replaceParaProps")
def _(pkg, op):
    p = pkg.para(op["para"])
    old = kid(p, "pPr")
    kept = kid(old, "sectPr") if old is not None else None  # a section's end isn't the paragraph's own
    if old is not None:
        old.detach()
    patch(pkg, p, "pPr", op["props"])
    if kept is not None:
        if kid(p, "pPr") is None:
            p.insert(0, pkg.w("pPr"))
        place(kid(p, "pPr"), kept.detach())


@operation("splitParagraph")
def _(pkg, op):
    p = pkg.para(op["at"]["para"])
    parent, at = pkg.cut(p, op["at"]["offset"])
    if parent is not p:
        raise Refused("a paragraph can't be split inside a link, control or revision")
    new = Element(p.tag, {})
    props = kid(p, "pPr")
    if props is not None:
        copy = props.clone()
        new.append(copy)
        if kid(props, "sectPr") is not None:  # the section ends with the second half
            kid(props, "sectPr").detach()
    for c in p.children[at:]:
        if isinstance(c, Element):
            new.append(c.detach())
    p.parent.insert(p.index() + 1, new)
    pkg.paras.append(new)


def _following(e: Element) -> Element | None:
    own = list(e.parent)
    at = next(i for i, c in enumerate(own) if c is e)
    return own[at + 1] if at + 1 < len(own) else None


@operation("mergeWithNext")
def _(pkg, op):
    p = pkg.para(op["para"])
    _merge(p)


def _merge(p: Element) -> None:
    other = _following(p)
    if other is None or other.local != "p":
        raise Refused("no paragraph follows")
    for c in list(other):
        if c.local != "pPr":
            p.append(c.detach())
    other.detach()


@operation("insertAtom")
def _(pkg, op):
    p, kind = pkg.para(op["at"]["para"]), op["atom"]["kind"]
    made = {"tab": ("tab", {}), "break": ("br", {}), "pageBreak": ("br", {"type": "page"}), "columnBreak": ("br", {"type": "column"}), "noBreakHyphen": ("noBreakHyphen", {}), "softHyphen": ("softHyphen", {})}
    if kind in ("footnote", "endnote"):
        notes = pkg.side(f"{kind}s", f"{kind}s")
        nid = max([0, *(int(pkg.val(n, "id") or 0) for n in notes)]) + 1
        notes.append(pkg.w(kind, [pkg.w("p", [pkg.w("r", [pkg.t(op["atom"].get("text", ""))])])], id=nid))
        atom = pkg.w(f"{kind}Reference", id=nid)
    elif kind in made:
        atom = pkg.w(made[kind][0], **made[kind][1])
    else:
        raise Refused(f"no atom {kind}")
    parent, at = pkg.cut(p, op["at"]["offset"])
    parent.insert(at, pkg.w("r", [atom]))


# --- blocks and tables -------------------------------------------------------------------------------


def _node(pkg: Package, op: dict) -> Element:
    return pkg.table(op["table"]) if "table" in op else pkg.para(op["node"])


@operation("insertBlock")
def _(pkg, op):
    where = op["at"]
    side = next(k for k in ("after", "before", "tableAfter", "tableBefore") if k in where)
    beside = pkg.table(where[side]) if side.startswith("table") else pkg.para(where[side])
    new = pkg.paragraph(op["block"])
    beside.parent.insert(beside.index() + (side.lower().endswith("after")), new)


@operation("deleteBlock")
def _(pkg, op):
    e = _node(pkg, op)
    if e.parent.local == "tc" and sum(c.local == "p" for c in e.parent) == 1:
        raise Refused("a cell keeps a paragraph")
    if kid(e, "pPr") is not None and kid(kid(e, "pPr"), "sectPr") is not None:
        raise Refused("the paragraph ends a section")
    e.detach()


@operation("moveBlock")
def _(pkg, op):
    e = _node(pkg, op)
    side = next(k for k in ("after", "before") if k in op["to"])
    beside = pkg.para(op["to"][side])
    if e.parent.local == "tc" and sum(c.local == "p" for c in e.parent) == 1:
        raise Refused("a cell keeps a paragraph")
    try:
        e.move(beside.parent, beside.index() + (side == "after"))
    except BadEdit as why:
        raise Refused(str(why)) from None


@operation("setTableProps")
def _(pkg, op):
    patch(pkg, pkg.table(op["table"]), "tblPr", op["patch"])


def rows(table: Element) -> list[Element]:
    return [c for c in table if c.local == "tr"]


def cells(row: Element) -> list[Element]:
    return [c for c in row if c.local == "tc"]


def _one(own: list[Element], at: int, what: str) -> Element:
    if not isinstance(at, int) or not 0 <= at < len(own):
        raise Refused(f"no {what} {at}")
    return own[at]


@operation("setRowProps")
def _(pkg, op):
    patch(pkg, _one(rows(pkg.table(op["table"])), op["row"], "row"), "trPr", op["patch"])


@operation("setCellProps")
def _(pkg, op):
    patch(pkg, _one(cells(_one(rows(pkg.table(op["table"])), op["row"], "row")), op["cell"], "cell"), "tcPr", op["patch"])


def _cell_prop(pkg: Package, cell: Element, name: str) -> Element | None:
    props = kid(cell, "tcPr")
    return kid(props, name) if props is not None else None


def _width(pkg: Package, cell: Element) -> int:
    return int(pkg.val(_cell_prop(pkg, cell, "gridSpan")) or 1)


def _merged(pkg: Package, cell: Element) -> str | None:
    m = _cell_prop(pkg, cell, "vMerge")
    return None if m is None else pkg.val(m) or "continue"


def _blank(pkg: Package, like: Element | None = None) -> Element:
    old = kid(like, "tcPr") if like is not None else None
    cell = pkg.w("tc", [old.clone()] if old is not None else [])
    cell.append(pkg.paragraph({}))
    return cell


@operation("insertRow")
def _(pkg, op):
    table = pkg.table(op["table"])
    own = rows(table)
    if not 0 <= op["at"] <= len(own) or not own:
        raise Refused("row out of range")
    like = own[min(op["at"], len(own) - 1)]
    new = pkg.w("tr", [_blank(pkg, c) for c in cells(like)])
    through = cells(own[op["at"]]) if 0 < op["at"] < len(own) else []
    for i, c in enumerate(cells(new)):  # a merge that runs through the new row goes on in it
        goes_on = i < len(through) and _merged(pkg, through[i]) == "continue"
        if _cell_prop(pkg, c, "vMerge") is not None or goes_on:
            patch(pkg, c, "tcPr", {"vMerge": True if goes_on else None})
    if op["at"] < len(own):
        table.insert(own[op["at"]].index(), new)
    else:
        table.insert(own[-1].index() + 1, new)


@operation("deleteRow")
def _(pkg, op):
    own = rows(pkg.table(op["table"]))
    gone = _one(own, op["at"], "row")
    if len(own) == 1:
        raise Refused("the last row stays")
    if op["at"] + 1 < len(own):
        for a, b in zip(cells(gone), cells(own[op["at"] + 1])):
            if _merged(pkg, a) == "restart" and _merged(pkg, b) == "continue":
                patch(pkg, b, "tcPr", {"vMerge": None})
                patch(pkg, b, "tcPr", {"vMerge": "restart"})
    gone.detach()


def _grid(table: Element) -> Element | None:
    return kid(table, "tblGrid")


@operation("insertColumn")
def _(pkg, op):
    table = pkg.table(op["table"])
    grid = _grid(table)
    n = max(sum(_width(pkg, c) for c in cells(r)) for r in rows(table))
    if not 0 <= op["at"] <= n:
        raise Refused("column out of range")
    if grid is not None:
        own = [c for c in grid if c.local == "gridCol"]
        new = pkg.w("gridCol", w=op.get("width", 1))
        grid.insert(own[op["at"]].index() if op["at"] < len(own) else len(grid.children), new)
    for r in rows(table):
        col, own = 0, cells(r)
        for c in own:
            if col >= op["at"]:
                r.insert(c.index(), _blank(pkg))
                break
            if op["at"] < col + _width(pkg, c):
                patch(pkg, c, "tcPr", {"gridSpan": _width(pkg, c) + 1} if _cell_prop(pkg, c, "gridSpan") is None else {"gridSpan": {"val": _width(pkg, c) + 1}})
                break
            col += _width(pkg, c)
        else:
            r.append(_blank(pkg))


@operation("deleteColumn")
def _(pkg, op):
    table = pkg.table(op["table"])
    grid = _grid(table)
    n = max(sum(_width(pkg, c) for c in cells(r)) for r in rows(table))
    if not 0 <= op["at"] < n or n == 1:
        raise Refused("no such column, or the last one")
    if grid is not None:
        own = [c for c in grid if c.local == "gridCol"]
        if op["at"] < len(own):
            own[op["at"]].detach()
    for r in rows(table):
        col = 0
        for c in cells(r):
            if col <= op["at"] < col + _width(pkg, c):
                if _width(pkg, c) > 1:
                    patch(pkg, c, "tcPr", {"gridSpan": {"val": _width(pkg, c) - 1}})
                else:
                    c.detach()
                break
            col += _width(pkg, c)


@operation("mergeCells")
def _(pkg, op):
    own = rows(pkg.table(op["table"]))
    (r0, c0), (r1, c1) = op["from"], op["to"]
    if not 0 <= r0 <= r1 < len(own):
        raise Refused("rows out of range")
    for r in range(r0, r1 + 1):
        here = cells(own[r])
        if not 0 <= c0 <= c1 < len(here):
            raise Refused("cells out of range")
        first, width = here[c0], sum(_width(pkg, c) for c in here[c0 : c1 + 1])
        for c in here[c0 + 1 : c1 + 1]:
            for b in [b for b in c if b.local != "tcPr" and (b.local != "p" or pkg.text(b))]:
                first.append(b.detach())
            c.detach()
        patch(pkg, first, "tcPr", {"gridSpan": None})
        patch(pkg, first, "tcPr", {"gridSpan": width if width > 1 else None, "vMerge": None})
        if r1 > r0:
            patch(pkg, first, "tcPr", {"vMerge": "restart" if r == r0 else True})


# --- ranges, fields, notes, controls -------------------------------------------------------------------


def _around(pkg: Package, p: Element, lo: int, hi: int, start: Element, end: Element) -> None:
    parent, at = pkg.cut(p, hi)
    parent.insert(at, end)
    parent, at = pkg.cut(p, lo)
    parent.insert(at, start)


@operation("addComment")
def _(pkg, op):
    p, lo, hi = pkg.span(op)
    comments = pkg.side("comments", "comments")
    cid = max([-1, *(int(pkg.val(c, "id") or 0) for c in comments)]) + 1
    body = [pkg.w("p", [pkg.w("r", [pkg.t(x)])]) for x in op["comment"]["text"].split("\n")]
    comments.append(pkg.w("comment", body, id=cid, author=op["comment"].get("author", "")))
    end = pkg.w("commentRangeEnd", id=cid)
    _around(pkg, p, lo, hi, pkg.w("commentRangeStart", id=cid), end)
    end.parent.insert(end.index() + 1, pkg.w("r", [pkg.w("commentReference", id=cid)]))


def _by_id(pkg: Package, root: Element, local: str, key) -> Element:
    e = next((c for c in root.walk() if c.local == local and pkg.val(c, "id") == str(key)), None)
    if e is None:
        raise Refused(f"no {local} {key}")
    return e


@operation("removeComment")
def _(pkg, op):
    _by_id(pkg, pkg.side("comments", "comments"), "comment", op["id"]).detach()
    for e in [e for e in pkg.root.walk() if e.local in ("commentRangeStart", "commentRangeEnd", "commentReference") and pkg.val(e, "id") == str(op["id"])]:
        run = e.parent
        e.detach()
        if run.local == "r" and all(c.local == "rPr" for c in run):
            run.detach()


@operation("setCommentText")
def _(pkg, op):
    c = _by_id(pkg, pkg.side("comments", "comments"), "comment", op["id"])
    _fill(pkg, c, op["text"])


def _fill(pkg: Package, holder: Element, text: str) -> None:
    for b in list(holder):
        b.detach()
    for line in text.split("\n"):
        holder.append(pkg.w("p", [pkg.w("r", [pkg.t(line)])]))


@operation("setNoteContent")
def _(pkg, op):
    kind = op["kind"]
    _fill(pkg, _by_id(pkg, pkg.side(f"{kind}s", f"{kind}s"), kind, op["id"]), op["text"])


@operation("removeNote")
def _(pkg, op):
    kind = op["kind"]
    _by_id(pkg, pkg.side(f"{kind}s", f"{kind}s"), kind, op["id"]).detach()
    for e in [e for e in pkg.root.walk() if e.local == f"{kind}Reference" and pkg.val(e, "id") == str(op["id"])]:
        e.detach()


@operation("addBookmark")
def _(pkg, op):
    if any(e.local == "bookmarkStart" and pkg.val(e, "name") == op["name"] for e in pkg.root.walk()):
        raise Refused("the name is taken")
    p, lo, hi = pkg.span(op)
    key = pkg.next_id()
    _around(pkg, p, lo, hi, pkg.w("bookmarkStart", id=key, name=op["name"]), pkg.w("bookmarkEnd", id=key))


@operation("removeBookmark")
def _(pkg, op):
    start = next((e for e in pkg.root.walk() if e.local == "bookmarkStart" and pkg.val(e, "name") == op["name"]), None)
    if start is None:
        raise Refused(f"no bookmark {op['name']}")
    end = next((e for e in pkg.root.walk() if e.local == "bookmarkEnd" and pkg.val(e, "id") == pkg.val(start, "id")), None)
    for e in (start, end):
        if e is not None:
            e.detach()


@operation("insertField")
def _(pkg, op):
    p = pkg.para(op["at"]["para"])
    parent, at = pkg.cut(p, op["at"]["offset"])
    char = lambda kind: pkg.w("r", [pkg.w("fldChar", fldCharType=kind)])
    made = [char("begin"), pkg.w("r", [pkg.t(op["instr"], "instrText")]), char("separate"), *([pkg.w("r", [pkg.t(op["result"])])] if op.get("result") else []), char("end")]
    for i, e in enumerate(made):
        parent.insert(at + i, e)


@operation("setLinkTarget")
def _(pkg, op):
    links = [e for e in live_walk(pkg.para(op["para"])) if e.local == "hyperlink"]
    link = _one(links, op.get("nth", 0), "link")
    rid = next((k for k in link.attrs if k.endswith(":id")), None)
    if "anchor" in op:
        if rid:
            link.set_attr(rid, None)
        link.set_attr(f"{pkg.prefix}:anchor", op["anchor"])
        return
    if "r" not in link.scope():
        pkg.root.set_attr("xmlns:r", R)
    link.set_attr(rid or "r:id", pkg.relate("hyperlink", op["url"], "External"))


def _control(pkg: Package, op: dict) -> Element:
    return _one([e for e in live_walk(pkg.root) if e.local == "sdt"], op["sdt"], "control")


@operation("toggleCheckbox")
def _(pkg, op):
    sdt = _control(pkg, op)
    checked = next((e for e in kid(sdt, "sdtPr").walk() if e.local == "checked"), None)
    if checked is None:
        raise Refused("no checkbox")
    key = next((k for k in checked.attrs if k.endswith(":val")), f"{checked.tag.rpartition(':')[0]}:val")
    on = checked.attrs.get(key) not in ("1", "true")
    checked.set_attr(key, "1" if on else "0")
    shown = next((e for e in kid(sdt, "sdtContent").walk() if e.local == "t"), None)
    if shown is not None:
        pkg.rewrite(shown, "☒" if on else "☐")


@operation("setSdtContent", "setFormText")
def _(pkg, op):
    content = kid(_control(pkg, op), "sdtContent")
    texts = [e for e in live_walk(content) if e.local == "t"]
    if not texts:
        raise Refused("no text to set")
    pkg.rewrite(texts[0], op["text"])
    for e in texts[1:]:
        e.detach()


@operation("removeSdtShell")
def _(pkg, op):
    _unwrap(_control(pkg, op), kid(_control(pkg, op), "sdtContent"))


def _unwrap(e: Element, content: Element | None = None) -> None:
    parent, at = e.parent, e.index()
    inner = [c.detach() for c in list(content if content is not None else e)]
    e.detach()
    for i, c in enumerate(inner):
        parent.insert(at + i, c)


# --- declarations --------------------------------------------------------------------------------------


@operation("upsertStyle")
def _(pkg, op):
    spec, styles = op["style"], pkg.side("styles", "styles")
    e = next((c for c in styles if c.local == "style" and pkg.val(c, "styleId") == spec["id"]), None)
    if e is None:
        e = pkg.w("style", [pkg.w("name", val=spec.get("name", spec["id"]))], type=spec.get("kind", "paragraph"), styleId=spec["id"])
        styles.append(e)
    for key, local in (("name", "name"), ("basedOn", "basedOn"), ("next", "next"), ("link", "link")):
        if key in spec:
            old = kid(e, local)
            if old is not None:
                old.set_attr(f"{old.tag.rpartition(':')[0]}:val", spec[key])
            else:
                e.insert(1, pkg.w(local, val=spec[key]))
    for key, local in (("para", "pPr"), ("run", "rPr")):
        if spec.get(key):
            if kid(e, local) is None:
                e.append(pkg.w(local))
            patch(pkg, e, local, spec[key])


@operation("addNumberingDefinition")
def _(pkg, op):
    root = pkg.side("numbering", "numbering")
    abstract = max([-1, *(int(pkg.val(c, "abstractNumId")) for c in root if c.local == "abstractNum")]) + 1
    num = max([0, *(int(pkg.val(c, "numId")) for c in root if c.local == "num")]) + 1
    levels = [pkg.w("lvl", [pkg.w("start", val=x.get("start", 1)), pkg.w("numFmt", val=x.get("format", "decimal")), pkg.w("lvlText", val=x.get("text", f"%{i + 1}."))], ilvl=i) for i, x in enumerate(op["levels"])]
    first = next((c for c in root if c.local == "num"), None)
    root.insert(first.index() if first is not None else len(root.children), pkg.w("abstractNum", levels, abstractNumId=abstract))
    root.append(pkg.w("num", [pkg.w("abstractNumId", val=abstract)], numId=num))


@operation("restartNumbering")
def _(pkg, op):
    p = pkg.para(op["para"])
    props = kid(p, "pPr")
    num = kid(kid(props, "numPr"), "numId") if props is not None and kid(props, "numPr") is not None else None
    if num is None:
        raise Refused("the paragraph is not in a list")
    root = pkg.side("numbering", "numbering")
    old = next((c for c in root if c.local == "num" and pkg.val(c, "numId") == pkg.val(num)), None)
    if old is None:
        raise Refused("no such list")
    new = max(int(pkg.val(c, "numId")) for c in root if c.local == "num") + 1
    level = pkg.val(kid(kid(props, "numPr"), "ilvl")) or "0"
    root.append(pkg.w("num", [pkg.w("abstractNumId", val=pkg.val(kid(old, "abstractNumId"))), pkg.w("lvlOverride", [pkg.w("startOverride", val=op.get("start", 1))], ilvl=level)], numId=new))
    num.set_attr(f"{pkg.prefix}:val", str(new))


@operation("setDocumentSettings")
def _(pkg, op):
    patch(pkg, pkg.side("settings", "settings"), "settings", op["patch"])


@operation("setPageColor")
def _(pkg, op):
    old = kid(pkg.root, "background")
    if old is not None:
        old.detach()
    if op.get("color"):
        pkg.root.insert(0, pkg.w("background", color=op["color"].lstrip("#")))


def _section(pkg: Package, n: int) -> Element:
    return _one([e for e in pkg.root.walk() if e.local == "sectPr" and is_word(e) and e.parent.local != "sectPrChange"], n, "section")


@operation("setSectionProps")
def _(pkg, op):
    patch(pkg, _section(pkg, op["sect"]), "sectPr", op["patch"])


@operation("insertSectionBreak")
def _(pkg, op):
    p = pkg.para(op["para"])
    if kid(p, "pPr") is None:
        p.insert(0, pkg.w("pPr"))
    if kid(kid(p, "pPr"), "sectPr") is not None:
        raise Refused("a section ends here")
    later = [e for e in pkg.root.walk() if e.local == "sectPr"]
    new = later[-1].clone() if later else pkg.w("sectPr")
    place(kid(p, "pPr"), new)
    if op.get("type"):
        patch(pkg, new, "sectPr", {"type": None})
        patch(pkg, new, "sectPr", {"type": op["type"]})


@operation("deleteSectionBreak")
def _(pkg, op):
    s = _section(pkg, op["sect"])
    if s.parent.local != "pPr":
        raise Refused("the last section stays")
    s.detach()


@operation("setHeaderFooter")
def _(pkg, op):
    kind, variant, sect = op["kind"], op.get("variant", "default"), _section(pkg, op["sect"])
    ref = next((c for c in sect if c.local == f"{kind}Reference" and pkg.val(c, "type") == variant), None)
    body = [pkg.w("p", [pkg.w("r", [pkg.t(x["text"])])]) for x in op["content"]]
    rid = next((v for k, v in ref.attrs.items() if k.endswith(":id")), None) if ref is not None else None
    rel = pkg.related(rid) if rid else None
    if rel is not None:
        root = pkg.tree(pkg.target(rel)).root
        for c in list(root):
            c.detach()
    else:
        folder = pkg.main.rpartition("/")[0]
        name = next(f"{folder}/{kind}{i}.xml".lstrip("/") for i in range(1, 10_000) if pkg.bytes(f"{folder}/{kind}{i}.xml".lstrip("/")) is None)
        root = pkg.tree(name, f'<?xml version="1.0" encoding="UTF-8"?><w:{"hdr" if kind == "header" else "ftr"} xmlns:w="{pkg.space}"/>').root
        pkg.declare(name, f"{_WORD}{kind}+xml")
        if "r" not in pkg.root.scope():
            pkg.root.set_attr("xmlns:r", R)
        ref = pkg.w(f"{kind}Reference", type=variant)
        ref.attrs["r:id"] = pkg.relate(kind, name)
        place(sect, ref)
    for p in body:
        root.append(p)


@operation("linkHeaderFooter")
def _(pkg, op):
    for c in [c for c in _section(pkg, op["sect"]) if c.local == f"{op['kind']}Reference" and pkg.val(c, "type") == op.get("variant", "default")]:
        c.detach()


def _theme(pkg: Package) -> Element:
    folder, _, own = pkg.main.rpartition("/")
    rels = pkg.tree(f"{folder}/_rels/{own}.rels".lstrip("/"))
    rel = next((r for r in rels.root if r.attrs.get("Type", "").endswith("/theme")), None) if rels else None
    if rel is None:
        raise Refused("no theme")
    return pkg.tree(pkg.target(rel)).root


@operation("setThemeFonts")
def _(pkg, op):
    for e in _theme(pkg).walk():
        if e.local == "latin" and e.parent.local in ("majorFont", "minorFont") and op["patch"].get(e.parent.local.removesuffix("Font")):
            e.set_attr("typeface", op["patch"][e.parent.local.removesuffix("Font")])


@operation("setThemeColors")
def _(pkg, op):
    for e in [e for e in _theme(pkg).walk() if e.parent is not None and e.parent.local == "clrScheme" and e.local in op["patch"]]:
        prefix = e.tag.rpartition(":")[0]
        for c in list(e):
            c.detach()
        e.append(Element(f"{prefix}:srgbClr" if prefix else "srgbClr", {"val": op["patch"][e.local].lstrip("#")}))


# --- parts and revisions -------------------------------------------------------------------------------


@operation("replacePartXml")
def _(pkg, op):
    name = op["part"].lstrip("/")
    if pkg.bytes(name) is None:
        raise Refused(f"no part {op['part']}")
    try:
        made = Tree(op["xml"].encode())
    except expat.ExpatError as why:
        raise Refused(str(why)) from None
    name = pkg.names.get(name.lower(), name)
    if name == pkg.main:
        raise Refused("the main part is edited by operations")
    pkg.trees.pop(name, None)
    pkg.new[name] = made.dump()


@operation("replacePartBytes")
def _(pkg, op):
    import base64

    name = pkg.names.get(op["part"].lstrip("/").lower())
    if name is None or name == pkg.main:
        raise Refused(f"no part {op['part']}")
    pkg.trees.pop(name, None)
    pkg.new[name] = base64.b64decode(op["bytes"])


@operation("setTracking")
def _(pkg, op):
    pkg.track = op.get("author")


def _resolve(pkg: Package, chosen: Callable[[Element], bool], accept: bool) -> int:
    """Accept or reject revisions, the inner ones first. Returns how many there were."""
    found = [e for e in pkg.root.walk() if is_word(e) and chosen(e) and (e.local in ("ins", "del", "moveFrom", "moveTo") or e.local.endswith("Change"))]
    for e in reversed(found):
        if e.parent is None or e.parent.parent is None and e.parent is not pkg.root:
            continue
        if e.local.endswith("Change"):
            if accept:
                e.detach()
                continue
            props, old = e.parent, next(iter(e), None)
            for c in list(props):
                c.detach()
            for c in list(old) if old is not None else ():
                props.append(c.detach())
            continue
        stays = (e.local in ("ins", "moveTo")) == accept
        if e.parent.local == "trPr":
            row = e.parent.parent
            e.detach()
            if not stays and len(rows(row.parent)) > 1:
                row.detach()
        elif e.parent.local == "rPr" and e.parent.parent.local == "pPr":
            p = e.parent.parent.parent
            e.detach()
            if not stays and _following(p) is not None and _following(p).local == "p":
                _merge(p)
        elif stays:
            for c in [c for c in e.walk() if c.local in ("delText", "delInstrText")]:
                c.rename(c.tag.replace("delText", "t").replace("delInstrText", "instrText"))
            _unwrap(e)
        else:
            e.detach()
    return len(found)


@operation("acceptRevision", "rejectRevision")
def _(pkg, op):
    if not _resolve(pkg, lambda e: pkg.val(e, "id") == str(op["rev"]), op["op"] == "acceptRevision"):
        raise Refused(f"no revision {op['rev']}")


@operation("acceptAll", "rejectAll")
def _(pkg, op):
    _resolve(pkg, lambda e: op.get("author") is None or pkg.val(e, "author") == op["author"], op["op"] == "acceptAll")


# --- batches -------------------------------------------------------------------------------------------


def _outline(pkg: Package) -> dict:
    """What agent actions look at: paragraphs with their text, and styles."""
    styles = {pkg.val(c, "styleId"): {} for c in pkg.side("styles", "styles") if c.local == "style"} if any(n.endswith("styles.xml") for n in pkg.entries) else {}
    blocks = [{"id": i, "kind": "text", "text": pkg.text(p)} for i, p in enumerate(pkg.paras) if p.parent is not None]
    return {"blocks": blocks, "styles": styles, "fields": {}}


def edit_package(content: bytes, ops: list[dict]) -> tuple[bytes, int]:
    """The package after all operations and agent actions, and how many ran; Refused leaves it as it is."""
    try:
        pkg = Package(content)
    except (zipio.Broken, expat.ExpatError) as why:
        raise Refused(f"unreadable: {why}") from None
    ran = 0
    for op in ops:
        for native in folding.compile_action(_outline(pkg), op) if "action" in op else [op]:
            if native.get("op") not in OPERATIONS:
                raise Refused(f"unknown operation {native.get('op')}")
            try:
                OPERATIONS[native["op"]](pkg, native)
            except (KeyError, TypeError, StopIteration, AttributeError) as why:
                raise Refused(f"malformed {native['op']}: {why}") from None
            except BadEdit as why:
                raise Refused(str(why)) from None
            ran += 1
    wrong = [w for t in pkg.trees.values() if t.root.changed for w in t.check()]
    if wrong:
        raise Refused("; ".join(wrong[:3]))
    return pkg.save(), ran


def fold_packages(packages: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, content, version, receipts: batches of `edits` (doc_id, batch, ops as JSON) in order over `packages` (doc_id, content).

    Documents are independent. A refused batch leaves a receipt and nothing else; documents without
    edits keep their bytes; edits of unknown documents are left out; null ops count as none; batches of one
    number are in order of their ops. An empty table gives no rows.
    """
    grouped = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("batch", F.coalesce("ops", F.lit("[]")).alias("ops")))).alias("batches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, content, own in zip(*(c.to_pylist() for c in batch.columns)):
                version, receipts = 0, []
                for x in own or ():
                    try:
                        content, ran = edit_package(content or b"", json.loads(x["ops"]))
                        version += 1
                        receipts.append({"batch": x["batch"], "applied": ran})
                    except (Refused, json.JSONDecodeError) as why:
                        receipts.append({"batch": x["batch"], "refused": str(why)})
                out.append((doc_id, content, version, json.dumps(receipts)))
            if out:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "content", "version", "receipts"])

    return packages.select("doc_id", "content").join(grouped, "doc_id", "left").mapInArrow(run, "doc_id long, content binary, version long, receipts string")
