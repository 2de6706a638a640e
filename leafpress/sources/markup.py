"""XML parts as trees that can be edited and written back with all bytes that no edit touched.

An element knows its bytes in the source. Between elements stand gaps: the raw bytes of text, comments and
instructions. A subtree without edits is written as it stood; of an edited element only what changed is
made anew.
"""

from __future__ import annotations

import re
from xml.parsers import expat
from xml.sax.saxutils import escape


class BadEdit(ValueError):
    """An edit of a tree that can't be made."""


_OPEN = re.compile(rb"""<[^\s/>]+(?:[^>"']|"[^"]*"|'[^']*')*>""")
_CODING = re.compile(r"""^(\s*<\?xml[^>]*?encoding\s*=\s*)["'][^"']*["']""")
# Fixed value: the prefix that is bound without a declaration.
_SCOPE = {"xml": "http://www.w3.org/XML/1998/namespace"}


def quoted(value: str) -> str:
    return '"' + escape(value, {'"': "&quot;", "\n": "&#10;", "\t": "&#9;", "\r": "&#13;"}) + '"'


class Element:
    """An element: tag and attributes as written, children (elements and gaps of bytes), its own text."""

    __slots__ = ("attrs", "changed", "children", "close", "end", "open", "parent", "retagged", "source", "start", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, children: list | None = None, text: str = ""):
        self.tag, self.attrs, self.children, self.text = tag, dict(attrs or {}), [], text
        self.source, self.start, self.open, self.close, self.end = None, 0, 0, 0, 0
        self.parent: Element | None = None
        self.changed = self.retagged = True
        if text:
            self.children.append(escape(text).encode())
        for c in children or ():
            self.append(c)

    def __iter__(self):
        return (c for c in self.children if isinstance(c, Element))

    def walk(self):
        """This element and all below it, in order."""
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += reversed([c for c in e.children if isinstance(c, Element)])

    def up(self):
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    def scope(self) -> dict[str, str]:
        """Prefixes in force here."""
        out = {}
        for e in [self, *self.up()]:
            for k, v in e.attrs.items():
                if k == "xmlns" or k.startswith("xmlns:"):
                    out.setdefault(k[6:], v)
        return {**_SCOPE, **out}

    def name(self) -> tuple[str, str]:
        """(namespace, local name)."""
        prefix, _, local = self.tag.rpartition(":")
        return self.scope().get(prefix, ""), local

    @property
    def local(self) -> str:
        return self.tag.rpartition(":")[2]

    def index(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self)

    # --- edits

    def touch(self) -> None:
        for e in [self, *self.up()]:
            e.changed = True

    def set_attr(self, name: str, value: str | None) -> None:
        if value is None:
            self.attrs.pop(name, None)
        else:
            self.attrs[name] = value
        self.retagged = True
        self.touch()

    def set_text(self, text: str) -> None:
        """Text instead of all that is inside."""
        for c in self:
            c.parent = None
        self.children, self.text = [escape(text).encode()] if text else [], text
        self.touch()

    def rename(self, tag: str) -> None:
        self.tag, self.retagged = tag, True
        self.touch()

    def insert(self, at: int, child: Element | bytes) -> None:
        if isinstance(child, Element):
            if child.parent is not None:
                raise BadEdit("the element stands elsewhere")
            if child is self or any(e is child for e in self.up()):
                raise BadEdit("an element can't stand in itself")
            child.parent = self
        self.children.insert(at, child)
        self.touch()

    def append(self, child: Element | bytes) -> None:
        self.insert(len(self.children), child)

    def detach(self) -> Element:
        if self.parent is None:
            raise BadEdit("the root stays")
        parent, at = self.parent, self.index()
        del parent.children[at]
        parent.touch()
        self.parent = None
        return self

    def move(self, parent: Element, at: int) -> None:
        if parent is self or any(e is self for e in parent.up()):
            raise BadEdit("an element can't stand in itself")
        if parent is self.parent and self.index() < at:
            at -= 1
        self.detach()
        parent.insert(at, self)

    def clone(self) -> Element:
        """A copy that stands nowhere; an untouched element's bytes serve the copy too."""
        out = Element(self.tag, self.attrs)
        out.text, out.source, out.start, out.open, out.close, out.end = self.text, self.source, self.start, self.open, self.close, self.end
        out.changed, out.retagged = self.changed, self.retagged
        for c in self.children:
            if isinstance(c, Element):
                c = c.clone()
                c.parent = out
            out.children.append(c)
        return out

    # --- bytes

    def dump(self) -> bytes:
        if not self.changed:
            return self.source[self.start : self.end]
        inner = b"".join(c if isinstance(c, bytes) else c.dump() for c in self.children)
        closed = self.source is None or self.close == self.end
        if self.retagged or bool(inner) == closed and (closed or not inner):
            head = f"<{self.tag}{''.join(f' {k}={quoted(v)}' for k, v in self.attrs.items())}".encode()
            return head + b">" + inner + f"</{self.tag}>".encode() if inner else head + b"/>"
        return self.source[self.start : self.open] + inner + self.source[self.close : self.end]

    def standalone(self) -> bytes:
        """The subtree as a document of its own, with the prefixes it needs declared on it."""
        needs = {t.rpartition(":")[0] for e in self.walk() for t in (e.tag, *(k for k in e.attrs if ":" in k and not k.startswith("xmlns")))}
        own = self.clone()
        for prefix, uri in self.scope().items():
            key = f"xmlns:{prefix}" if prefix else "xmlns"
            if prefix in needs and prefix not in _SCOPE and key not in own.attrs:
                own.set_attr(key, uri)
        return own.dump()


class Tree:
    """A part: what stands before and after its root, and the root."""

    def __init__(self, data: bytes):
        if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            data = data.decode("utf-16").encode()
            data = _CODING.sub(r'\1"UTF-8"', data.decode()).encode()
        self.data = data
        self.root = _parse(data)
        self.before, self.after = data[: self.root.start], data[self.root.end :]

    def dump(self) -> bytes:
        return self.before + self.root.dump() + self.after if self.root.changed else self.data

    def check(self) -> list[str]:
        """What is wrong with the tree: parents that don't hold their children, bytes that don't parse, edits that a flag lost."""
        wrong = [f"{c.tag} in {e.tag} has another parent" for e in self.root.walk() for c in e if c.parent is not e]
        wrong += [f"{c.tag} changed in unchanged {e.tag}" for e in self.root.walk() for c in e if c.changed and not e.changed]
        try:
            again = _parse(self.dump())
        except expat.ExpatError as why:
            return [*wrong, str(why)]
        here, there = ([(e.tag, e.attrs) for e in r.walk()] for r in (self.root, again))
        return wrong + ([] if here == there else ["the bytes say something else"])


def _parse(data: bytes) -> Element:
    stack: list[Element] = []
    done: list[Element] = []
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.ordered_attributes = True

    def refuse(*_):
        raise expat.ExpatError("entities are not read")

    def start(tag: str, attrs: list[str]) -> None:
        e = Element(tag, dict(zip(attrs[::2], attrs[1::2])))
        e.source, e.start = data, parser.CurrentByteIndex
        e.open = _OPEN.match(data, e.start).end()
        e.changed = e.retagged = False
        if stack:
            up = stack[-1]
            since = next((c.end for c in reversed(up.children) if isinstance(c, Element)), up.open)
            if e.start > since:
                up.children.append(data[since : e.start])
            e.parent = up
            up.children.append(e)
        stack.append(e)

    def end(_: str) -> None:
        e = stack.pop()
        if data[e.open - 2 : e.open] == b"/>":
            e.close = e.end = e.open
        else:
            e.close = parser.CurrentByteIndex
            e.end = data.index(b">", e.close) + 1
            since = next((c.end for c in reversed(e.children) if isinstance(c, Element)), e.open)
            if e.close > since:
                e.children.append(data[since : e.close])
        done.append(e)

    def chars(text: str) -> None:
        stack[-1].text += text

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = start, end, chars, refuse
    parser.Parse(data, True)
    return done[-1]


def fragment(xml: str, scope: dict[str, str]) -> list[Element]:
    """Elements of a piece of XML whose prefixes are bound by `scope`; they stand nowhere."""
    names = "".join(f" {'xmlns:' + p if p else 'xmlns'}={quoted(u)}" for p, u in scope.items() if p not in _SCOPE)
    try:
        root = _parse(f"<x{names}>{xml}</x>".encode())
    except expat.ExpatError as why:
        raise BadEdit(str(why)) from None
    out = list(root)
    for e in out:
        e.parent = None
    return out


def at(root: Element, path: list[int]) -> Element:
    """The element below root by places among element children."""
    for i in path:
        own = list(root)
        if not 0 <= i < len(own):
            raise BadEdit(f"no element at {path}")
        root = own[i]
    return root


def apply_edits(tree: Tree, edits: list[dict]) -> Tree:
    """A new tree after all edits (all or none): setText, setAttr, rename, insert, append, delete, move, clone.

    An edit names its element by `path`, places among element children as they are when its turn comes.
    """
    work = Tree(tree.dump())
    for x in edits:
        e, kind = at(work.root, x["path"]), x["edit"]
        if kind == "setText":
            e.set_text(x["text"])
        elif kind == "setAttr":
            e.set_attr(x["name"], x.get("value"))
        elif kind == "rename":
            e.rename(x["tag"])
        elif kind in ("insert", "append"):
            place = len(e.children) if kind == "append" else _place(e, x["at"])
            for k, c in enumerate(fragment(x["xml"], e.scope())):
                e.insert(place + k, c)
        elif kind == "delete":
            e.detach()
        elif kind == "move":
            to = at(work.root, x["to"])
            e.move(to, _place(to, x["at"]))
        elif kind == "clone":
            to = at(work.root, x["to"])
            to.insert(_place(to, x["at"]), e.clone())
        else:
            raise BadEdit(f"unknown edit {kind}")
    wrong = work.check()
    if wrong:
        raise BadEdit("; ".join(wrong))
    return work


def _place(e: Element, nth: int) -> int:
    """The place among all children where the nth element child stands."""
    own = [i for i, c in enumerate(e.children) if isinstance(c, Element)]
    if not 0 <= nth <= len(own):
        raise BadEdit("place out of range")
    return own[nth] if nth < len(own) else len(e.children)
