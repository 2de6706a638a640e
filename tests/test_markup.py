"""Edits of XML parts: untouched bytes stay, edited trees parse again, refused edits leave nothing."""

import random
from xml.etree import ElementTree

import pytest

from leafpress.sources import markup as M

PART = b"""<?xml version='1.0' encoding="UTF-8"?>\r\n<!-- head --><k:box xmlns:k='urn:k' xmlns:z="urn:z"  k:a = '1>2'><k:row><k:c>one &amp; two</k:c ><k:c/><!--note--><k:c></k:c></k:row>
  <z:row k:b="&quot;"><![CDATA[raw <x>]]><k:c>t&#x41;il</k:c> end</z:row><?pi x?></k:box>\n<!-- tail -->"""


def test_untouched_bytes_stay():
    tree = M.Tree(PART)
    assert tree.dump() == PART and tree.check() == []
    M.at(tree.root, [0, 0]).set_text("new < text")
    assert tree.dump() == PART.replace(b"one &amp; two", b"new &lt; text") and tree.check() == []
    assert M.Tree(PART).root.scope()["z"] == "urn:z" and M.at(M.Tree(PART).root, [1]).name() == ("urn:z", "row")
    assert M.at(M.Tree(PART).root, [1, 0]).text == "tAil"


@pytest.mark.parametrize(
    "edit, old, new",
    [
        ({"edit": "setAttr", "path": [1], "name": "k:b", "value": "x\"<"}, b"<z:row k:b=\"&quot;\">", b"<z:row k:b=\"x&quot;&lt;\">"),
        ({"edit": "setAttr", "path": [1], "name": "k:b"}, b"<z:row k:b=\"&quot;\">", b"<z:row>"),
        ({"edit": "delete", "path": [0, 1]}, b"<k:c/>", b""),
        ({"edit": "append", "path": [0, 1], "xml": "<k:d/>"}, b"<k:c/>", b"<k:c><k:d/></k:c>"),
        ({"edit": "setText", "path": [0, 0], "text": ""}, b"<k:c>one &amp; two</k:c >", b"<k:c/>"),
        ({"edit": "insert", "path": [0], "at": 0, "xml": "<z:n>1</z:n><z:n/>"}, b"<k:row><k:c>one", b"<k:row><z:n>1</z:n><z:n/><k:c>one"),
        ({"edit": "clone", "path": [0, 0], "to": [1], "at": 1}, b"til</k:c>", b"til</k:c>"),
        ({"edit": "rename", "path": [0, 1], "tag": "k:e"}, b"<k:c/>", b"<k:e/>"),
    ],
)
def test_edits(edit, old, new):
    out = M.apply_edits(M.Tree(PART), [edit]).dump()
    if edit["edit"] == "clone":
        assert out == PART.replace(b"</k:c> end", b"</k:c> end<k:c>one &amp; two</k:c >")
    else:
        assert out == PART.replace(old, new, 1)


def test_refused_edits():
    tree = M.Tree(PART)
    for bad in (
        {"edit": "delete", "path": []}, {"edit": "delete", "path": [9]}, {"edit": "move", "path": [0], "to": [0, 0], "at": 0}, {"edit": "append", "path": [], "xml": "<open>"},
        {"edit": "append", "path": [], "xml": "<q:unbound q:a='1'/></x>"}, {"edit": "what", "path": []}, {"edit": "rename", "path": [0], "tag": "a b"}, {"edit": "insert", "path": [0], "at": 9, "xml": "<k:c/>"},
    ):
        with pytest.raises(M.BadEdit):
            M.apply_edits(tree, [{"edit": "setText", "path": [0, 0], "text": "x"}, bad])
    assert tree.dump() == PART
    with pytest.raises(Exception):
        M.Tree(b'<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>')


def test_subtrees_stand_alone():
    row = M.at(M.Tree(PART).root, [1])
    alone = ElementTree.fromstring(row.standalone())
    assert alone.tag == "{urn:z}row" and [c.tag for c in alone] == ["{urn:k}c"]
    again = M.Tree("<?xml version='1.0' encoding='UTF-16'?><a b='é'>漢</a>".encode("utf-16"))
    assert again.root.text == "漢" and ElementTree.fromstring(again.dump()).get("b") == "é"


def test_random_edits_parse_again():
    rng = random.Random(2)
    for _ in range(150):
        tree = M.Tree(PART)
        for _ in range(rng.randint(1, 12)):
            every = list(tree.root.walk())
            e = rng.choice(every)
            path = []
            x = e
            while x.parent is not None:
                path.insert(0, [c is x for c in x.parent].index(True))
                x = x.parent
            edit = rng.choice(
                [{"edit": "setText", "text": rng.choice(["", "a<b", "漢"])}, {"edit": "setAttr", "name": "k:q", "value": rng.choice([None, "1"])}, {"edit": "append", "xml": "<k:n><z:m/>t</k:n>"}, {"edit": "delete"}, {"edit": "clone", "to": [], "at": 0}, {"edit": "move", "to": [], "at": 0}]
            )
            try:
                tree = M.apply_edits(tree, [edit | {"path": path}])
            except M.BadEdit:
                assert not path and edit["edit"] in ("delete", "clone", "move") or edit["edit"] in ("clone", "move")
        assert tree.check() == [] and ElementTree.fromstring(tree.dump()) is not None
