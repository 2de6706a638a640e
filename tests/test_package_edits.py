"""Operations on real packages: each is saved, read again and compared; text operations against the plain model."""

import copy
import io
import json
import random
import zipfile
from xml.etree import ElementTree

import pytest

from leafpress.operators import folding
from leafpress.operators import package_edits as E
from leafpress.sources import docx, zipio

NS = {"w": docx.W}
BODY = """<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Spring</w:t></w:r><w:r><w:t xml:space="preserve"> report</w:t></w:r></w:p>
<w:p><w:r><w:t>Numbers</w:t><w:tab/><w:t>grew</w:t></w:r><w:ins w:id="5" w:author="Kim"><w:r><w:t xml:space="preserve"> a lot</w:t></w:r></w:ins><w:del w:id="6" w:author="Lee"><w:r><w:delText xml:space="preserve"> less</w:delText></w:r></w:del></w:p>
<w:tbl><w:tblPr/><w:tblGrid><w:gridCol w:w="10"/><w:gridCol w:w="20"/></w:tblGrid><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b1</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>b2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:hyperlink w:anchor="x"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:sdt><w:sdtPr/><w:sdtContent><w:r><w:t>inside</w:t></w:r></w:sdtContent></w:sdt></w:p>
<w:sectPr><w:pgSz w:w="100" w:h="200"/></w:sectPr>"""


def package(body=BODY, **more):
    out = io.BytesIO()
    blank = docx.blank_package([])
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for e in zipio.directory(blank):
            z.writestr(e.name, f'<w:document xmlns:w="{docx.W}"><w:body>{body}</w:body></w:document>' if e.name == "word/document.xml" else zipio.read(blank, e))
        for name, content in more.items():
            z.writestr(name.replace("__", "/"), content)
    return out.getvalue()


def texts(content):
    pkg = E.Package(content)
    return [pkg.text(p) for p in pkg.paras]


def part(content, name="word/document.xml"):
    return ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read(name))


def edit(*ops, content=None):
    out, _ = E.edit_package(content or package(), [dict(o) for o in ops])
    assert zipfile.ZipFile(io.BytesIO(out)).testzip() is None
    return out


def at(para, offset):
    return {"para": para, "offset": offset}


def span(para, lo, hi):
    return {"from": at(para, lo), "to": at(para, hi)}


def test_reads_as_blocks_do(spark):
    content = package()
    frame = spark.createDataFrame([(0, bytearray(content))], "doc_id long, content binary")
    nodes = docx.nodes(docx.parts(frame).where("uri like '%document.xml'"))
    assert [r.text for r in docx.blocks(nodes).orderBy("block_ix").collect()] == texts(content) == ["Spring report", "Numbers\tgrew a lot less", "a1", "b1", "", "b2", "linkinside"]


@pytest.mark.parametrize(
    "ops, want",
    [
        ([{"op": "insertText", "at": at(0, 6), "text": "time"}], {0: "Springtime report"}),
        ([{"op": "insertText", "at": at(4, 0), "text": "new"}], {4: "new"}),
        ([{"op": "replaceText", **span(0, 3, 9), "text": "-"}], {0: "Spr-port"}),
        ([{"op": "deleteRange", **span(1, 7, 8)}], {1: "Numbersgrew a lot less"}),
        ([{"op": "splitParagraph", "at": at(0, 8)}], {0: "Spring r", 1: "eport"}),
        ([{"op": "mergeWithNext", "para": 0}], {0: "Spring reportNumbers\tgrew a lot less"}),
        ([{"op": "insertAtom", "at": at(0, 6), "atom": {"kind": "tab"}}], {0: "Spring\t report"}),
        ([{"op": "insertAtom", "at": at(0, 13), "atom": {"kind": "footnote", "text": "see"}}], {0: "Spring report￼"}),
        ([{"op": "insertBlock", "at": {"after": 0}, "block": {"text": "between", "props": {"style": "Quote"}}}], {1: "between"}),
        ([{"op": "deleteBlock", "node": 1}], {1: "a1"}),
        ([{"op": "moveBlock", "node": 6, "to": {"before": 0}}], {0: "linkinside", 1: "Spring report"}),
        ([{"op": "replaceInlines", "para": 1, "inlines": [{"text": "all "}, {"text": "new", "props": {"b": True}}]}], {1: "all new"}),
        ([{"op": "insertField", "at": at(0, 0), "instr": " PAGE ", "result": "7"}], {0: "7Spring report"}),
        ([{"op": "setSdtContent", "sdt": 0, "text": "set"}], {6: "linkset"}),
        ([{"op": "removeSdtShell", "sdt": 0}], {6: "linkinside"}),
        ([{"op": "insertRow", "table": 0, "at": 1}], {2: "a1", 4: "", 6: "", 7: "b2"}),
        ([{"op": "deleteRow", "table": 0, "at": 0}], {2: "", 3: "b2", 4: "linkinside"}),
        ([{"op": "insertColumn", "table": 0, "at": 1}], {2: "a1", 3: "", 4: "b1"}),
        ([{"op": "deleteColumn", "table": 0, "at": 0}], {2: "b1", 3: "b2"}),
        ([{"op": "mergeCells", "table": 0, "from": [0, 0], "to": [0, 1]}], {2: "a1", 3: "b1", 4: ""}),
        ([{"op": "acceptAll"}], {1: "Numbers\tgrew a lot"}),
        ([{"op": "rejectAll"}], {1: "Numbers\tgrew less"}),
        ([{"op": "acceptRevision", "rev": 6}], {1: "Numbers\tgrew a lot"}),
        ([{"op": "rejectRevision", "rev": 5}], {1: "Numbers\tgrew less"}),
        ([{"op": "setTracking", "author": "Max"}, {"op": "replaceText", **span(0, 0, 6), "text": "Autumn"}], {0: "SpringAutumn report"}),
        ([{"op": "setTracking", "author": "Max"}, {"op": "replaceText", **span(0, 2, 6), "text": "X"}, {"op": "acceptAll", "author": "Max"}], {0: "SpX report", 1: "Numbers\tgrew a lot less"}),
        ([{"op": "setTracking", "author": "Max"}, {"op": "replaceText", **span(0, 2, 6), "text": "X"}, {"op": "rejectAll", "author": "Max"}], {0: "Spring report"}),
        ([{"action": "replaceText", "selector": {"find": "report"}, "text": "news"}], {0: "Spring news"}),
    ],
)
def test_text_after(ops, want):
    got = texts(edit(*ops))
    assert {i: got[i] for i in want} == want


@pytest.mark.parametrize(
    "ops, name, path, want",
    [
        ([{"op": "setParaProps", "para": 0, "patch": {"jc": "center", "spacing": {"before": 120}, "keepNext": True}}], "word/document.xml", ".//w:body/w:p[1]/w:pPr/*", ["pStyle", "keepNext", "spacing", "jc"]),
        ([{"op": "setParaProps", "para": 0, "patch": {"style": None}}], "word/document.xml", ".//w:body/w:p[1]/w:pPr/*", []),
        ([{"op": "replaceParaProps", "para": 6, "props": {"jc": "end"}}], "word/document.xml", ".//w:body/w:p[3]/w:pPr/*", ["jc"]),
        ([{"op": "setRunProps", **span(0, 2, 4), "patch": {"i": True, "b": None}}], "word/document.xml", ".//w:body/w:p[1]/w:r[2]/w:rPr/*", ["i"]),
        ([{"op": "setTableProps", "table": 0, "patch": {"jc": "center", "style": "Grid"}}], "word/document.xml", ".//w:tbl/w:tblPr/*", ["tblStyle", "jc"]),
        ([{"op": "setRowProps", "table": 0, "row": 0, "patch": {"tblHeader": True}}], "word/document.xml", ".//w:tr[1]/w:trPr/*", ["tblHeader"]),
        ([{"op": "setCellProps", "table": 0, "row": 0, "cell": 0, "patch": {"tcW": {"w": 5, "type": "dxa"}}}], "word/document.xml", ".//w:tr[1]/w:tc[1]/w:tcPr/*", ["tcW", "vMerge"]),
        ([{"op": "setSectionProps", "sect": 0, "patch": {"titlePg": True, "pgSz": {"w": 300}}}], "word/document.xml", ".//w:sectPr/*", ["pgSz", "titlePg"]),
        ([{"op": "insertSectionBreak", "para": 0, "type": "continuous"}], "word/document.xml", ".//w:body/w:p[1]/w:pPr/w:sectPr/*", ["type", "pgSz"]),
        ([{"op": "insertSectionBreak", "para": 0}, {"op": "deleteSectionBreak", "sect": 0}], "word/document.xml", ".//w:body/w:p[1]/w:pPr/*", ["pStyle"]),
        ([{"op": "setHeaderFooter", "sect": 0, "kind": "header", "content": [{"text": "top"}, {"text": "two"}]}], "word/header1.xml", "./*", ["p", "p"]),
        ([{"op": "setHeaderFooter", "sect": 0, "kind": "footer", "content": []}, {"op": "linkHeaderFooter", "sect": 0, "kind": "footer"}], "word/document.xml", ".//w:sectPr/*", ["pgSz"]),
        ([{"op": "upsertStyle", "style": {"id": "Quote", "basedOn": "Normal", "run": {"i": True}}}], "word/styles.xml", "./w:style/*", ["name", "basedOn", "rPr"]),
        ([{"op": "addNumberingDefinition", "levels": [{"format": "upperRoman"}]}, {"op": "restartNumbering", "para": 6, "start": 3}], "word/numbering.xml", "./*", ["abstractNum", "num", "num"]),
        ([{"op": "setDocumentSettings", "patch": {"trackRevisions": True}}], "word/settings.xml", "./*", ["trackRevisions"]),
        ([{"op": "setPageColor", "color": "#FF0000"}], "word/document.xml", "./*", ["background", "body"]),
        ([{"op": "addComment", **span(0, 1, 4), "comment": {"text": "why?\nreally", "author": "Kim"}}], "word/comments.xml", "./w:comment/*", ["p", "p"]),
        ([{"op": "addComment", **span(0, 1, 4), "comment": {"text": "why?"}}, {"op": "setCommentText", "id": 0, "text": "new"}, {"op": "removeComment", "id": 0}], "word/comments.xml", "./*", []),
        ([{"op": "addBookmark", "name": "mark", **span(0, 1, 4)}], "word/document.xml", ".//w:body/w:p[1]/*", ["pPr", "r", "bookmarkStart", "r", "bookmarkEnd", "r", "r"]),
        ([{"op": "addBookmark", "name": "mark", **span(0, 1, 4)}, {"op": "removeBookmark", "name": "mark"}], "word/document.xml", ".//w:body/w:p[1]/*", ["pPr", "r", "r", "r", "r"]),
        ([{"op": "insertAtom", "at": at(0, 0), "atom": {"kind": "endnote", "text": "n"}}, {"op": "setNoteContent", "kind": "endnote", "id": 1, "text": "a\nb"}], "word/endnotes.xml", "./w:endnote/*", ["p", "p"]),
        ([{"op": "setLinkTarget", "para": 6, "url": "http://x.example/"}], "word/_rels/document.xml.rels", "./*", ["Relationship"]),
    ],
)
def test_parts_after(ops, name, path, want):
    root = part(edit(*ops), name)
    assert [e.tag.rpartition("}")[2] for e in root.findall(path, NS)] == want


def test_links_of_new_parts(spark):
    out = edit({"op": "setHeaderFooter", "sect": 0, "kind": "header", "content": [{"text": "top"}]}, {"op": "addComment", **span(0, 0, 2), "comment": {"text": "c"}})
    frame = spark.createDataFrame([(0, bytearray(out))], "doc_id long, content binary")
    found = docx.parts(frame)
    nodes = docx.nodes(found.where("uri like '%.xml' or uri like '%.rels'")).cache()
    uris = {r.uri for r in found.collect()}
    rels = [r for r in docx.relationships(found, nodes).collect() if r.source_uri == "/word/document.xml"]
    assert {r.kind for r in rels} == {"header", "comments"} and all(r.target_uri in uris for r in rels)
    types = {r.uri: r.content_type for r in docx.content_types(found, nodes).collect()}
    assert types["/word/header1.xml"].endswith("header+xml") and types["/word/comments.xml"].endswith("comments+xml")


def test_untouched_bytes_stay():
    content = package(word__media__a="x" * 300)
    old = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")
    new = zipfile.ZipFile(io.BytesIO(edit({"op": "insertText", "at": at(3, 1), "text": "&"}, content=content))).read("word/document.xml")
    assert new == old.replace(b"<w:t>b1</w:t>", b'<w:t xml:space="preserve">b&amp;1</w:t>')
    assert E.edit_package(content, [])[0] == content


@pytest.mark.parametrize(
    "op",
    [
        {"op": "insertText", "at": at(0, 99), "text": "x"}, {"op": "insertText", "at": at(99, 0), "text": "x"}, {"op": "deleteRange", **span(0, 5, 2)}, {"op": "nothing"}, {"op": "insertText"}, {"op": "deleteRow", "table": 0, "at": 7},
        {"op": "mergeWithNext", "para": 6}, {"op": "deleteBlock", "node": 2}, {"op": "acceptRevision", "rev": 77}, {"op": "deleteSectionBreak", "sect": 0}, {"op": "removeComment", "id": 4}, {"op": "setThemeColors", "patch": {}},
        {"op": "restartNumbering", "para": 0}, {"op": "toggleCheckbox", "sdt": 0}, {"op": "replacePartXml", "part": "/word/none.xml", "xml": "<a/>"}, {"op": "moveBlock", "node": 0, "to": {"after": 99}},
    ],
)
def test_refused(op):
    with pytest.raises(E.Refused):
        E.edit_package(package(), [{"op": "insertText", "at": at(0, 0), "text": "lost"}, op])


def test_text_operations_match_the_model():
    """Random text edits of a package and of the plain model give the same paragraphs, runs and styles or not."""
    rng = random.Random(11)
    done = 0
    for _ in range(120):
        paras = ["".join(rng.choice(["ab", "c ", "é", "😀", "漢"]) for _ in range(rng.randint(0, 8))) for _ in range(3)]
        model = folding.empty(paras)
        runs = lambda t: "".join(f'<w:r><w:t xml:space="preserve">{c}</w:t></w:r>' for c in ([t[: len(t) // 2], t[len(t) // 2 :]] if rng.random() < 0.5 else [t]) if c)
        content = package("".join(f"<w:p>{runs(t)}</w:p>" for t in paras))
        ids = [b["id"] for b in model["blocks"]]
        for _ in range(rng.randint(1, 6)):
            n = rng.randrange(len(ids))
            size = E.units(model["blocks"][n]["text"])
            lo, hi = sorted(rng.randint(0, size + (rng.random() < 0.1)) for _ in range(2))
            op = rng.choice(["insertText", "replaceText", "deleteRange", "splitParagraph", "mergeWithNext", "setRunProps"])
            if op == "setRunProps":  # the plain model marks any range, a package can't cut a character
                ends = [E.units(model["blocks"][n]["text"][:i]) for i in range(len(model["blocks"][n]["text"]) + 1)]
                lo, hi = sorted(rng.choice(ends) for _ in range(2))
            make = lambda para: {"insertText": {"at": at(para, lo), "text": "x😀"}, "replaceText": {**span(para, lo, hi), "text": "yy"}, "deleteRange": span(para, lo, hi), "splitParagraph": {"at": at(para, lo)}, "mergeWithNext": {"para": para}, "setRunProps": {**span(para, lo, hi), "patch": {"b": True}}}[op] | {"op": op}
            try:
                after, _ = folding.apply_batch(copy.deepcopy(model), [make(ids[n])])
            except folding.Refused:
                with pytest.raises(E.Refused):
                    E.edit_package(content, [make(n)])
                continue
            content, _ = E.edit_package(content, [make(n)])
            model, done = after, done + 1
            ids = [b["id"] for b in model["blocks"]]
            assert texts(content) == [b["text"] for b in model["blocks"]]
    assert done > 150


def test_folded(spark):
    whole = package()
    packages = spark.createDataFrame([(0, bytearray(whole)), (1, bytearray(b"broken")), (2, bytearray(whole)), (3, None)], "doc_id long, content binary")
    ops = json.dumps([{"op": "insertText", "at": at(0, 0), "text": "A "}])
    edits = spark.createDataFrame([(0, 2, ops), (0, 1, json.dumps([{"op": "deleteRange", **span(0, 0, 7)}])), (0, 3, "[{"), (0, 4, None), (1, 0, ops), (9, 0, ops)], "doc_id long, batch long, ops string")
    out = {r.doc_id: r for r in E.fold_packages(packages, edits).collect()}
    assert set(out) == {0, 1, 2, 3}
    assert texts(bytes(out[0].content))[0] == "A report" and out[0].version == 3
    assert ["refused" in x for x in json.loads(out[0].receipts)] == [False, False, True, False]
    assert bytes(out[1].content) == b"broken" and out[1].version == 0 and bytes(out[2].content) == whole


def test_session_edits_files(spark, tmp_path):
    """Open, edit, save, open again: the edit stands in the file, and the first set is as it was."""
    from leafpress.plans import session as P

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(package())
    docs = P.DocSet.of_packages(spark, str(tmp_path / "in"))
    doc_id = docs.blocks.first().doc_id
    ops = json.dumps([{"action": "replaceText", "selector": {"find": "report"}, "text": "news"}, {"op": "addBookmark", "name": "m", **span(0, 0, 6)}])
    after = docs.edit(spark.createDataFrame([(doc_id, 0, ops)], "doc_id long, batch long, ops string"), expected_version=0)
    assert after.version == 1 and docs.find("news")["records"] == []
    after.save(f"file://{tmp_path}/out")
    again = P.DocSet.of_packages(spark, str(tmp_path / "out"))
    assert [r["text"] for r in again.text()["records"]][:2] == ["Spring news", "Numbers\tgrew a lot less"]
    assert again.check() == {"cover": 0, "repeated": 0, "identity": 0}
