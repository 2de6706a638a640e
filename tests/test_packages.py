import io
import zipfile

import pytest
from pyspark.sql import functions as F

from leafpress.plans import session as P
from leafpress.sources import docx, zipio

XML = f'''<?xml version="1.0"?><w:document xmlns:w="{docx.W}" xmlns:mc="{docx.MC}" xmlns:x="urn:x"><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="4"/></w:numPr></w:pPr><w:r><w:t xml:space="preserve"> a </w:t><w:tab/><w:br/><w:noBreakHyphen/><w:drawing/><w:sym w:font="F" w:char="F041"/></w:r><w:ins w:id="1"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:id="2"><w:r><w:delText> old </w:delText></w:r></w:del></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><mc:AlternateContent><mc:Choice Requires="x"><w:r><w:t>choice</w:t></w:r></mc:Choice><mc:Fallback><w:r><w:t>fallback</w:t></w:r></mc:Fallback></mc:AlternateContent></w:p>
</w:body></w:document>'''


def package(xml=XML, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        blank = docx.blank_package([])
        for e in zipio.directory(blank):
            z.writestr(e.name, zipio.read(blank, e) if e.name != "word/document.xml" else xml)
        for name, content in more.items():
            z.writestr(name.replace("__", "/"), content)
    return out.getvalue()


def frame(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "doc_id long, content binary")


def test_blocks_and_segments(spark):
    packages = frame(spark, package())
    nodes = docx.nodes(docx.parts(packages).where("uri like '%.xml'"))
    rows = docx.blocks(nodes).where("text_kind is not null").orderBy("block_ix").collect()
    assert [(r.text, r.text_kind, r.level, r.in_table) for r in rows] == [("Title", "heading", 2, False), (" a \t\n‑￼new" + "old", "list", None, False), ("cell", "paragraph", None, True), ("fallback", "paragraph", None, False)]
    segs = docx.segments(nodes).where("rev is not null").collect()
    assert {(s.rev, s.text) for s in segs} == {("ins", "new"), ("del", "old")}
    chosen = docx.nodes(docx.parts(packages).where("uri like '%document.xml'"), understood=("urn:x",))
    assert "choice" in [r.text for r in docx.blocks(chosen).collect()]


def test_tree(spark):
    nodes = docx.nodes(docx.parts(frame(spark, package())).where("uri like '%document.xml'")).cache()
    t = nodes.where("local = 'tc'")
    above = docx.ancestors(nodes, t).join(nodes.select(F.col("node_id").alias("ancestor_id"), "local"), "ancestor_id").orderBy("distance")
    assert [r.local for r in above.select("local", "distance").collect()] == ["tr", "tbl", "body", "document"]
    assert docx.string_values(nodes, t).first().value == "cell"
    assert nodes.where("lex_end < lex_start").count() == 0
    root = nodes.where("parent_id is null").first()
    assert XML.encode()[root.lex_start : root.lex_end].startswith(b"<w:document") and root.lex_end == len(XML.encode())
    assert docx.flavour(nodes).first().flavour == "transitional"


def test_save_keeps_bytes(spark):
    data = package(word__media__a="x" * 500)
    packages = frame(spark, data)
    none = packages.select("doc_id", F.lit("/a").alias("uri"), F.col("content").alias("bytes")).limit(0)
    assert bytes(docx.save(packages, none).first().content) == data
    change = spark.createDataFrame([(0, "/word/document.xml", bytearray(b"<a/>"))], "doc_id long, uri string, bytes binary")
    saved = bytes(docx.save(packages, change).first().content)
    old, new = zipfile.ZipFile(io.BytesIO(data)), zipfile.ZipFile(io.BytesIO(saved))
    assert new.testzip() is None and old.namelist() == new.namelist()
    for a, b in zip(old.infolist(), new.infolist()):
        assert new.read(b) == (b"<a/>" if b.filename == "word/document.xml" else old.read(a))
    entry = {e.name: e for e in zipio.directory(data)}["word/media/a"]
    other = {e.name: e for e in zipio.directory(saved)}["word/media/a"]
    assert data[entry.offset : entry.end] == saved[other.offset : other.end]


@pytest.mark.parametrize("bad", [b"", b"no zip", package()[:200], package()[:-30], package()[:-22] + b"PK\5\6" + b"\0" * 6 + b"\xff\xff\xff\xff" + b"\0" * 8])
def test_hostile_packages_give_rows(spark, bad):
    rows = docx.parts(frame(spark, bad, package())).collect()
    assert any(r.error for r in rows if r.doc_id == 0)
    assert sum(r.doc_id == 1 and r.error is None for r in rows) == 3


def test_broken_xml_and_entities(spark):
    bomb = '<!DOCTYPE a [<!ENTITY b "cc">]><a>&b;</a>'
    packages = frame(spark, package("<w:document"), package(bomb), package())
    got = docx.nodes(docx.parts(packages).where("uri like '%document.xml'")).groupBy("doc_id").count().collect()
    assert [r.doc_id for r in got] == [2]


def test_relationships(spark):
    rels = f'<Relationships xmlns="r"><Relationship Id="a" Type="{docx.R}/image" Target="media/x.png"/><Relationship Id="a" Type="{docx.R}/image" Target="../y.png"/><Relationship Id="b" Type="{docx.R}/hyperlink" Target="http://z" TargetMode="External"/></Relationships>'
    packages = frame(spark, package(**{"word___rels__document.xml.rels": rels}))
    found = docx.parts(packages)
    rows = docx.relationships(found, docx.nodes(found.where("uri like '%.rels'"))).where("source_uri like '/word%'").orderBy("rel_id").collect()
    assert [(r.rel_id, r.kind, r.target_uri, r.source_uri) for r in rows] == [("a", "image", "/y.png", "/word/document.xml"), ("b", "hyperlink", None, "/word/document.xml")]


def test_files(spark, tmp_path):
    docx.write_packages(frame(spark, package(), package()), f"file://{tmp_path}")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0.docx", "1.docx"]
    docs = P.DocSet.of_packages(spark, str(tmp_path))
    page = docs.outline()
    assert [r["title"] for r in page["records"]] == ["Title", "Title"]
    assert docs.check() == {"cover": 0, "repeated": 0, "identity": 0}
    assert docs.diagnostics().count() == 0


def test_session(spark):
    docs = P.DocSet.of_text(spark.createDataFrame([(1, "first line\nsecond cat", "s", "en"), (2, "cat " * 30, "s", "en")], "doc_id long, text string, source string, lang string"))
    first = docs.text(limit=15, max_bytes=512)
    assert [r["text"] for r in first["records"]] == ["first line"] and first["hasMore"]
    rest = docs.text(cursor=first["cursor"], limit=1000, max_bytes=4000)
    assert [r["block_ix"] for r in rest["records"]] == [1, 0] and not rest["hasMore"]
    with pytest.raises(P.BadCursor):
        docs.find("cat", cursor=first["cursor"])
    with pytest.raises(P.BudgetTooSmall):
        docs.text(limit=1)
    assert len(docs.find("CAT", insensitive=True)["records"]) == 31
    edits = spark.createDataFrame([(1, 0, '[{"action": "replaceText", "selector": {"find": "cat"}, "text": "dog"}]')], "doc_id long, batch long, ops string")
    after = docs.edit(edits, expected_version=0)
    assert after.version == 1 and after.find("dog")["records"][0]["doc_id"] == 1
    assert [tuple(r)[:2] for r in docs.diff(after).select("doc_id", "block_ix").collect()] == [(1, 1)]
    with pytest.raises(P.StaleCursor):
        after.text(cursor=first["cursor"])
    with pytest.raises(ValueError):
        docs.edit(edits, expected_version=3)


def test_orphan_parts(spark):
    xml = f'''<w:document xmlns:w="{docx.W}" xmlns:r="{docx.R}" xmlns:o="urn:o"><w:body><w:p r:embed="rId1" o:relid=" rId2 " w:val="x"/></w:body></w:document>'''
    rel = lambda i, kind, target: f'<Relationship Id="{i}" Type="{docx.R}/{kind}" Target="{target}"/>'
    rels = lambda *r: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(r)}</Relationships>'
    more = {f"word__media__{n}.png": b"x" for n in "abcd"} | {"word__charts__c.xml": "<c/>", "word___rels__document.xml.rels": rels(rel("rId1", "image", "media/a.png"), rel("rId2", "chart", "charts/c.xml"), rel("rId3", "image", "media/b.png"), rel("rId4", "image", "media/a.png"))}
    more["word__charts___rels__c.xml.rels"] = rels(rel("k", "themeOverride", "../media/c.png"))
    parts = docx.parts(frame(spark, package(xml, **more)))
    nodes = docx.nodes(parts.where("uri like '%.xml' or uri like '%.rels'")).cache()
    main = nodes.where("local = 'p'").select("doc_id", "part_id")
    assert {r.rel_id for r in docx.referenced_rids(nodes).join(main, ["doc_id", "part_id"]).collect()} == {"rId1", "rId2"}
    assert sorted(r.uri for r in docx.orphan_parts(parts, nodes).collect()) == ["/word/media/b.png", "/word/media/d.png"]
