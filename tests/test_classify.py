"""Rules of paragraphs and of what stands in a body, and the small views."""

from pyspark.sql import functions as F

from leafpress.operators import classify as C
from leafpress.sources import docx
from tests.test_packages import frame, package

NAMES = f'xmlns:w="{docx.W}" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:m="{C._MATH[0]}" xmlns:mc="{docx.MC}" xmlns:x="urn:x" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'


def drawing(uri, inner=""):
    return f'<w:r><w:drawing><wp:inline><a:graphic><a:graphicData{f" uri={chr(34)}{uri}{chr(34)}" if uri else ""}>{inner}</a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'


def pict(inner):
    return f"<w:r><w:pict>{inner}</w:pict></w:r>"


TEXT = "<w:r><w:t>words</w:t></w:r>"
A = "http://schemas.openxmlformats.org/drawingml/2006/"
CASES = [
    (TEXT, "R19"), ("", "R19"), ('<w:pPr><w:pStyle w:val="Gone"/></w:pPr>' + TEXT, "R08"), ("<w:pPr><w:sectPr/></w:pPr>", "R10"), ("<w:pPr><w:sectPr/></w:pPr>" + TEXT, "R19"),
    ("<m:oMathPara><m:oMath/></m:oMathPara>" + TEXT, "R11"), ("<m:oMath/>", "R11"), ("<m:oMath/>" + TEXT, "R19"), (drawing(A + "chart") + TEXT, "R12"), (drawing("", "<c:chart/>"), "R12"), (drawing(A + "diagram"), "R13"),
    (drawing(A + "lockedCanvas"), "R14"), (drawing(A + "picture", "<pic:pic/>"), "R15"), (drawing(A + "picture") + TEXT, "R19"), (drawing(A + "picture") * 2, "R19"), (pict('<v:shape><v:imagedata/></v:shape>'), "R15"),
    (pict('<v:shape style="visibility:hidden"/>'), "R16"), (pict("<v:shapetype/>"), "R16"), (pict('<v:rect o:hr="t"/>'), "R17"), (pict('<v:rect o:hr="t"/>') + pict("<v:oval/>"), "R19"), ("<w:r><w:object/></w:r>", "R18"),
    (pict("<v:shape><v:imagedata/><v:textbox><w:txbxContent><w:p><w:r><w:t>in a box</w:t></w:r></w:p></w:txbxContent></v:textbox></v:shape>"), "R19"), ('<w:del w:id="1"><w:r><w:delText>x</w:delText></w:r></w:del>' + drawing(A + "picture"), "R15"),
]


def test_paragraph_rules(spark):
    body = "".join(f"<w:p>{x}</w:p>" for x, _ in CASES)
    nodes = docx.nodes(docx.parts(frame(spark, package(f"<w:document {NAMES}><w:body>{body}</w:body></w:document>"))).where("uri like '%document.xml'")).cache()
    hidden = spark.createDataFrame([(0, "Gone")], "doc_id long, style_id string")
    tops = nodes.where("local = 'p' and up = 'body'").select("doc_id", "part_id", F.col("node_id").alias("para"))
    rows = C.classify(C.paragraph_facts(nodes, hidden)).join(tops, ["doc_id", "part_id", "para"]).orderBy("pre").collect()
    assert [r.rule for r in rows] == [r for _, r in CASES]
    third = tops.orderBy("para").limit(1)
    assert C.classify(C.paragraph_facts(nodes, hidden, third)).where("rule = 'R09'").count() == 1
    assert {r.kind for r in C.objects(nodes).where("has_text").collect()} == {"textBox"}
    assert C.classify(C.paragraph_facts(nodes.limit(0))).count() == 0


def test_body_rules(spark):
    body = '<w:p/><w:tbl><w:tr><w:tc><w:tcPr/><w:p/></w:tc></w:tr></w:tbl><w:sdt/><w:bookmarkStart w:id="1"/><w:proofErr/><x:own/><w:br w:type=" page "/><w:br/><w:ins/><w:smartTag/><w:odd/><w:sectPr/>'
    nodes = docx.nodes(docx.parts(frame(spark, package(f"<w:document {NAMES}><w:body>{body}</w:body></w:document>"))).where("uri like '%document.xml'"))
    rows = C.body_children(nodes).orderBy("node_id").collect()
    assert [(r.rule, r["class"]) for r in rows] == [
        ("R19", "paragraph"), ("R02", "table"), ("R19", "paragraph"), ("R03", "sdt"), ("R04", "rangeMarker"), ("R04", "rangeMarker"), ("R07", "unknown"), ("R05", "pageBreak"), ("R05", "break"), ("R06", "insertion"), ("R06", "transparent"), ("R07", "unknown"), ("R01", "sectionProps")
    ]


def test_views(spark):
    ruby = "<w:p><w:r><w:ruby><w:rt><w:r><w:t>kan</w:t></w:r><w:r><w:t>ji</w:t></w:r></w:rt><w:rubyBase><w:r><w:t>漢字</w:t></w:r></w:rubyBase></w:ruby></w:r></w:p>"
    header = f'<w:hdr {NAMES}><w:p><w:r><w:instrText> page \\* x</w:instrText></w:r></w:p><w:p><w:fldSimple w:instr="NUMPAGES"/></w:p></w:hdr>'
    bib = f'<b:Sources xmlns:b="{C._BIB[0]}"><b:Source><b:Tag>Doe20</b:Tag><b:Title>On <b:i>it</b:i></b:Title></b:Source><b:Source><b:Year>1</b:Year></b:Source></b:Sources>'
    found = docx.parts(frame(spark, package(f"<w:document {NAMES}><w:body>{ruby}</w:body></w:document>", word__header1_xml="", **{"word__h.xml": header, "word__f.xml": f"<w:ftr {NAMES}/>", "customXml__item1.xml": bib})))
    nodes = docx.nodes(found.where("uri like '%.xml'")).cache()
    assert [(r.base, r.annotation) for r in C.ruby_texts(nodes).collect()] == [("漢字", "kanji")]
    assert sorted((r.kind, r.n_paragraphs, r.has_page_number, r.has_page_count) for r in C.header_footer_parts(nodes).collect()) == [("footer", 0, False, False), ("header", 2, True, True)]
    assert sorted((r.tag or "", r.fields.get("Title"), r.fields.get("Year")) for r in C.sources(nodes).collect()) == [("", None, "1"), ("Doe20", "On it", None)]
