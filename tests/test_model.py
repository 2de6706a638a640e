import colorsys

import pytest
from pyspark.sql import functions as F

from leafpress.functions import formula
from leafpress.functions import text as T
from leafpress.functions import values as V
from leafpress.operators import model as M
from leafpress.operators import xpath as X
from leafpress.sources import docx

W = f'xmlns:w="{docx.W}" xmlns:r="{docx.R}"'
BODY = f"""<w:document {W}><w:body>
<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> TOC \\o "1-2" </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r></w:p>
<w:p><w:r><w:fldChar w:fldCharType="begin"/><w:instrText>PA</w:instrText><w:instrText>GE</w:instrText><w:fldChar w:fldCharType="end"/></w:r></w:p>
<w:p><w:r><w:fldChar w:fldCharType="end"/></w:r><w:bookmarkStart w:id="1" w:name="b"/><w:r><w:t>x</w:t></w:r><w:bookmarkEnd w:id="1"/><w:bookmarkEnd w:id="9"/>
<w:ins w:id="5" w:author="A" w:date="d"><w:r><w:rPr><w:rPrChange w:id="6" w:author="B"/></w:rPr><w:t>y</w:t></w:r></w:ins></w:p>
<w:tbl><w:tr><w:tc><w:tcPr><w:tcW w:w="100"/><w:gridSpan w:val="2"/><w:vMerge w:val="restart"/></w:tcPr><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>
<w:sdt><w:sdtPr><w:alias w:val="A"/><w:lock w:val="sdtContentLocked"/></w:sdtPr><w:sdtContent/></w:sdt>
<w:p><w:pPr><w:sectPr><w:headerReference w:type="default" r:id="h1"/><w:titlePg/></w:sectPr></w:pPr></w:p><w:sectPr><w:headerReference w:type="first" r:id="h2"/><w:pgSz w:w="200" w:h="100" w:orient="landscape"/></w:sectPr></w:body></w:document>"""
STYLES = f"""<w:styles {W}><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="H"><w:name w:val="heading 2"/><w:basedOn w:val="N"/><w:rPr><w:b/><w:i w:val="0"/><w:sz w:val="28"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="K"><w:basedOn w:val="H"/></w:style><w:style w:type="character" w:styleId="C"><w:basedOn w:val="H"/></w:style></w:styles>"""
NUMBERS = f"""<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="2"/><w:numFmt w:val="lowerRoman"/></w:lvl></w:abstractNum>
<w:num w:numId="3"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="1"><w:startOverride w:val="9"/></w:lvlOverride></w:num></w:numbering>"""


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(1, i, bytearray(x.encode())) for i, x in enumerate((BODY, STYLES, NUMBERS))]
    return docx.nodes(spark.createDataFrame(rows, "doc_id long, part_id int, bytes binary")).cache()


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_fields(nodes):
    assert rows(M.fields(nodes).orderBy("begin_pos"), "instr", "keyword", "policy", "level") == [(' TOC \\o "1-2" ', "TOC", "Block", 1), ("PAGE", "PAGE", "Atom", 2)]


def test_ranges_and_revisions(nodes):
    assert sorted(rows(M.ranges(nodes).where("kind = 'bookmark'"), "id", "name", "status")) == [("1", "b", "paired"), ("9", None, "orphan end")]
    assert rows(M.revisions(nodes).orderBy("post"), "kind", "id", "author", "owner") == [("run properties", "6", "B", "paragraph mark"), ("insertion", "5", "A", "content")]


def test_tables_and_controls(nodes):
    assert rows(M.cells(nodes).orderBy("row_ix", "cell_ix"), "row_ix", "col_ix", "span", "width", "continues") == [(0, 0, 2, 100, False), (0, 2, 1, None, False), (1, 0, 2, None, True), (1, 2, 1, None, False)]
    assert rows(M.controls(nodes), "alias", "refusal") == [("A", "locked")]


def test_sections(nodes):
    got = rows(M.sections(nodes).orderBy("section_ix"), "section_ix", "width", "orient", "title_page")
    assert got == [(0, 11906, "portrait", True), (1, 200, "landscape", False)]
    slots = rows(M.header_slots(nodes).where("kind = 'header'").orderBy("section_ix", "variant"), "section_ix", "variant", "effective")
    assert slots == [(0, "default", "h1"), (0, "even", None), (0, "first", None), (1, "default", "h1"), (1, "even", None), (1, "first", "h2")]


def test_declarations(nodes):
    s = M.styles(nodes)
    assert rows(s.orderBy("style_id"), "style_id", "kind", "b", "i", "sz") == [("C", "character", None, None, None), ("H", "paragraph", True, False, 28), ("K", "paragraph", None, None, None), ("N", "paragraph", None, None, None)]
    assert sorted(rows(M.heading_levels(s), "style_id", "level")) == [("H", 2), ("K", 2)]
    assert sorted(rows(M.default_styles(s), "kind", "style_id")) == [("character", "C"), ("paragraph", "N")]
    assert rows(M.numbering_levels(nodes).orderBy("ilvl"), "num_id", "ilvl", "start", "fmt", "text") == [("3", 0, 1, "decimal", "%1."), ("3", 1, 9, "lowerRoman", None)]


@pytest.mark.parametrize("path, n", [("//w:p", 8), ("/w:document/w:body/w:p", 4), ("//w:tc/w:p", 4), ("//w:tr[2]/w:tc[last()]", 1), ("//w:ins[@w:author='A']//w:t", 1), ("//w:p[w:bookmarkStart]", 1), ("//w:nope", 0), ("//w:t/text()", 2), ("//w:instrText/..", 2)])
def test_xpath(nodes, path, n):
    main = nodes.where("part_id = 0")
    assert X.evaluate(main, f"count({path})").first().value == str(n)


def test_xpath_values(nodes):
    main = nodes.where("part_id = 0")
    assert X.evaluate(main, "string(//w:ins)").first().value == "y"
    assert X.evaluate(main, "normalize-space(//w:instrText)").first().value == 'TOC \\o "1-2"'
    assert X.evaluate(main, "string(//w:bookmarkStart/@w:name)").first().value == "b"
    with pytest.raises(ValueError):
        X.parse("//a[position()>1")


def test_canonical(spark, nodes):
    a = '<a xmlns:p="u"><p:b y="2" x="1">t</p:b></a>'
    b = '<a xmlns:q="u"><q:b x="1" y="2">t</q:b></a>'
    c = '<a xmlns:q="u"><q:b x="1" y="3">t</q:b></a>'
    n = docx.nodes(spark.createDataFrame([(i, 0, bytearray(x.encode())) for i, x in enumerate((a, b, c))], "doc_id long, part_id int, bytes binary"))
    one, two, three = (r.canonical for r in M.canonical(n).orderBy("doc_id").collect())
    assert one == two != three
    d = spark.createDataFrame([(one, two), (one, three)], "l string, r string").select(M.first_difference(F.col("l"), F.col("r")).alias("d")).collect()
    assert d[0].d is None and d[1].d.line == 2


def test_formula(spark):
    m = 'xmlns:m="urn:m"'
    xml = f"<m:oMath {m}><m:f><m:num><m:r><m:t>α+1</m:t></m:r></m:num><m:den><m:rad><m:deg/><m:e><m:r><m:t>x</m:t></m:r></m:e></m:rad></m:den></m:f><m:sSup><m:e><m:r><m:t>y</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath>"
    r = spark.createDataFrame([(xml,), ("<broken",), (None,)], "x string").select(formula.to_latex("x").alias("l"), formula.math_tokens("x").alias("t"), formula.to_mathml("x").alias("m")).collect()
    assert r[0].l == "\\frac{\\alpha +1}{\\sqrt{x}}{y}^{2}" and r[0].t == ["α+1", "x", "y", "2"] and "<msup>" in r[0].m
    assert r[1].l is None and r[2].l is None


def test_colours_and_symbols(spark):
    for rgb, by in (("4F81BD", [("lumMod", 0.75)]), ("C0504D", [("lumMod", 0.4), ("lumOff", 0.6)]), ("808080", [("satMod", 2.0)]), ("00FF7F", [("hueOff", 0.25)])):
        h, li, s = colorsys.rgb_to_hls(*[int(rgb[i : i + 2], 16) / 255 for i in (0, 2, 4)])
        for k, x in by:
            li = min(1, li * x) if k == "lumMod" else min(1, li + x) if k == "lumOff" else li
            s = min(1, s * x) if k == "satMod" else s
            h = (h + x) % 1 if k == "hueOff" else h
        want = "".join(f"{int(c * 255 + 0.5):02X}" for c in colorsys.hls_to_rgb(h, li, s))
        assert spark.range(1).select(V.transform_colour(F.lit(rgb), by)).first()[0] == want
    r = spark.range(1).select(T.decode_symbol(F.lit("Symbol"), F.lit("F061")), T.decode_symbol(F.lit("Wingdings"), F.lit("41")), T.fold_full(F.lit("ｶﾞ　Ａ"))).first()
    assert tuple(r) == ("α", "", "ガ A")


def test_heading_levels_from_far_styles(spark):
    rows = [(1, f"s{i}", f"s{i + 1}" if i < 14 else "Heading2", "paragraph", f"n{i}") for i in range(15)] + [(1, "Heading2", None, "paragraph", "heading 2")]
    s = spark.createDataFrame(rows, "doc_id long, style_id string, based_on string, kind string, name string")
    assert {(r.style_id, r.level) for r in M.heading_levels(s).collect()} == {(f"s{i}", 2) for i in range(15)} | {("Heading2", 2)}
