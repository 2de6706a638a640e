"""What a paragraph is: facts from one aggregation of its nodes, then ordered rules, the first of which counts.

Also small views that the same nodes give: drawings and pictures, headers and footers, annotated text, sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.sources.docx import W_STRICT, W, string_values

KEYS = ["doc_id", "part_id"]
# Namespaces of drawings, and what each holds.
_A = "http://schemas.openxmlformats.org/drawingml/2006/"
_MS = "http://schemas.microsoft.com/office/"
GRAPHICS = {
    f"{_A}picture": "picture", f"{_A}chart": "chart", f"{_MS}drawing/2014/chartex": "chartEx", f"{_A}diagram": "diagram", f"{_A}lockedCanvas": "lockedCanvas",
    f"{_MS}word/2010/wordprocessingShape": "shape", f"{_MS}word/2010/wordprocessingGroup": "group", f"{_MS}word/2010/wordprocessingCanvas": "group", f"{_MS}word/2010/wordprocessingInk": "ink",
}
_VML, _OFFICE = "urn:schemas-microsoft-com:vml", "urn:schemas-microsoft-com:office:office"
_MATH = ("http://schemas.openxmlformats.org/officeDocument/2006/math", "http://purl.oclc.org/ooxml/officeDocument/math")
_BIB = ("http://schemas.openxmlformats.org/officeDocument/2006/bibliography", "http://purl.oclc.org/ooxml/officeDocument/bibliography")
_MARKERS = "bookmarkStart bookmarkEnd commentRangeStart commentRangeEnd moveFromRangeStart moveFromRangeEnd moveToRangeStart moveToRangeEnd permStart permEnd customXmlInsRangeStart customXmlInsRangeEnd customXmlDelRangeStart customXmlDelRangeEnd proofErr".split()


def _word() -> Column:
    return F.col("ns").isin(W, W_STRICT)


def _val(name: str) -> Column:
    return F.coalesce(F.col("attrs")[f"{{{W}}}{name}"], F.col("attrs")[f"{{{W_STRICT}}}{name}"], F.col("attrs")[name])


def _any(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def objects(all_nodes: DataFrame) -> DataFrame:
    """doc_id, part_id, obj, para, holder (drawing, pict, object), kind, anchored, has_text, has_blip, hidden of every object.

    A drawing's kind comes from the address of its graphic data, else from the namespace of what is in it. Of
    an old picture's kinds a text box comes before word art, an image, a hidden shape and a rule.
    """
    rows = all_nodes.where(F.col("active") & F.col("obj").isNotNull())
    itself, local, vml = F.col("node_id") == F.col("obj"), F.col("local"), F.col("ns") == _VML
    graphics = F.create_map(*[F.lit(x) for kv in GRAPHICS.items() for x in kv])
    shapes = local.isin("shape", "rect", "oval", "roundrect", "line") & vml
    facts = rows.groupBy(*KEYS, "obj").agg(
        F.max(F.when(itself, local)).alias("holder"), F.max(F.when(itself, F.col("para"))).alias("para"),
        F.min(F.when(local == "graphicData", graphics[F.col("attrs")["uri"]])).alias("by_uri"), F.min(F.when(F.col("up") == "graphicData", graphics[F.col("ns")])).alias("by_ns"),
        _any(local == "anchor").alias("anchored"), _any(local.isin("txbxContent", "textbox")).alias("has_text"), _any(local == "blip").alias("has_blip"),
        _any(vml & (local == "textbox")).alias("textbox"), _any(vml & (local == "textpath") & F.col("attrs")["string"].isNotNull()).alias("word_art"), _any(vml & (local == "imagedata")).alias("image"),
        _any(shapes & F.contains(F.col("attrs")["style"], F.lit("visibility:hidden"))).alias("hidden"), _any(vml & (local == "rect") & F.col("attrs")[f"{{{_OFFICE}}}hr"].isNotNull()).alias("rule"),
        F.count_if((F.col("parent_id") == F.col("obj")) & (local != "#text")).alias("own"), F.count_if((F.col("parent_id") == F.col("obj")) & vml & (local == "shapetype")).alias("types"),
    )
    pict = F.when((F.col("own") > 0) & (F.col("own") == F.col("types")), "shapeTypeOnly")
    for flag, name in (("textbox", "textBox"), ("word_art", "wordArt"), ("image", "imageData"), ("hidden", "hidden"), ("rule", "hr")):
        pict = pict.when(F.col(flag), name)
    kind = F.when(F.col("holder") == "drawing", F.coalesce("by_uri", "by_ns", F.lit("unknown"))).when(F.col("holder") == "pict", pict.otherwise("other")).otherwise("ole")
    return facts.select(*KEYS, "obj", "para", "holder", kind.alias("kind"), "anchored", "has_text", "has_blip", "hidden")


def paragraph_facts(all_nodes: DataFrame, hidden_styles: DataFrame | None = None, field_results: DataFrame | None = None) -> DataFrame:
    """A row a paragraph: what it holds and where it stands. hidden_styles has (doc_id, style_id), field_results (doc_id, part_id, para)."""
    live = all_nodes.where(F.col("active"))
    deep, local = F.col("depth") - F.col("para_depth"), F.col("local")
    itself = _word() & (local == "p")
    text = _word() & (F.col("up") == "r") & ((local == "t") & (F.trim(F.coalesce("inner", F.lit(""))) != "") | (local == "sym")) & ~F.coalesce("rev", F.lit("")).isin("del", "moveFrom")
    math = F.col("ns").isin(*_MATH)
    rows = live.withColumn("own", F.when(itself, F.col("node_id")).otherwise(F.col("para"))).where("own is not null")
    facts = rows.groupBy(*KEYS, F.col("own").alias("para")).agg(
        F.min(F.when(itself, F.col("pre"))).alias("pre"), _any(text).alias("visible_text"), _any(_word() & (local == "sectPr") & (F.col("up") == "pPr") & (deep == 2)).alias("has_section"),
        _any(math & (local == "oMathPara")).alias("math_para"), F.count_if(math & (local == "oMath")).alias("n_math"), F.max(F.when(_word() & (local == "pStyle") & (F.col("up") == "pPr") & (deep == 2), _val("val"))).alias("style_id"),
    )
    held = objects(all_nodes).where("para is not null").groupBy(*KEYS, "para").agg(F.collect_list(F.struct("holder", "kind")).alias("objects"))
    facts = facts.join(held, [*KEYS, "para"], "left").withColumn("objects", F.coalesce("objects", F.array().cast("array<struct<holder: string, kind: string>>")))
    if hidden_styles is not None:
        facts = facts.join(hidden_styles.select("doc_id", "style_id", F.lit(True).alias("vanishes")).distinct(), ["doc_id", "style_id"], "left")
    if field_results is not None:
        facts = facts.join(field_results.select(*KEYS, "para", F.lit(True).alias("in_field")).distinct(), [*KEYS, "para"], "left")
    for name in ("vanishes", "in_field"):
        facts = facts.withColumn(name, F.coalesce(F.col(name), F.lit(False)) if name in facts.columns else F.lit(False))
    return facts


def classify(facts: DataFrame) -> DataFrame:
    """facts with rule (R08 to R19) and class of each paragraph: the first rule that holds."""
    of = lambda holder: F.filter("objects", lambda o: o["holder"] == holder)
    has = lambda kind: F.exists("objects", lambda o: o["kind"] == kind)
    drawings, picts, ole = F.size(of("drawing")), F.size(of("pict")), F.size(of("object"))
    bare, only_picts = ~F.col("visible_text"), (picts > 0) & (drawings == 0) & (ole == 0)
    all_picts = lambda *kinds: F.forall(of("pict"), lambda o: o["kind"].isin(*kinds))
    one_image = (drawings == 1) & (picts == 0) & has("picture") | (picts == 1) & (drawings == 0) & has("imageData")
    rules = [
        ("R08", "invisible", F.col("vanishes")), ("R09", "fieldResult", F.col("in_field")), ("R10", "sectionBreak", F.col("has_section") & bare), ("R11", "equation", F.col("math_para") | (F.col("n_math") > 0) & bare),
        ("R12", "chart", has("chart") | has("chartEx")), ("R13", "smartArt", has("diagram")), ("R14", "lockedCanvas", has("lockedCanvas")), ("R15", "image", bare & (ole == 0) & (F.col("n_math") == 0) & one_image),
        ("R16", "invisible", bare & only_picts & all_picts("hidden", "shapeTypeOnly")), ("R17", "rule", bare & only_picts & all_picts("hr")), ("R18", "ole", bare & (ole > 0) & (drawings == 0) & (picts == 0)),
    ]
    rule, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, what, holds in reversed(rules):
        rule, kind = F.when(holds, name).otherwise(rule), F.when(holds, what).otherwise(kind)
    return facts.withColumn("rule", F.coalesce(rule, F.lit("R19"))).withColumn("class", F.coalesce(kind, F.lit("text")))


def body_children(all_nodes: DataFrame) -> DataFrame:
    """doc_id, part_id, node_id, rule (R01 to R07, R19), class of what stands straight in a body, header, footer, note or cell."""
    rows = all_nodes.where(F.col("active") & F.col("up").isin("body", "hdr", "ftr", "footnote", "endnote", "comment", "tc", "txbxContent") & (F.col("local") != "#text") & ~F.col("local").isin("tcPr"))
    local = F.col("local")
    is_ = lambda rule, kind: F.struct(F.lit(rule).alias("rule"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("class"))
    what = F.when(_word() & local.isin(*_MARKERS), is_("R04", "rangeMarker")).when(~_word(), is_("R07", "unknown"))
    for rule, name, kind in (("R01", "sectPr", "sectionProps"), ("R02", "tbl", "table"), ("R03", "sdt", "sdt"), ("R06", "ins", "insertion"), ("R06", "del", "deletion"), ("R06", "moveFrom", "moveSource"), ("R06", "moveTo", "moveTarget"), ("R06", "customXml", "transparent"), ("R06", "smartTag", "transparent"), ("R19", "p", "paragraph")):
        what = what.when(local == name, is_(rule, kind))
    what = what.when(local == "br", is_("R05", F.when(F.trim(_val("type")) == "page", F.lit("pageBreak")).otherwise(F.lit("break")))).otherwise(is_("R07", "unknown"))
    return rows.select(*KEYS, "node_id", "local", what.alias("x")).select(*KEYS, "node_id", "local", "x.rule", "x.class")


def header_footer_parts(all_nodes: DataFrame) -> DataFrame:
    """doc_id, part_id, kind, n_paragraphs, has_page_number, has_page_count of header and footer parts."""
    roots = all_nodes.where(_word() & F.col("parent_id").isNull() & F.col("local").isin("hdr", "ftr")).select(*KEYS, F.when(F.col("local") == "hdr", "header").otherwise("footer").alias("kind"))
    code = F.upper(F.trim(F.coalesce(F.when(F.col("local") == "instrText", F.col("inner")), F.when(F.col("local") == "fldSimple", _val("instr")))))
    rows = all_nodes.where(F.col("active") & _word()).join(roots, KEYS)
    return rows.groupBy(*KEYS, "kind").agg(F.count_if(F.col("local") == "p").alias("n_paragraphs"), _any(code.rlike("^PAGE( |$)")).alias("has_page_number"), _any(code.rlike("^(NUMPAGES|SECTIONPAGES)( |$)")).alias("has_page_count"))


def ruby_texts(all_nodes: DataFrame) -> DataFrame:
    """doc_id, part_id, node_id, base, annotation of annotated text."""
    halves = all_nodes.where(F.col("active") & _word() & (F.col("up") == "ruby") & F.col("local").isin("rt", "rubyBase"))
    texts = string_values(all_nodes, halves).join(halves.select(*KEYS, "node_id", "parent_id", "local"), [*KEYS, "node_id"])
    return texts.groupBy(*KEYS, F.col("parent_id").alias("node_id")).agg(F.max(F.when(F.col("local") == "rubyBase", F.col("value"))).alias("base"), F.max(F.when(F.col("local") == "rt", F.col("value"))).alias("annotation"))


def sources(all_nodes: DataFrame) -> DataFrame:
    """doc_id, part_id, node_id, tag, fields (a map of the plain ones) of bibliography sources."""
    cells = all_nodes.where(F.col("ns").isin(*_BIB) & (F.col("up") == "Source"))
    texts = string_values(all_nodes, cells).join(cells.select(*KEYS, "node_id", "parent_id", "local"), [*KEYS, "node_id"])
    rows = texts.groupBy(*KEYS, F.col("parent_id").alias("node_id")).agg(F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list(F.struct("local", "value"))))).alias("fields"))
    return rows.select(*KEYS, "node_id", F.try_element_at("fields", F.lit("Tag")).alias("tag"), "fields")
