"""Word-processing packages as DataFrames: parts, relationships, nodes, blocks and segments, and back to bytes.

Only the parse from bytes to rows and the fold from rows to bytes are Python, in Arrow batches; all
that lies between is DataFrame code. Nodes carry pre and post numbers, so ancestors and descendants are
interval joins inside (doc_id, part_id), and lexical byte ranges, so that untouched XML is copied.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafpress.functions.text import OBJECT, col, trim_xml_space, utf16_length
from leafpress.operators.structure import unreachable
from leafpress.sources import zipio

# Namespaces.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
W_STRICT = "http://purl.oclc.org/ooxml/wordprocessingml/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
R_STRICT = "http://purl.oclc.org/ooxml/officeDocument/relationships"
OWNED_KINDS = "image chart chartEx diagramData diagramLayout diagramQuickStyle diagramColors diagramDrawing hyperlink oleObject".split()
MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"
XML = "http://www.w3.org/XML/1998/namespace"
CONTENT_TYPES = "[Content_Types].xml"
MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"

PARTS = "doc_id long, part_id int, uri string, crc32 long, size long, bytes binary, error string"
NODES = "doc_id long, part_id int, node_id int, parent_id int, ord int, depth int, pre int, post int, ns string, local string, attrs map<string,string>, text string, lex_start long, lex_end long, active boolean, up string, para int, para_depth int, in_cell boolean, rev string, obj int, inner string"


def read_packages(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """Files to packages: doc_id (a hash of the path), path, content, sha256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content", F.sha2("content", 256).alias("sha256"))


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("part_id", pa.int32()), ("uri", pa.string()), ("crc32", pa.int64()), ("size", pa.int64()), ("bytes", pa.binary()), ("error", pa.string())])
    for batch in batches:
        for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            try:
                for i, e in enumerate(zipio.directory(content or b"")):
                    if e.name.endswith("/"):
                        continue
                    try:
                        rows.append((doc_id, i, "/" + e.name.lstrip("/"), e.crc, e.size, zipio.read(content, e), None))
                    except zipio.Broken as why:
                        rows.append((doc_id, i, "/" + e.name.lstrip("/"), e.crc, e.size, None, str(why)))
            except zipio.Broken as why:
                rows.append((doc_id, None, None, None, None, None, str(why)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def parts(packages: DataFrame) -> DataFrame:
    """A row for each part, or one with an error for a package or part that can't be read; others aren't hurt."""
    return packages.select("doc_id", "content").mapInArrow(_unzip, PARTS)


def _nodes_of(doc_id: int, part_id: int, data: bytes, understood: frozenset[str]) -> list[tuple]:
    """All elements and texts of an XML part, in document order."""
    rows: list[list] = []
    stack: list[int] = []
    live: list[bool] = []
    counts: list[int] = [0]
    clock = [0, 0]
    choice: dict[int, bool] = {}
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    scope: dict[str, list[str]] = {}
    # What is around a node: the closest paragraph with its depth, whether a table cell, the closest revision, the closest object.
    around: list[tuple] = [(None, None, False, None, None)]

    def refuse(*_):
        raise expat.ExpatError("entities are not read")

    def split(name: str) -> tuple[str, str]:
        ns, _, local = name.rpartition("}")
        return ns, local

    def add(ns: str | None, local: str, attrs: dict, text: str | None, active: bool) -> int:
        rows.append([doc_id, part_id, len(rows), stack[-1] if stack else None, counts[-1], len(stack), clock[0], None, ns, local, attrs, text, parser.CurrentByteIndex, None, active, rows[stack[-1]][9] if stack else None, *around[-1], None])
        counts[-1] += 1
        clock[0] += 1
        return len(rows) - 1

    def start(name: str, attrs: dict) -> None:
        ns, local = split(name)
        active = live[-1] if live else True
        own = {(f"{{{split(k)[0]}}}{split(k)[1]}" if "}" in k else k): v for k, v in attrs.items()}
        if ns == MC and stack and rows[stack[-1]][9] == "AlternateContent":
            up = stack[-1]
            if local == "Choice":
                needs = [scope.get(p, [""])[-1] for p in own.get("Requires", "").split()]
                take = not choice.get(up) and all(n in understood for n in needs)
            else:
                take = not choice.get(up)
            choice[up] = choice.get(up, False) or take
            active = active and take
        i = add(ns, local, own, None, active)
        stack.append(i)
        live.append(active)
        counts.append(0)
        if active and ns in (W, W_STRICT):
            para, depth, cell, rev, obj = around[-1]
            if local == "p":
                para, depth, obj = i, len(stack) - 1, None
            if local in OBJECTS:
                rows[i][-2] = obj = i
            around.append((para, depth, cell or local == "tc", local if local in REVISED else rev, obj))
        else:
            around.append(around[-1])

    def end(_: str) -> None:
        i = stack.pop()
        live.pop()
        counts.pop()
        around.pop()
        rows[i][7] = clock[1]
        clock[1] += 1
        close = data.find(b">", parser.CurrentByteIndex)
        rows[i][13] = close + 1 if close >= 0 else len(data)

    def chars(text: str) -> None:
        i = add(None, "#text", {}, text, live[-1])
        rows[i][7] = clock[1]
        clock[1] += 1
        rows[i][13] = parser.CurrentByteIndex
        if stack and rows[stack[-1]][9] in TEXTS:
            rows[stack[-1]][-1] = (rows[stack[-1]][-1] or "") + text

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    parser.StartNamespaceDeclHandler = lambda p, u: scope.setdefault(p or "", []).append(u or "")
    parser.EndNamespaceDeclHandler = lambda p: scope[p or ""].pop()
    parser.EntityDeclHandler = refuse
    parser.Parse(data, True)
    # A later sibling's start ends the one before: post numbers above nest as pre numbers do.
    return [tuple(r) for r in rows]


def broken_parts(xml_parts: DataFrame) -> DataFrame:
    """doc_id, part_id, error of the XML parts that don't parse, entities and all; nodes() gives them no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, part_id, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    _nodes_of(doc_id, part_id, data, frozenset())
                except expat.ExpatError as why:
                    rows.append((doc_id, part_id, str(why)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string()))], names=["doc_id", "part_id", "error"])

    return xml_parts.where("bytes is not null").select("doc_id", "part_id", "bytes").mapInArrow(run, "doc_id long, part_id int, error string")


def nodes(xml_parts: DataFrame, understood: tuple[str, ...] = ()) -> DataFrame:
    """Elements and texts of XML parts; a part that doesn't parse gives no nodes. active is false in branches of
    alternate content that aren't taken. up is the parent's name; para (with its depth), in_cell and rev tell the closest
    paragraph, whether a cell and which revision is around; obj is the drawing, picture or object that the node is or stands in; inner is the text straight inside a text element."""
    known = frozenset(understood)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), *[pa.int32()] * 7, pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.string()]
        names = [c.split()[0] for c in NODES.split(", ")]
        for batch in batches:
            for doc_id, part_id, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    rows = _nodes_of(doc_id, part_id, data or b"", known)
                except expat.ExpatError:
                    continue
                cols = list(zip(*rows))
                cols[10] = [list(m.items()) for m in cols[10]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return xml_parts.where("bytes is not null").select("doc_id", "part_id", "bytes").mapInArrow(run, NODES)


def resolve_target(base: Column | str, target: Column | str) -> Column:
    """A relationship's target as a part URI: absolute or against the folder of `base`; null if it leaves the root."""
    t = F.url_decode(F.replace(col(target), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_replace(col(base), "[^/]*$", "")
    steps = F.split(F.when(t.startswith("/"), t).otherwise(F.concat(folder, t)), "/")
    start = F.struct(F.array().cast("array<string>").alias("s"), F.lit(True).alias("ok"))

    def step(a: Column, x: Column) -> Column:
        up = F.struct(F.slice(a["s"], 1, F.greatest(F.size(a["s"]) - 1, F.lit(0))).alias("s"), (a["ok"] & (F.size(a["s"]) > 0)).alias("ok"))
        return F.when(x.isin("", "."), a).when(x == "..", up).otherwise(F.struct(F.concat(a["s"], F.array(x)).alias("s"), a["ok"].alias("ok")))

    done = F.aggregate(steps, start, step)
    return F.when(done["ok"], F.concat(F.lit("/"), F.array_join(done["s"], "/")))


def relationships(all_parts: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """doc_id, source_uri, rel_id, kind, mode, target, target_uri; of repeated ids the last counts."""
    rels = all_parts.where("uri like '%.rels'").select("doc_id", "part_id", "uri")
    source = F.regexp_replace(F.regexp_replace("uri", r"/_rels/([^/]*)\.rels$", "/$1"), "^$", "/")
    rows = all_nodes.where("local = 'Relationship'").join(rels, ["doc_id", "part_id"])
    last = F.row_number().over(Window.partitionBy("doc_id", "part_id", F.col("attrs")["Id"]).orderBy(F.desc("pre")))
    rows = rows.withColumn("nth", last).where("nth = 1")
    mode = F.coalesce(F.col("attrs")["TargetMode"], F.lit("Internal"))
    return rows.select(
        "doc_id", source.alias("source_uri"), F.col("attrs")["Id"].alias("rel_id"), F.regexp_extract(F.col("attrs")["Type"], "([^/]+)$", 1).alias("kind"), mode.alias("mode"),
        F.col("attrs")["Target"].alias("target"), F.when(mode == "Internal", resolve_target(source, F.col("attrs")["Target"])).alias("target_uri"),
    )


def referenced_rids(all_nodes: DataFrame) -> DataFrame:
    """doc_id, part_id, rel_id: values of attributes in the relationships namespace, and any that begin with rId; inactive branches count."""
    rows = all_nodes.select("doc_id", "part_id", F.explode("attrs").alias("name", "value")).withColumn("rel_id", F.trim("value"))
    named = F.col("name").startswith(f"{{{R}}}") | F.col("name").startswith(f"{{{R_STRICT}}}")
    return rows.where((named | F.col("rel_id").startswith("rId")) & (F.col("rel_id") != "")).select("doc_id", "part_id", "rel_id").distinct()


def orphan_parts(all_parts: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """doc_id, uri of media, charts, embeddings and diagrams that no chain of relationships from the package reaches.

    A relationship of a kind that the document's XML refers to (OWNED_KINDS) counts only where its id is referenced.
    """
    uri = F.lower("uri")
    used = referenced_rids(all_nodes).join(all_parts.select("doc_id", "part_id", uri.alias("source")), ["doc_id", "part_id"]).select("doc_id", "source", "rel_id", F.lit(True).alias("used"))
    rels = relationships(all_parts, all_nodes).where("target_uri is not null").select("doc_id", F.lower("source_uri").alias("source"), "rel_id", "kind", F.lower("target_uri").alias("target"))
    live = rels.join(used, ["doc_id", "source", "rel_id"], "left").where(F.col("used") | ~F.col("kind").isin(*OWNED_KINDS))
    owned = all_parts.where(uri.rlike("^/word/(media|charts|embeddings|diagrams)/") & ~uri.endswith(".rels")).select("doc_id", uri.alias("id"), "uri")
    return unreachable(owned, live.select("doc_id", "source", "target"), all_parts.select("doc_id", F.lit("/").alias("id"))).select("doc_id", "uri")


def content_types(all_parts: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """doc_id, uri, content_type: an override by name, else the default of the extension."""
    here = all_parts.where(F.col("uri") == "/" + CONTENT_TYPES).select("doc_id", "part_id")
    rows = all_nodes.join(here, ["doc_id", "part_id"])
    override = rows.where("local = 'Override'").select("doc_id", F.lower(F.col("attrs")["PartName"]).alias("key"), F.col("attrs")["ContentType"].alias("o"))
    default = rows.where("local = 'Default'").select("doc_id", F.lower(F.col("attrs")["Extension"]).alias("ext"), F.col("attrs")["ContentType"].alias("d"))
    named = all_parts.select("doc_id", "part_id", "uri", F.lower("uri").alias("key"), F.lower(F.regexp_extract("uri", r"\.([^./]+)$", 1)).alias("ext"))
    return named.join(override, ["doc_id", "key"], "left").join(default, ["doc_id", "ext"], "left").select("doc_id", "part_id", "uri", F.coalesce("o", "d").alias("content_type"))


def ancestors(all_nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (node_id, ancestor_id, distance) for the nodes in `of`: an interval join on pre and post numbers."""
    a = all_nodes.select("doc_id", "part_id", F.col("node_id").alias("ancestor_id"), F.col("pre").alias("a_pre"), F.col("post").alias("a_post"), F.col("depth").alias("a_depth"))
    return of.join(a, ["doc_id", "part_id"]).where("a_pre < pre and a_post > post").select("doc_id", "part_id", "node_id", "ancestor_id", (F.col("depth") - F.col("a_depth")).alias("distance"))


def descendants(all_nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (node_id, descendant_id) for the nodes in `of`."""
    d = all_nodes.select("doc_id", "part_id", F.col("node_id").alias("descendant_id"), F.col("pre").alias("d_pre"), F.col("post").alias("d_post"))
    return of.join(d, ["doc_id", "part_id"]).where("d_pre > pre and d_post < post").select("doc_id", "part_id", "node_id", "descendant_id")


def next_sibling(all_nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "part_id", "parent_id").orderBy("ord")
    return all_nodes.withColumn("next_id", F.lead("node_id").over(w))


def flavour(all_nodes: DataFrame) -> DataFrame:
    """Strict or transitional, by the namespace of each part's root."""
    return all_nodes.where("parent_id is null").select("doc_id", "part_id", F.when(F.col("ns").startswith("http://purl.oclc.org/ooxml/"), "strict").otherwise("transitional").alias("flavour"))


def string_values(all_nodes: DataFrame, of: DataFrame) -> DataFrame:
    """The text below each node of `of`, in order."""
    t = all_nodes.where("local = '#text'").select("doc_id", "part_id", F.col("pre").alias("t_pre"), F.col("post").alias("t_post"), F.col("text").alias("t"))
    below = of.join(t, ["doc_id", "part_id"]).where("t_pre > pre and t_post < post")
    return below.groupBy("doc_id", "part_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_pre", "t"))), lambda x: x["t"]), "").alias("value"))


def _in_word() -> Column:
    return F.col("ns").isin(W, W_STRICT)


#: Elements around a run that mark it as changed, and those that hold text of their own.
REVISED = ("ins", "del", "moveFrom", "moveTo")
OBJECTS = ("drawing", "pict", "object")
TEXTS = ("t", "delText", "instrText", "delInstrText")
#: What elements of a run add to the text, by local name; an element that isn't here adds nothing.
SEGMENTS = {"tab": "\t", "ptab": "\t", "cr": "\n", "noBreakHyphen": "‑", "softHyphen": "\xad", **{k: OBJECT for k in ("drawing", "pict", "object", "ruby", "footnoteReference", "endnoteReference", "separator", "continuationSeparator")}}
ZERO_WIDTH = ("fldChar", "instrText", "delInstrText", "commentReference", "lastRenderedPageBreak", "annotationRef", "footnoteRef", "endnoteRef")


def _value(name: str) -> Column:
    return F.coalesce(F.col("attrs")[f"{{{W}}}{name}"], F.col("attrs")[f"{{{W_STRICT}}}{name}"])


def _piece_text() -> Column:
    """What an element of a run adds to its paragraph's text."""
    plain = F.create_map(*[F.lit(x) for kv in SEGMENTS.items() for x in kv])
    raw = trim_xml_space(F.coalesce("inner", F.lit("")), F.col("attrs")[f"{{{XML}}}space"].eqNullSafe("preserve"))
    code = F.conv(_value("char"), 16, 10).cast("int")
    return (
        F.when(F.col("local").isin("t", "delText"), raw).when(F.col("local").isin(*ZERO_WIDTH), "")
        .when(F.col("local") == "br", F.when(_value("type").isin("page", "column"), OBJECT).otherwise("\n"))
        .when(F.col("local") == "sym", F.decode(F.unhex(F.lpad(F.hex(F.lit(0xF000) + code % 256), 4, "0")), "UTF-16BE")).otherwise(plain[F.col("local")])
    )


def _is_piece() -> Column:
    return (F.col("up") == "r") & F.col("para").isNotNull() & F.col("local").isin(*SEGMENTS, "t", "delText", "br", "sym", *ZERO_WIDTH)


def segments(all_nodes: DataFrame) -> DataFrame:
    """Typed pieces of runs in document order: doc_id, part_id, para, node_id, pre, kind, text, utf16_start, utf16_len, rev.

    A piece belongs to the paragraph that holds it most closely; rev names the insertion, deletion or
    move around it. The parse has told both, so only offsets need the paragraph's rows together.
    """
    keys = ["doc_id", "part_id"]
    pieces = all_nodes.where(F.col("active") & _in_word() & _is_piece())
    out = pieces.select(*keys, "node_id", "para", "pre", F.col("local").alias("kind"), _piece_text().alias("text"), "rev").withColumn("utf16_len", utf16_length("text"))
    w = Window.partitionBy(*keys, "para").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("utf16_start", F.coalesce(F.sum("utf16_len").over(w), F.lit(0)).cast("long"))


def blocks(all_nodes: DataFrame) -> DataFrame:
    """Paragraphs in document order: doc_id, part_id, para, block_ix, style_id, num_id, ilvl, in_table, text, utf16_len.

    One aggregation of a paragraph's own nodes: itself, its properties and its pieces; a part's rows move once.
    """
    keys = ["doc_id", "part_id"]
    live = all_nodes.where(F.col("active") & _in_word())
    itself, deep = F.col("local") == "p", F.col("depth") - F.col("para_depth")
    direct = (F.col("up") == "pPr") & (deep == 2) & F.col("local").isin("pStyle", "outlineLvl") | (F.col("up") == "numPr") & (deep == 3) & F.col("local").isin("numId", "ilvl")
    rows = live.where(itself | direct | _is_piece()).select(
        *keys, F.when(itself, F.col("node_id")).otherwise(F.col("para")).alias("para"), "pre", "local", F.when(itself, F.col("in_cell")).alias("cell"), F.when(direct, _value("val")).alias("val"),
        F.when(_is_piece(), F.struct("pre", _piece_text().alias("text"))).alias("piece"),
    )
    of = lambda name: F.max(F.when(F.col("local") == name, F.col("val")))
    out = rows.repartition(*keys).groupBy(*keys, "para").agg(
        F.min(F.when(F.col("local") == "p", F.col("pre"))).alias("pre"), of("pStyle").alias("style_id"), of("numId").alias("num_id"), of("ilvl").alias("ilvl"), of("outlineLvl").alias("outline"), F.max("cell").alias("in_table"),
        F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["text"]), "").alias("text"),
    )
    nth = (F.row_number().over(Window.partitionBy(*keys).orderBy("pre")) - 1).cast("long")
    out = out.withColumn("block_ix", nth)
    level = F.coalesce(F.regexp_extract("style_id", "^[Hh]eading ?([1-9])$", 1).try_cast("int"), F.col("outline").try_cast("int") + 1)
    kind = F.when(level <= 9, "heading").when(F.col("num_id").isNotNull() & (F.col("num_id") != "0"), "list").otherwise("paragraph")
    return out.select(*keys, "para", "block_ix", kind.alias("text_kind"), F.when(level <= 9, level).alias("level"), "style_id", "num_id", F.col("ilvl").try_cast("int").alias("ilvl"), F.coalesce("in_table", F.lit(False)).alias("in_table"), "text", utf16_length("text").alias("utf16_len"))


def main_parts(all_parts: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """doc_id, part_id of each package's main part: by content type, else by name."""
    types = content_types(all_parts, all_nodes)
    rank = F.when(F.col("content_type") == MAIN, 0).when(F.lower("uri") == "/word/document.xml", 1)
    return types.withColumn("rank", rank).where("rank is not null").groupBy("doc_id").agg(F.min_by("part_id", F.struct("rank", "part_id")).alias("part_id"))


_BAD = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def blank_package(paragraphs: list[str]) -> bytes:
    """A minimal package with a paragraph for each text; characters that XML can't hold become U+FFFD."""
    from xml.sax.saxutils import escape

    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(_BAD.sub(chr(0xFFFD), p))}</w:t></w:r></w:p>' for p in paragraphs)
    return zipio.rewrite(
        None,
        {
            CONTENT_TYPES: f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{MAIN}"/></Types>'.encode(),
            "_rels/.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{R}/officeDocument" Target="word/document.xml"/></Relationships>'.encode(),
            "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}"><w:body>{body}<w:sectPr/></w:body></w:document>'.encode(),
        },
    )


def to_packages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content: each row's text as a package, a paragraph a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [blank_package((t or "").split("\n")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, content binary")


def save(packages: DataFrame, changed: DataFrame) -> DataFrame:
    """doc_id, content with some parts changed: `changed` has doc_id, uri, bytes (null takes a part out).

    A package without changes keeps its bytes; unchanged parts of the others are copied as they lie.
    """
    grouped = changed.groupBy("doc_id").agg(F.collect_list(F.struct("uri", "bytes")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [zipio.rewrite(c, {p["uri"].lstrip("/"): p["bytes"] for p in ps or []}) for c, ps in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return packages.select("doc_id", "content").join(grouped, "doc_id", "left").mapInArrow(run, "doc_id long, content binary")


def write_packages(packages: DataFrame, folder: str) -> None:
    """One file a package, named by its id: written aside under the attempt's name, then renamed."""
    from pyarrow import fs as pafs
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{root}/.{doc_id}.{attempt}.part") as f:
                    f.write(content)
                store.move(f"{root}/.{doc_id}.{attempt}.part", f"{root}/{doc_id}.docx")
            yield batch.select([0])

    packages.select("doc_id", "content").mapInArrow(run, "doc_id long").write.format("noop").mode("overwrite").save()
