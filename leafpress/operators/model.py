"""The document model as views over nodes: declarations, ranges, fields, revisions, sections, tables, notes, objects.

Every view is a projection of (doc_id, part_id, node) rows. An owner's properties are its children's
attributes turned into columns by one aggregation; nothing is gathered beyond an owner's own nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafpress.functions import fields as I
from leafpress.functions import values as V
from leafpress.operators import structure as S
from leafpress.sources.docx import R, W, W_STRICT

KEYS = ["doc_id", "part_id"]
# Elements that are revisions, and what they are marks of.
REVISIONS = {
    "ins": "insertion", "del": "deletion", "moveFrom": "move source", "moveTo": "move target", "rPrChange": "run properties", "pPrChange": "paragraph properties", "tblPrChange": "table properties", "trPrChange": "row properties",
    "tcPrChange": "cell properties", "sectPrChange": "section properties", "tblGridChange": "grid", "numberingChange": "numbering", "cellIns": "cell insertion", "cellDel": "cell deletion", "cellMerge": "cell merge", "tblPrExChange": "table exceptions",
}
# Elements that open and close a range.
RANGES = {"bookmark": ("bookmarkStart", "bookmarkEnd"), "comment": ("commentRangeStart", "commentRangeEnd"), "permission": ("permStart", "permEnd"), "moveFrom": ("moveFromRangeStart", "moveFromRangeEnd"), "moveTo": ("moveToRangeStart", "moveToRangeEnd"), "customXmlIns": ("customXmlInsRangeStart", "customXmlInsRangeEnd")}


def attr(name: str, ns: tuple[str, ...] = (W, W_STRICT)) -> Column:
    """An attribute of the word-processing namespace in either flavour, else without one."""
    return F.coalesce(*[F.col("attrs")[f"{{{n}}}{name}"] for n in ns], F.col("attrs")[name])


def word(nodes: DataFrame) -> DataFrame:
    return nodes.where("active").where(F.col("ns").isin(W, W_STRICT))


def properties(nodes: DataFrame, owner: str, container: str | None, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Owners (elements named `owner`) with columns from their children, or the children of their child `container`.

    wanted: column to (element, attribute). A missing element gives null; of repeated ones the last counts.
    """
    owners = word(nodes).where(F.col("local") == owner).select(*KEYS, F.col("node_id").alias("owner"), F.col("pre").alias("owner_pre"))
    up = owners.select(*KEYS, "owner", F.col("owner").alias("parent_id"))
    if container:
        held = word(nodes).where(F.col("local") == container).select(*KEYS, "node_id", "parent_id")
        up = up.join(held, [*KEYS, "parent_id"]).select(*KEYS, "owner", F.col("node_id").alias("parent_id"))
    kids = word(nodes).join(up, [*KEYS, "parent_id"])
    values = [F.max_by(F.when(F.col("local") == e, attr(a)), F.when(F.col("local") == e, F.col("pre"))).alias(c) for c, (e, a) in wanted.items()]
    present = [F.bool_or(F.col("local") == e).alias(f"has_{c}") for c, (e, _) in wanted.items()]
    return owners.join(kids.groupBy(*KEYS, "owner").agg(*values, *present), [*KEYS, "owner"], "left")


def styles(nodes: DataFrame) -> DataFrame:
    """style_id, kind, name, based_on, link, next, is_default, and the toggles and size that the style declares."""
    own = word(nodes).where("local = 'style'").select(*KEYS, F.col("node_id").alias("owner"), attr("styleId").alias("style_id"), attr("type").alias("kind"), F.coalesce(V.on_off(attr("default")), F.lit(False)).alias("is_default"))
    base = properties(nodes, "style", None, {"name": ("name", "val"), "based_on": ("basedOn", "val"), "link": ("link", "val"), "next": ("next", "val")})
    runs = properties(nodes, "style", "rPr", {k: (k, "val") for k in ("b", "i", "caps", "strike", "sz", "color")})
    toggles = [V.on_off(k, F.coalesce(f"has_{k}", F.lit(False))).alias(k) for k in ("b", "i", "caps", "strike")]
    runs = runs.select(*KEYS, "owner", *toggles, F.col("sz").try_cast("int").alias("sz"), "color")
    return own.join(base.select(*KEYS, "owner", "name", "based_on", "link", "next"), [*KEYS, "owner"], "left").join(runs, [*KEYS, "owner"], "left").drop("owner")


def default_styles(all_styles: DataFrame) -> DataFrame:
    """Of each kind the last default style, else the first one."""
    return all_styles.groupBy(*KEYS, "kind").agg(F.coalesce(F.max_by("style_id", F.when(F.col("is_default"), F.col("style_id"))), F.min("style_id")).alias("style_id"))


def heading_levels(all_styles: DataFrame) -> DataFrame:
    """style_id, level: by name, by id, or from the nearest style it is based on."""
    chain = S.style_chain(all_styles.select("doc_id", "style_id", "based_on", "kind"))
    own = F.coalesce(F.regexp_extract(F.lower("name"), "^heading ([1-9])$", 1).try_cast("int"), F.regexp_extract("style_id", "^[Hh]eading([1-9])$", 1).try_cast("int"))
    levels = all_styles.select("doc_id", F.col("style_id").alias("ancestor"), own.alias("level")).where("level is not null")
    return chain.join(levels, ["doc_id", "ancestor"]).groupBy("doc_id", "style_id").agg(F.min_by("level", "distance").alias("level"))


def numbering_levels(nodes: DataFrame) -> DataFrame:
    """num_id, ilvl, start, fmt, text: a number's levels, its overrides before those of its abstract definition."""
    w = word(nodes)
    abstract = w.where("local = 'abstractNum'").select(*KEYS, F.col("node_id").alias("parent_id"), attr("abstractNumId").alias("abstract_id"))
    level = w.where("local = 'lvl'").select(*KEYS, F.col("node_id").alias("owner"), "parent_id", attr("ilvl").try_cast("int").alias("ilvl"))
    level = level.join(abstract, [*KEYS, "parent_id"]).drop("parent_id")
    props = properties(nodes, "lvl", None, {"start": ("start", "val"), "fmt": ("numFmt", "val"), "text": ("lvlText", "val"), "restart": ("lvlRestart", "val")}).select(*KEYS, "owner", "start", "fmt", "text", "restart")
    level = level.join(props, [*KEYS, "owner"]).drop("owner")
    num = w.where("local = 'num'").select(*KEYS, F.col("node_id").alias("parent_id"), attr("numId").alias("num_id"))
    uses = w.where("local = 'abstractNumId'").select(*KEYS, "parent_id", attr("val").alias("abstract_id"))
    over = w.where("local = 'lvlOverride'").select(*KEYS, "parent_id", F.col("node_id").alias("o"), attr("ilvl").try_cast("int").alias("ilvl"))
    first = w.where("local = 'startOverride'").select(*KEYS, F.col("parent_id").alias("o"), attr("val").alias("o_start"))
    over = over.join(first, [*KEYS, "o"]).drop("o")
    full = num.join(uses, [*KEYS, "parent_id"]).join(level, [*KEYS, "abstract_id"]).join(over, [*KEYS, "parent_id", "ilvl"], "left")
    return full.select(*KEYS, "num_id", "abstract_id", "ilvl", F.coalesce("o_start", "start").try_cast("int").alias("start"), "fmt", "text", F.col("restart").try_cast("int").alias("restart"))


def theme(nodes: DataFrame) -> DataFrame:
    """doc_id, part_id, colors (slot to rgb) of each theme part."""
    slots = ["dk1", "lt1", "dk2", "lt2", *(f"accent{i}" for i in range(1, 7)), "hlink", "folHlink"]
    holder = nodes.where(F.col("local").isin(*slots)).select(*KEYS, F.col("node_id").alias("parent_id"), F.col("local").alias("slot"))
    value = nodes.where("local in ('srgbClr', 'sysClr')").select(*KEYS, "parent_id", F.coalesce(F.col("attrs")["lastClr"], F.col("attrs")["val"]).alias("rgb"))
    return holder.join(value, [*KEYS, "parent_id"]).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("slot", "rgb"))).alias("colors"))


def ranges(nodes: DataFrame) -> DataFrame:
    """kind, id, name, start and end position of every range; status tells orphans, unclosed and reversed ones."""
    w = word(nodes)
    out = None
    for kind, (opens, closes) in RANGES.items():
        a = w.where(F.col("local") == opens).select(*KEYS, attr("id").alias("id"), F.col("pre").alias("pos"))
        b = w.where(F.col("local") == closes).select(*KEYS, attr("id").alias("id"), F.col("pre").alias("pos"))
        pairs = S.pair_ranges(a, b, [*KEYS, "id"]).withColumn("kind", F.lit(kind))
        out = pairs if out is None else out.unionByName(pairs)
    names = w.where("local like '%Start'").select(*KEYS, F.col("pre").alias("start_pos"), attr("name").alias("name"))
    return out.join(names, [*KEYS, "start_pos"], "left")


def fields(nodes: DataFrame) -> DataFrame:
    """Complex fields of each part: begin_pos, end_pos, level, instr, keyword, policy; a field over several paragraphs is a Block."""
    w = word(nodes)
    marks = w.where("local = 'fldChar'").select(*KEYS, F.col("pre").alias("pos"), attr("fldCharType").alias("type"))
    pairs = S.pair_nested(marks, F.col("type") == "begin", F.col("type") == "end", KEYS).where("begin_pos is not null")
    texts = nodes.where("local = '#text'").select(*KEYS, F.col("parent_id").alias("node_id"), F.col("text").alias("piece"))
    code = w.where("local = 'instrText'").select(*KEYS, "node_id", F.col("pre").alias("i_pos")).join(texts, [*KEYS, "node_id"])
    # A piece of code belongs to the innermost field around it.
    owner = code.join(pairs, KEYS).where("begin_pos < i_pos and (end_pos is null or i_pos < end_pos)").groupBy(*KEYS, "i_pos", "piece").agg(F.max("begin_pos").alias("begin_pos"))
    instr = owner.groupBy(*KEYS, "begin_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i_pos", "piece"))), lambda x: x["piece"]), "").alias("instr"))
    paras = w.where("local = 'p'").select(*KEYS, F.col("pre").alias("p_pos"))
    across = pairs.join(paras, KEYS).where("begin_pos < p_pos and p_pos < end_pos").select(*KEYS, "begin_pos").distinct().withColumn("across", F.lit(True))
    rows = pairs.join(instr, [*KEYS, "begin_pos"], "left").join(across, [*KEYS, "begin_pos"], "left").withColumn("instr", F.coalesce("instr", F.lit("")))
    key = I.keyword("instr")
    return rows.select(*KEYS, "begin_pos", "end_pos", "level", "instr", key.alias("keyword"), F.when(F.col("across"), "Block").otherwise(I.policy(key)).alias("policy"))


def revisions(nodes: DataFrame) -> DataFrame:
    """Every revision mark: node_id, kind, id, author, date (as text), depth, owner element; inner ones have the smaller post."""
    w = word(nodes)
    parent = w.select(*KEYS, F.col("node_id").alias("parent_id"), F.col("local").alias("owner"))
    names = F.create_map(*[F.lit(x) for kv in REVISIONS.items() for x in kv])
    rows = w.where(F.col("local").isin(*REVISIONS)).join(parent, [*KEYS, "parent_id"], "left")
    inside = F.when(F.col("owner") == "rPr", "paragraph mark").when(F.col("owner") == "trPr", "table row").otherwise("content")
    return rows.select(*KEYS, "node_id", "pre", "post", "depth", names[F.col("local")].alias("kind"), inside.alias("owner"), attr("id").alias("id"), attr("author").alias("author"), attr("date").alias("date"))


def stable_ids(now: DataFrame, before: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """Revisions keep the id they had; new ones count on from the highest."""
    known = now.join(before.select(*keys, *identity, "rev_id"), [*keys, *identity], "left")
    top = before.groupBy(*keys).agg(F.max("rev_id").alias("top"))
    fresh = Window.partitionBy(*keys, F.col("rev_id").isNull()).orderBy(*identity)
    nth = F.row_number().over(fresh)
    return known.join(top, keys, "left").withColumn("rev_id", F.coalesce("rev_id", F.coalesce("top", F.lit(0)) + nth).cast("long")).drop("top")


def moves(nodes: DataFrame) -> DataFrame:
    """Move sources and targets by name; a side that is missing is null."""
    r = ranges(nodes)
    a = r.where("kind = 'moveFrom'").select("doc_id", "name", F.col("start_pos").alias("from_pos"))
    b = r.where("kind = 'moveTo'").select("doc_id", "name", F.col("start_pos").alias("to_pos"))
    return a.join(b, ["doc_id", "name"], "full_outer")


def sections(nodes: DataFrame) -> DataFrame:
    """Sections in order: section_ix, type, width, height, orientation, margins and columns with their defaults."""
    w = word(nodes).where("local = 'sectPr'")
    nth = (F.row_number().over(Window.partitionBy(*KEYS).orderBy("pre")) - 1).cast("long")
    own = w.select(*KEYS, F.col("node_id").alias("owner"), F.col("pre").alias("pos"), nth.alias("section_ix"))
    wanted = {"type": ("type", "val"), "width": ("pgSz", "w"), "height": ("pgSz", "h"), "orient": ("pgSz", "orient"), "top": ("pgMar", "top"), "left": ("pgMar", "left"), "columns": ("cols", "num"), "title_page": ("titlePg", "val")}
    p = properties(nodes, "sectPr", None, wanted)
    out = own.join(p, [*KEYS, "owner"], "left")
    # A4-like defaults in twips.
    number = lambda c, d: F.coalesce(F.col(c).try_cast("int"), F.lit(d)).alias(c)
    return out.select(*KEYS, "pos", "section_ix", F.coalesce("type", F.lit("nextPage")).alias("type"), number("width", 11906), number("height", 16838), F.coalesce("orient", F.lit("portrait")).alias("orient"), number("top", 1440), number("left", 1440), number("columns", 1), F.coalesce(V.on_off("title_page", F.coalesce("has_title_page", F.lit(False))), F.lit(False)).alias("title_page"))


def header_slots(nodes: DataFrame) -> DataFrame:
    """section_ix, kind, variant, rel_id (declared), effective: the one declared last for the same kind and variant."""
    w = word(nodes)
    sect = w.where("local = 'sectPr'").select(*KEYS, F.col("node_id").alias("parent_id"), (F.row_number().over(Window.partitionBy(*KEYS).orderBy("pre")) - 1).cast("long").alias("section_ix"))
    slots = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("variant")) for k in ("header", "footer") for v in ("default", "first", "even")]))
    grid = sect.select(*KEYS, "section_ix", slots.alias("s")).select(*KEYS, "section_ix", "s.kind", "s.variant")
    ref = w.where("local in ('headerReference', 'footerReference')").join(sect, [*KEYS, "parent_id"])
    ref = ref.select(*KEYS, "section_ix", F.regexp_replace("local", "Reference$", "").alias("kind"), F.coalesce(attr("type"), F.lit("default")).alias("variant"), F.col("attrs")[f"{{{R}}}id"].alias("rel_id"))
    full = grid.join(ref, [*KEYS, "section_ix", "kind", "variant"], "left")
    return S.last_declared(full, [*KEYS, "kind", "variant"], "section_ix", "rel_id", "effective")


def page_variant(page: Column, title_page: Column, even_odd: Column) -> Column:
    """Which of a section's slots a page (from 1) shows; an empty one isn't replaced."""
    return F.when((page == 1) & title_page, "first").when((page % 2 == 0) & even_odd, "even").otherwise("default")


def cells(nodes: DataFrame) -> DataFrame:
    """Cells of all tables: tbl, row_ix, cell_ix, col_ix (in the grid), span, width, continues (a vertical merge)."""
    w = word(nodes)
    rows = w.where("local = 'tr'").select(*KEYS, F.col("parent_id").alias("tbl"), F.col("node_id").alias("tr"), "pre")
    rows = rows.withColumn("row_ix", (F.row_number().over(Window.partitionBy(*KEYS, "tbl").orderBy("pre")) - 1).cast("long")).drop("pre")
    own = w.where("local = 'tc'").select(*KEYS, F.col("parent_id").alias("tr"), F.col("node_id").alias("owner"), "pre").join(rows, [*KEYS, "tr"])
    own = own.withColumn("cell_ix", (F.row_number().over(Window.partitionBy(*KEYS, "tr").orderBy("pre")) - 1).cast("long"))
    p = properties(nodes, "tc", "tcPr", {"span": ("gridSpan", "val"), "width": ("tcW", "w"), "merge": ("vMerge", "val")})
    full = own.join(p, [*KEYS, "owner"], "left").withColumn("span", F.coalesce(F.col("span").try_cast("int"), F.lit(1)).cast("long"))
    before = Window.partitionBy(*KEYS, "tr").orderBy("cell_ix").rowsBetween(Window.unboundedPreceding, -1)
    return full.select(
        *KEYS, "tbl", "row_ix", "cell_ix", F.coalesce(F.sum("span").over(before), F.lit(0)).cast("long").alias("col_ix"), "span", F.col("width").try_cast("long").alias("width"),
        (F.coalesce("has_merge", F.lit(False)) & (F.coalesce("merge", F.lit("continue")) == "continue")).alias("continues"),
    )


def table_look(val: Column) -> Column:
    """The six flags of a table look from its hexadecimal mask."""
    n = F.conv(val, 16, 10).cast("int")
    # Bits of the mask.
    bits = {"first_row": 0x20, "last_row": 0x40, "first_column": 0x80, "last_column": 0x100, "no_h_band": 0x200, "no_v_band": 0x400}
    return F.struct(*[(n.bitwiseAND(F.lit(b)) != 0).alias(k) for k, b in bits.items()])


def entries(nodes: DataFrame, element: str) -> DataFrame:
    """Comments or notes: id, author, date, kind, text."""
    own = word(nodes).where(F.col("local") == element).select(*KEYS, "node_id", "pre", "post", attr("id").alias("id"), attr("author").alias("author"), attr("date").alias("date"), F.coalesce(attr("type"), F.lit("normal")).alias("kind"))
    from leafpress.sources.docx import string_values

    text = string_values(nodes, own.select(*KEYS, "node_id", "pre", "post"))
    return own.join(text, [*KEYS, "node_id"], "left").select(*KEYS, "id", "author", "date", "kind", F.coalesce("value", F.lit("")).alias("text"))


def comments(nodes: DataFrame) -> DataFrame:
    return entries(nodes, "comment").drop("kind")


def notes(nodes: DataFrame) -> DataFrame:
    """Foot- and endnotes that aren't separators."""
    return entries(nodes, "footnote").withColumn("note", F.lit("footnote")).unionByName(entries(nodes, "endnote").withColumn("note", F.lit("endnote"))).where("kind = 'normal'")


def controls(nodes: DataFrame) -> DataFrame:
    """Content controls: alias, tag, lock, bound, and whether their content may be set."""
    p = properties(nodes, "sdt", "sdtPr", {"alias": ("alias", "val"), "tag": ("tag", "val"), "lock": ("lock", "val"), "binding": ("dataBinding", "xpath")})
    locked = F.coalesce(F.col("lock").isin("contentLocked", "sdtContentLocked"), F.lit(False))
    bound = F.coalesce("has_binding", F.lit(False))
    return p.select(*KEYS, F.col("owner").alias("node_id"), "alias", "tag", "lock", bound.alias("bound"), F.when(locked, "locked").when(bound, "bound").alias("refusal"))


def drawings(nodes: DataFrame) -> DataFrame:
    """Drawings: what they hold, whether anchored, extent in EMU, the picture's relationship."""
    own = nodes.where("active and local in ('inline', 'anchor')").select(*KEYS, F.col("node_id").alias("drawing"), F.col("local").alias("place"), F.col("pre").alias("d_pre"), F.col("post").alias("d_post"))
    inside = nodes.where("local in ('graphicData', 'blip', 'extent', 'docPr')").join(own, KEYS).where("d_pre < pre and d_post > post")
    pick = lambda local, value: F.max(F.when(F.col("local") == local, value))
    g = inside.groupBy(*KEYS, "drawing", "place").agg(
        pick("graphicData", F.regexp_extract(F.col("attrs")["uri"], "([^/]+)$", 1)).alias("kind"), pick("blip", F.col("attrs")[f"{{{R}}}embed"]).alias("rel_id"),
        pick("extent", F.col("attrs")["cx"]).try_cast("long").alias("cx"), pick("extent", F.col("attrs")["cy"]).try_cast("long").alias("cy"), pick("docPr", F.col("attrs")["descr"]).alias("alt"),
    )
    return g.withColumn("anchored", F.col("place") == "anchor").drop("place")


def chart_points(nodes: DataFrame) -> DataFrame:
    """Points of chart caches: series, axis (cat or val), idx, value; an index without a point is null up to the count."""
    series = nodes.where("local = 'ser'").select(*KEYS, F.col("node_id").alias("ser"), F.col("pre").alias("s_pre"), F.col("post").alias("s_post"))
    axis = nodes.where("local in ('cat', 'val')").join(series, KEYS).where("s_pre < pre and s_post > post").select(*KEYS, "ser", F.col("local").alias("axis"), F.col("pre").alias("a_pre"), F.col("post").alias("a_post"))
    points = nodes.where("local = 'pt'").join(axis, KEYS).where("a_pre < pre and a_post > post").select(*KEYS, "ser", "axis", "node_id", "pre", "post", F.col("attrs")["idx"].try_cast("int").alias("idx"))
    from leafpress.sources.docx import string_values

    held = points.join(string_values(nodes, points.select(*KEYS, "node_id", "pre", "post")), [*KEYS, "node_id"], "left").select(*KEYS, "ser", "axis", "idx", "value")
    counts = nodes.where("local = 'ptCount'").join(axis, KEYS).where("a_pre < pre and a_post > post").groupBy(*KEYS, "ser", "axis").agg(F.max(F.col("attrs")["val"].try_cast("int")).alias("n"))
    every = counts.where("n > 0").select(*KEYS, "ser", "axis", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    return every.join(held, [*KEYS, "ser", "axis", "idx"], "left")


def canonical(nodes: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """One text for each part that is equal for equal trees: names with namespaces, attributes in order, texts."""
    names = F.array_sort(F.filter(F.map_keys("attrs"), lambda k: ~k.isin(*ignore)) if ignore else F.map_keys("attrs"))
    shown = F.array_join(F.transform(names, lambda k: F.concat(k, F.lit("="), F.col("attrs")[k])), ";")
    opens = nodes.select(*KEYS, F.col("pre").alias("at"), F.col("depth"), F.when(F.col("local") == "#text", F.concat(F.lit("t:"), "text")).otherwise(F.concat(F.lit("e:{"), F.coalesce("ns", F.lit("")), F.lit("}"), "local", F.lit("["), shown, F.lit("]"))).alias("token"))
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("at", "depth", "token"))), lambda x: F.concat(x["depth"].cast("string"), F.lit(" "), x["token"]))
    return opens.groupBy(*KEYS).agg(F.array_join(tokens, "\n").alias("canonical"))


def first_difference(a: Column, b: Column) -> Column:
    """struct(line, left, right) of the first line in which two canonical texts differ; null if they are equal."""
    pairs = F.arrays_zip(F.split(a, "\n").alias("l"), F.split(b, "\n").alias("r"))
    at = F.array_position(F.transform(pairs, lambda p: ~p["l"].eqNullSafe(p["r"])), True).cast("int")
    hit = F.get(pairs, at - 1)
    return F.when(at > 0, F.struct(at.alias("line"), hit["l"].alias("left"), hit["r"].alias("right")))
