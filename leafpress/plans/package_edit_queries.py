"""Edits of real packages: documents become packages, edits reach their parts, and the saved packages are read again."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.operators.package_edits import fold_packages
from leafpress.plans.read_queries import BLOCKS
from leafpress.plans.registry import Tables, query
from leafpress.sources import docx
from leafpress.sources.adapters import spread


def _edited(t: Tables, ops: Column | list[dict]) -> DataFrame:
    """The packages after one batch each; ops may be a column of JSON, null where a document isn't edited."""
    docs = spread(t("documents").select("doc_id", "text").where("text is not null"))
    ops = F.lit(json.dumps(ops)) if isinstance(ops, list) else ops
    edits = docs.select("doc_id", F.lit(0).cast("long").alias("batch"), ops.alias("ops")).where("ops is not null")
    return fold_packages(docx.to_packages(docs), edits)


def _nodes(packages: DataFrame, part: str) -> DataFrame:
    return docx.nodes(docx.parts(packages).where(F.col("uri") == part))


def _blocks(packages: DataFrame, part: str = "/word/document.xml") -> DataFrame:
    return docx.blocks(_nodes(packages, part))


def _texts(packages: DataFrame) -> DataFrame:
    return _blocks(packages).select("doc_id", "block_ix", "text")


def _many(ops: list[dict]) -> Column:
    """The operations for documents of two lines or more."""
    return F.when(F.instr("text", "\n") > 0, F.lit(json.dumps(ops)))


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix, CASE WHEN block_ix = 0 THEN concat('<&', text) ELSE text END AS text FROM b")
def package_insert_text(t: Tables) -> DataFrame:
    return _texts(_edited(t, [{"op": "insertText", "at": {"para": 0, "offset": 0}, "text": "<&"}]))


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix, replace(text, 'the', 'THE') AS text FROM b")
def package_replace_text(t: Tables) -> DataFrame:
    return _texts(_edited(t, [{"action": "replaceText", "selector": {"find": "the", "all": True}, "text": "THE"}]))


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix + 1 AS block_ix, text FROM b UNION ALL SELECT doc_id, 0, '' FROM b WHERE block_ix = 0")
def package_split_paragraph(t: Tables) -> DataFrame:
    return _texts(_edited(t, [{"op": "splitParagraph", "at": {"para": 0, "offset": 0}}]))


@query(f"""WITH {BLOCKS} SELECT doc_id, CASE WHEN block_ix = 0 THEN 0 ELSE block_ix - 1 END AS block_ix, CASE WHEN block_ix = 0 THEN text ELSE text END AS text FROM b WHERE block_ix > 1
UNION ALL SELECT doc_id, 0, string_agg(text, '' ORDER BY block_ix) FROM b WHERE block_ix < 2 GROUP BY doc_id""")
def package_merge_with_next(t: Tables) -> DataFrame:
    return _texts(_edited(t, _many([{"op": "mergeWithNext", "para": 0}])))


@query(f"WITH {BLOCKS}, n AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id) SELECT doc_id, CASE WHEN n > 1 THEN block_ix - 1 ELSE block_ix END AS block_ix, text FROM b JOIN n USING (doc_id) WHERE n = 1 OR block_ix > 0")
def package_delete_block(t: Tables) -> DataFrame:
    return _texts(_edited(t, _many([{"op": "deleteBlock", "node": 0}])))


@query(f"WITH {BLOCKS}, n AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id) SELECT doc_id, CASE WHEN n > 1 AND block_ix < 2 THEN 1 - block_ix ELSE block_ix END AS block_ix, text FROM b JOIN n USING (doc_id)")
def package_move_block(t: Tables) -> DataFrame:
    return _texts(_edited(t, _many([{"op": "moveBlock", "node": 1, "to": {"before": 0}}])))


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix + 1 AS block_ix, text FROM b WHERE block_ix > 0 UNION ALL SELECT doc_id, 0, text FROM b WHERE block_ix = 0 UNION ALL SELECT doc_id, 1, 'new' FROM b WHERE block_ix = 0")
def package_insert_block(t: Tables) -> DataFrame:
    return _texts(_edited(t, [{"action": "insertParagraphAfter", "block": 0, "text": "new"}]))


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix, CASE WHEN block_ix = 0 THEN 'Mark' END AS style_id FROM b")
def package_set_style(t: Tables) -> DataFrame:
    return _blocks(_edited(t, [{"action": "setBlockStyle", "block": 0, "style": "Mark", "create": True}])).select("doc_id", "block_ix", "style_id")


def _tracked(t: Tables, then: str) -> DataFrame:
    """A replacement under tracking, settled."""
    first = F.length(F.regexp_extract("text", "^[^\n]*", 0))  # code units where no text goes beyond U+FFFF
    units = F.octet_length(F.encode(F.regexp_extract("text", "^[^\n]*", 0), "UTF-16BE")) / 2
    op = {"op": "replaceText", "from": {"para": 0, "offset": 0}, "to": {"para": 0, "offset": -9}, "text": "NEW"}
    ops = json.dumps([{"op": "setTracking", "author": "x"}, op, {"op": then}])
    ops = F.replace(F.lit(ops), F.lit("-9"), F.when(units == first, F.least(first, F.lit(4))).otherwise(0).cast("string"))
    return _texts(_edited(t, ops))


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix, CASE WHEN block_ix > 0 THEN text WHEN n16 = length(text) THEN concat('NEW', substr(text, 5)) ELSE concat('NEW', text) END AS text FROM b")
def package_accept_all(t: Tables) -> DataFrame:
    return _tracked(t, "acceptAll")


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix, text FROM b")
def package_reject_all(t: Tables) -> DataFrame:
    return _tracked(t, "rejectAll")


@query(f"WITH {BLOCKS} SELECT doc_id, '0' AS id, 'why' AS text FROM b WHERE block_ix = 0")
def package_add_comment(t: Tables) -> DataFrame:
    nodes = _nodes(_edited(t, [{"op": "addComment", "from": {"para": 0, "offset": 0}, "to": {"para": 0, "offset": 0}, "comment": {"text": "why"}}]), "/word/comments.xml")
    ids = nodes.where("local = 'comment'").select("doc_id", F.col("attrs")[f"{{{docx.W}}}id"].alias("id"))
    return ids.join(docx.blocks(nodes).select("doc_id", "text"), "doc_id")


@query(f"WITH {BLOCKS} SELECT doc_id, CAST(2 AS BIGINT) AS sections FROM b WHERE block_ix = 0")
def package_section_break(t: Tables) -> DataFrame:
    nodes = _nodes(_edited(t, [{"op": "insertSectionBreak", "para": 0, "type": "continuous"}]), "/word/document.xml")
    return nodes.groupBy("doc_id").agg(F.count_if(F.col("local") == "sectPr").alias("sections"))


@query(f"WITH {BLOCKS} SELECT doc_id, 'doc ' || doc_id AS text FROM b WHERE block_ix = 0")
def package_header(t: Tables) -> DataFrame:
    ops = json.dumps([{"op": "setHeaderFooter", "sect": 0, "kind": "header", "content": [{"text": "doc @"}]}])
    return _blocks(_edited(t, F.replace(F.lit(ops), F.lit("@"), F.col("doc_id").cast("string"))), "/word/header1.xml").select("doc_id", "text")


@query(f"WITH {BLOCKS} SELECT doc_id, format, CAST(level AS INT) AS level FROM b, (VALUES ('upperRoman', 0), ('decimal', 1)) AS l(format, level) WHERE block_ix = 0")
def package_numbering(t: Tables) -> DataFrame:
    nodes = _nodes(_edited(t, [{"op": "addNumberingDefinition", "levels": [{"format": "upperRoman"}, {"format": "decimal"}]}]), "/word/numbering.xml")
    val = F.col("attrs")[f"{{{docx.W}}}val"]
    formats = nodes.where("local = 'numFmt'").select("doc_id", val.alias("format"), F.col("parent_id").alias("node_id"))
    levels = nodes.where("local = 'lvl'").select("doc_id", "node_id", F.col("attrs")[f"{{{docx.W}}}ilvl"].cast("int").alias("level"))
    return formats.join(levels, ["doc_id", "node_id"]).select("doc_id", "format", "level")


@query(f"WITH {BLOCKS} SELECT doc_id, true AS refused, true AS same FROM b WHERE block_ix = 0")
def package_refused_edit(t: Tables) -> DataFrame:
    """A batch of which the last operation can't be done leaves the package's bytes as they were."""
    after = _edited(t, [{"op": "insertText", "at": {"para": 0, "offset": 0}, "text": "x"}, {"op": "deleteBlock", "node": 10_000_000}])
    made = docx.to_packages(t("documents").select("doc_id", "text").where("text is not null")).select("doc_id", F.col("content").alias("before"))
    return after.join(made, "doc_id").select("doc_id", (F.col("version") == 0).alias("refused"), (F.col("content") == F.col("before")).alias("same"))
