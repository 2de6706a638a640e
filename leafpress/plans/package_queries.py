"""Queries through real packages: documents are written as word-processing files and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.functions import values as V
from leafpress.plans.read_queries import BLOCKS
from leafpress.plans.registry import Tables, query
from leafpress.sources import docx
from leafpress.sources.adapters import spread


def _nodes(t: Tables) -> tuple[DataFrame, DataFrame]:
    found = docx.parts(docx.to_packages(spread(t("documents").select("doc_id", "text"))))
    return found, docx.nodes(found.where("uri like '%.xml' or uri like '%.rels'"))


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix, text FROM b")
def docx_blocks(t: Tables) -> DataFrame:
    return docx.blocks(_nodes(t)[1]).select("doc_id", "block_ix", "text")


@query(f"WITH {BLOCKS} SELECT doc_id, count(*) AS paragraphs, count(*) AS runs, CAST(3 AS BIGINT) AS parts FROM b GROUP BY doc_id")
def docx_counts(t: Tables) -> DataFrame:
    found, nodes = _nodes(t)
    n = nodes.groupBy("doc_id").agg(F.count_if(F.col("local") == "p").alias("paragraphs"), F.count_if(F.col("local") == "r").alias("runs"))
    return n.join(found.groupBy("doc_id").agg(F.count("*").alias("parts")), "doc_id")


@query("SELECT doc_id, '/' AS source_uri, 'officeDocument' AS kind, '/word/document.xml' AS target_uri FROM documents")
def docx_relationships(t: Tables) -> DataFrame:
    return docx.relationships(*_nodes(t)).select("doc_id", "source_uri", "kind", "target_uri")


@query("SELECT doc_id, true AS same FROM documents")
def docx_roundtrip(t: Tables) -> DataFrame:
    made = docx.to_packages(spread(t("documents").select("doc_id", "text")))
    none = made.select("doc_id", F.lit("/x").alias("uri"), F.lit(None).cast("binary").alias("bytes")).limit(0)
    back = docx.save(made, none).select("doc_id", F.col("content").alias("saved"))
    return made.join(back, "doc_id").select("doc_id", (F.col("content") == F.col("saved")).alias("same"))


@query("SELECT doc_id, 'image/png' AS mime FROM documents")
def media_signature(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", V.signature_mime(F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode("lang", "UTF-8"))).alias("mime"))


@query("SELECT doc_id, concat('/word/media/', doc_id, '.png') AS a, CASE WHEN doc_id >= 0 THEN NULL ELSE '' END AS b, '/x y.xml' AS c FROM documents")
def target_paths(t: Tables) -> DataFrame:
    base, name = F.lit("/word/sub/document.xml"), F.concat(F.lit("../media/./"), F.col("doc_id").cast("string"), F.lit(".png"))
    return t("documents").select("doc_id", docx.resolve_target(base, name).alias("a"), docx.resolve_target(base, F.lit("../../../x")).alias("b"), docx.resolve_target(base, F.lit("/x%20y.xml")).alias("c"))
