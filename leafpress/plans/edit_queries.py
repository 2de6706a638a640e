"""Queries of set-wise edits over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.operators import editing as E
from leafpress.operators import structure as S
from leafpress.plans.read_queries import BLOCKS
from leafpress.plans.registry import Tables, query
from leafpress.sources.adapters import text_blocks


def _blocks(t: Tables) -> DataFrame:
    return text_blocks(t("documents")).select("doc_id", "block_ix", "text")


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix, CASE WHEN block_ix = 0 THEN concat(left(text, 5), '<<', substr(text, 6)) ELSE text END AS text FROM b")
def insert_text(t: Tables) -> DataFrame:
    return E.insert_text(_blocks(t), F.lit(5), F.lit("<<"), F.col("block_ix") == 0)


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix, CASE WHEN block_ix = 1 THEN concat(left(text, 2), 'NEW', substr(text, 9)) ELSE text END AS text FROM b")
def replace_text(t: Tables) -> DataFrame:
    return E.replace_range(_blocks(t), F.lit(2), F.lit(8), F.lit("NEW"), F.col("block_ix") == 1)


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix, replace(text, 'the', 'THE') AS text FROM b")
def replace_all(t: Tables) -> DataFrame:
    return E.replace_all(_blocks(t), "the", "THE")


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix, concat(left(text, 3), substr(text, 11)) AS text FROM b")
def delete_range(t: Tables) -> DataFrame:
    return E.delete_range(_blocks(t), F.lit(3), F.lit(10), F.lit(True))


@query(f"WITH {BLOCKS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_ix) - 1 AS block_ix, text FROM b WHERE length(text) <= 300")
def delete_block(t: Tables) -> DataFrame:
    blocks = _blocks(t)
    return E.delete_blocks(blocks, blocks.where("length(text) > 300").select("doc_id", "block_ix"), ["doc_id"])


@query(f"WITH {BLOCKS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN block_ix = 2 THEN -1 ELSE 2 * block_ix END) - 1 AS block_ix, text FROM b")
def move_block(t: Tables) -> DataFrame:
    return E.move_block(_blocks(t), ["doc_id"], 2, 0)


@query(f"""WITH {BLOCKS}, h AS (SELECT doc_id, block_ix, 0 AS half, CASE WHEN length(text) > 20 THEN left(text, 10) ELSE text END AS text FROM b UNION ALL SELECT doc_id, block_ix, 1, substr(text, 11) FROM b WHERE length(text) > 20)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_ix, half) - 1 AS block_ix, text FROM h""")
def split_paragraph(t: Tables) -> DataFrame:
    return E.split_block(_blocks(t), ["doc_id"], F.lit(10), F.length("text") > 20)


@query(f"""WITH {BLOCKS}, j AS (SELECT *, coalesce(lag(length(text) < 60) OVER (PARTITION BY doc_id ORDER BY block_ix), false) AS joins FROM b), g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_ix) - 1 AS g FROM j)
SELECT doc_id, CAST(g AS BIGINT) AS block_ix, string_agg(text, '' ORDER BY block_ix) AS text FROM g GROUP BY doc_id, g""")
def merge_with_next(t: Tables) -> DataFrame:
    return E.merge_with_next(_blocks(t), ["doc_id"], F.length("text") < 60)


@query(f"WITH {BLOCKS}, a AS (SELECT doc_id, block_ix, CAST(n16 AS BIGINT) AS pt FROM b) SELECT doc_id, block_ix, CASE WHEN pt < 20 THEN pt WHEN pt = 20 THEN 20 WHEN pt < 30 THEN 20 ELSE pt - 10 + 4 END AS moved FROM a")
def anchor_transform(t: Tables) -> DataFrame:
    return text_blocks(t("documents")).select("doc_id", "block_ix", E.shift_anchor(F.col("n16"), F.lit(20), F.lit(10), F.lit(4), F.lit(True)).alias("moved"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size < 40 UNION ALL SELECT p_partkey, 'changed', p_size FROM part WHERE p_size >= 40")
def upsert_style(t: Tables) -> DataFrame:
    part = t("part").select("p_partkey", "p_name", "p_size")
    return E.upsert(part, part.where("p_size >= 40").withColumn("p_name", F.lit("changed")), ["p_partkey"])


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations WHERE role <> 'system'")
def accept_revisions(t: Tables) -> DataFrame:
    """The assistant's turns are insertions, the system's (and those of nobody, as in the SQL) deletions."""
    rev = F.when(F.col("role") == "assistant", "ins").when(F.coalesce("role", F.lit("system")) == "system", "del")
    return S.accepted(t("conversations").withColumn("rev", rev)).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
