"""Edits over blocks: columnar where one edit a row is enough, an ordered fold a document where edits build on each other.

blocks: doc_id, block_ix, text and any other columns. A batch of operations is applied to each document in
order by the engine of `folding`; the operators below are the set-wise forms of single kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafpress.functions.text import utf16_length, utf16_slice


def insert_text(blocks: DataFrame, at: Column, text: Column, where: Column) -> DataFrame:
    """Text goes in at a UTF-16 offset of the blocks for which `where` holds; offsets beyond the end mean the end."""
    n = utf16_length("text")
    at = F.least(at.cast("long"), n)
    return blocks.withColumn("text", F.when(where, F.concat(utf16_slice("text", F.lit(0), at), text, utf16_slice("text", at, n))).otherwise(F.col("text")))


def replace_range(blocks: DataFrame, start: Column, end: Column, text: Column, where: Column) -> DataFrame:
    n = utf16_length("text")
    a, b = F.least(start.cast("long"), n), F.least(end.cast("long"), n)
    return blocks.withColumn("text", F.when(where, F.concat(utf16_slice("text", F.lit(0), a), text, utf16_slice("text", b, n))).otherwise(F.col("text")))


def delete_range(blocks: DataFrame, start: Column, end: Column, where: Column) -> DataFrame:
    return replace_range(blocks, start, end, F.lit(""), where)


def renumber(blocks: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """block_ix counted anew from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return blocks.withColumn("_n", (F.row_number().over(w) - 1).cast("long")).drop("block_ix").withColumnRenamed("_n", "block_ix")


def delete_blocks(blocks: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks (keys, block_ix) of `gone` leave; the rest closes up."""
    return renumber(blocks.join(gone, [*keys, "block_ix"], "left_anti"), keys, "block_ix")


def move_block(blocks: DataFrame, keys: list[str], source: int, target: int) -> DataFrame:
    """Block `source` of every document that has it goes before block `target` of the old order."""
    place = F.when(F.col("block_ix") == source, F.lit(2 * target - 1)).otherwise(2 * F.col("block_ix"))
    return renumber(blocks.withColumn("_p", place), keys, "_p").drop("_p")


def split_block(blocks: DataFrame, keys: list[str], at: Column, where: Column) -> DataFrame:
    """A block is cut in two at a UTF-16 offset."""
    n = utf16_length("text")
    cut = F.when(where, F.array(utf16_slice("text", F.lit(0), at), utf16_slice("text", at, n))).otherwise(F.array("text"))
    rest = [c for c in blocks.columns if c != "text"]
    return renumber(blocks.select(*rest, F.posexplode(cut).alias("_half", "text")), keys, "block_ix", "_half").drop("_half")


def merge_with_next(blocks: DataFrame, keys: list[str], where: Column) -> DataFrame:
    """A block takes the text of the one after it, which goes; two merges in a row make one block of three."""
    w = Window.partitionBy(*keys).orderBy("block_ix")
    rows = blocks.withColumn("_joins", F.coalesce(F.lag(F.coalesce(where, F.lit(False))).over(w), F.lit(False)))
    rows = rows.withColumn("_g", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "text"))), lambda x: x["text"])
    return rows.groupBy(*keys, (F.col("_g") - 1).cast("long").alias("block_ix")).agg(F.array_join(parts, "").alias("text"))


def shift_anchor(at: Column, start: Column, removed: Column, inserted: Column, sticky_left: Column) -> Column:
    """Where an offset lies after `removed` units at `start` gave way to `inserted` ones.

    Before the edit it stays; inside the removed range it falls to the edit's start; at a pure insertion
    the affinity decides; behind it shifts by the difference.
    """
    return (
        F.when(at < start, at).when((at == start) & ((removed > 0) | sticky_left), at).when(at < start + removed, start)
        .otherwise(at - removed + inserted)
    )


def replace_all(blocks: DataFrame, find: str, text: str) -> DataFrame:
    """Every leftmost non-overlapping place of a literal; the same as replacing them in reverse order."""
    return blocks.withColumn("text", F.replace("text", F.lit(find), F.lit(text)))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `changes` replace or join the rows of equal keys."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)
