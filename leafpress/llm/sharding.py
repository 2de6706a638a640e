"""Contiguous shards of nearly equal bytes from global prefix sums, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafpress.llm.common import persist, shuffle_partitions
from leafpress.llm.ordered import NULL_ID, range_bucket, running_totals


def byte_shards(docs: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in id order, at equal targets of bytes.

    A row's size is the text's UTF-8 bytes (null: none) plus `overhead`. Ranges of ids give totals, their
    prefix sums give each range its base, and a running sum inside the range gives each row the bytes
    before it; the middle of the row names its shard. Rows of equal id are ordered by checksum and
    size; null ids come first. An empty table gives no rows; shards may stay empty where one row is
    larger than a target. Returns doc_id, size, text_crc32 (null text: that of no bytes), law, shard,
    slot (gapless from 0 in each shard), grown_shard (null under this law).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("crc"))
    rows = persist(rows, "sizes")  # the text is read once; all that follows is a few bytes a row
    rows = rows.withColumn("bucket", range_bucket(rows.select("id"), "id", 4 * shuffle_partitions(docs.sparkSession)))
    totals = rows.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("count"))
    base = running_totals(totals, "bucket", "bytes", "count")
    own = Window.partitionBy("bucket").orderBy("id", "crc", "size")
    inside = rows.withColumn("nth", F.row_number().over(own)).withColumn("upto", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    placed = inside.join(base, "bucket").select(
        "id", "size", "crc", (F.col("count_before") + F.col("nth") - 1).alias("at"),
        F.expr(f"cast(least({shards - 1}, ((2 * (bytes_before + upto) - size) * {shards}) div (2 * bytes_all)) as int)").alias("shard"),
    )
    placed = persist(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # a row a shard
    return placed.join(F.broadcast(first), "shard").select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
