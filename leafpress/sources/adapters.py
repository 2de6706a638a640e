"""Plain tables seen as documents: blocks, segments, ranges, edits. Every result is keyed by its document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.functions.text import utf16_length


def text_blocks(docs: DataFrame) -> DataFrame:
    """documents to blocks: a line of text is a paragraph. doc_id, part, section, block_ix, text, n16.

    A null text has no block, an empty one has one empty block.
    """
    lines = docs.select("doc_id", F.col("source").alias("part"), F.col("lang").alias("section"), F.posexplode(F.split("text", "\n", -1)).alias("block_ix", "text"))
    return lines.withColumn("block_ix", F.col("block_ix").cast("long")).withColumn("n16", utf16_length("text"))


def active_html(pages: DataFrame) -> DataFrame:
    """pages without the branches that no reader sees: scripts, styles, comments."""
    return pages.withColumn("html", F.regexp_replace("html", r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", ""))


def page_pieces(pages: DataFrame) -> DataFrame:
    """pages to pieces of text between tags, with the tag before each. page_id, piece_ix, tag, text.

    Closing tags keep their stroke. Pieces of white space only are left out, numbers are kept.
    """
    spread = active_html(pages).select("page_id", F.posexplode(F.split("html", "<")).alias("piece_ix", "raw"))
    cut = spread.select("page_id", F.col("piece_ix").cast("long").alias("piece_ix"), F.lower(F.regexp_extract("raw", r"^(/?[a-zA-Z][a-zA-Z0-9]*)", 1)).alias("tag"), F.regexp_replace("raw", r"(?s)^[^>]*>", "").alias("text"))
    return cut.where("tag <> ''")


def turn_blocks(conversations: DataFrame) -> DataFrame:
    """conversations to blocks: a turn is a paragraph, its role the author of the revision that holds it."""
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("block_ix"), F.col("role").alias("author"), "text", utf16_length("text").alias("n16"))


def event_markers(events: DataFrame) -> DataFrame:
    """events to the markers of one flow a user: flow_id, pos (1 up), marker, event_id, value, at (microseconds)."""
    from pyspark.sql.window import Window

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col("user_id").alias("flow_id"), "event_id", F.col("event_type").alias("marker"), "value", at.alias("at"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("flow_id").orderBy("at", "event_id")).cast("long"))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a few files dealt over all cores, for work in Python that costs far more than the move; where there are
    files enough, nothing moves."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    return df.repartition(cores) if 0 < files < cores else df
