"""The read surface: units, offsets, outlines, search, context, paging. Nothing here leaves a document's own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafpress.functions.text import col, first_sentence, utf16_length


def offsets(units: DataFrame, doc: str = "doc_id", order: str = "block_ix", size: str = "n16", gap: int = 1) -> DataFrame:
    """start16 and end16 of each unit in the flow's text, units joined by `gap` code units."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col(size) + gap).over(w), F.lit(0)).cast("long")
    return units.withColumn("start16", start).withColumn("end16", F.col("start16") + F.col(size))


def outline_groups(blocks: DataFrame, width: int = 32) -> DataFrame:
    """The outline of a flow without headings: groups of `width` blocks, titled by their first sentence that isn't empty."""
    rows = blocks.withColumn("group_ix", F.floor(F.col("block_ix") / width).cast("long")).withColumn("s", first_sentence("text"))
    return rows.groupBy("doc_id", "group_ix").agg(
        F.coalesce(F.min_by("s", F.when(F.col("s") != "", F.col("block_ix"))), F.lit("")).alias("title"),
        F.count("*").alias("block_count"),
        F.sum("n16").cast("long").alias("char_count"),
    )


def chapters(headings: DataFrame, last: str = "n_blocks", doc: str = "doc_id", levels: int = 9) -> DataFrame:
    """Parent and end of each heading (doc, block_ix, level): the nearest earlier heading of a lower level, and the
    next heading of the same or a lower one, else the flow's end. One window a level, no join."""
    before = Window.partitionBy(doc).orderBy("block_ix").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(doc).orderBy("block_ix").rowsBetween(1, Window.unboundedFollowing)
    # The latest heading of each lower level so far; the greatest of those is the nearest.
    parents = [F.last(F.when(F.col("level") == k, F.col("block_ix")), ignorenulls=True).over(before) for k in range(1, levels)]
    ends = [F.first(F.when(F.col("level") <= k, F.col("block_ix")), ignorenulls=True).over(after) for k in range(1, levels + 1)]
    parent = F.greatest(*[F.when(F.lit(k) < F.col("level"), p) for k, p in enumerate(parents, 1)], F.lit(None).cast("long"))
    end = F.coalesce(*[F.when(F.col("level") == k, e) for k, e in enumerate(ends, 1)], F.col(last))
    return headings.withColumn("parent_ix", parent).withColumn("end_ix", end)


def find_regex(units: DataFrame, pattern: str, keys: list[str], text: str = "text", context: int = 40) -> DataFrame:
    """Leftmost non-overlapping matches of a regular expression without look-around: hit_ix, match, start (code points),
    before and after (context). Matches must not be empty.

    The text is split by the pattern into gaps and hits, once; running sums over them give the places, and the
    pieces beside a hit its context, so the work grows with the text and its hits, not with their product.
    """
    hits = F.regexp_extract_all(col(text), F.lit(f"({pattern})"), 1)
    gaps = F.split(col(text), pattern, -1)
    rows = units.select(*keys, F.monotonically_increasing_id().alias("_u"), F.arrays_zip(gaps.alias("g"), hits.alias("h")).alias("_p")).where(F.size("_p") > 1)
    rows = rows.select(*keys, "_u", F.posexplode("_p").alias("hit_ix", "_x")).select(*keys, "_u", "hit_ix", F.col("_x.g").alias("_g"), F.col("_x.h").alias("match"))
    # Beyond a gap's own ends a context needs no more of it than this.
    rows = rows.withColumn("_n", F.length("_g") + F.coalesce(F.length("match"), F.lit(0))).withColumn("_l", F.length("_g"))
    rows = rows.withColumn("_head", F.substring("_g", 1, context)).withColumn("_tail", F.expr(f"right(_g, {context})")).drop("_g")
    w = Window.partitionBy(*keys, "_u").orderBy("hit_ix")
    piece = F.concat(F.when(F.col("_l") <= context, F.col("_tail")).otherwise(F.col("_head")), F.coalesce("match", F.lit("")))
    behind = F.concat(F.col("_tail"), F.coalesce("match", F.lit("")))
    start = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_l")
    # A hit has a character at least, so `context` pieces on either side are enough; one that is cut short fills the context alone.
    before = F.concat(F.array_join(F.collect_list(behind).over(w.rowsBetween(-context, -1)), ""), F.col("_tail"))
    after = F.array_join(F.collect_list(F.when(F.col("_l") <= context, piece).otherwise(F.col("_head"))).over(w.rowsBetween(1, context)), "")
    rows = rows.withColumn("start", start.cast("long")).withColumn("_b", before).withColumn("_a", after).where("match is not null")
    return rows.select(*keys, F.col("hit_ix").cast("long").alias("hit_ix"), "match", "start", F.expr(f"right(_b, {context})").alias("before"), F.substring("_a", 1, context).alias("after"))


def validate_pattern(pattern: str, literal: bool = False) -> str:
    """Limits on a search pattern; look-around and back-references have no counterpart in a linear engine."""
    import re

    if literal and not pattern:
        raise ValueError("an empty literal matches nothing")
    if len(pattern.encode("utf-16-le")) // 2 > 4096 or len(pattern.encode()) > 16384:
        raise ValueError("pattern too long")
    if literal:
        return re.escape(pattern)
    if re.search(r"\(\?(=|!|<=|<!|P=|>)|\\[1-9]|\\k<", pattern):
        raise ValueError("look-around and back-references are not supported")
    re.compile(pattern)
    return pattern


def context_blocks(blocks: DataFrame, before: int, after: int, doc: str = "doc_id", order: str = "block_ix") -> DataFrame:
    """Each block with the text of the blocks around it, joined by line feeds."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(-before, after)
    return blocks.withColumn("context", F.array_join(F.collect_list("text").over(w), "\n"))


def context_units(units: DataFrame, centre: Column, reach: int, doc: str = "doc_id") -> DataFrame:
    """Whole units of which any code unit lies within `reach` of the unit for which `centre` holds (one a document)."""
    w = Window.partitionBy(doc)
    lo, hi = F.min(F.when(centre, F.col("start16"))).over(w) - reach, F.max(F.when(centre, F.col("end16"))).over(w) + reach
    return units.withColumn("_lo", lo).withColumn("_hi", hi).where("end16 > _lo and start16 < _hi or start16 = _lo + " + str(reach)).drop("_lo", "_hi")


def budget_prefix(units: DataFrame, limit: int, max_bytes: int, doc: str = "doc_id", order: str = "block_ix", from_ix: int = 0) -> DataFrame:
    """The longest prefix of whole units from a position that fits a budget of UTF-16 units and bytes.

    Returns doc, next_ix (null at the end), units, used16, used_bytes, error. Where not even the first unit
    fits, a row with error 'budget too small' and the least sufficient sizes stands in for the page.
    """
    validate_budget(limit, max_bytes)
    rows = units.where(F.col(order) >= from_ix)
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(doc, order, "n16", F.octet_length("text").cast("long").alias("b"), F.sum("n16").over(w).alias("s16"), F.sum(F.octet_length("text").cast("long")).over(w).alias("sb"))
    fits = (F.col("s16") <= limit) & (F.col("sb") <= max_bytes)
    page = rows.groupBy(doc).agg(
        F.min(F.when(~fits, F.col(order))).alias("next_ix"), F.count_if(fits).alias("units"), F.coalesce(F.max(F.when(fits, F.col("s16"))), F.min_by("n16", order)).alias("used16"),
        F.coalesce(F.max(F.when(fits, F.col("sb"))), F.min_by("b", order)).alias("used_bytes"),
    )
    return page.withColumn("error", F.when(F.col("units") == 0, F.lit("budget too small")))


def validate_budget(limit: int, max_bytes: int) -> None:
    # The bounds of a budget.
    if not 1 <= limit <= 1048576 or not 512 <= max_bytes <= 4194304:
        raise ValueError("limit is from 1 to 1048576 and maxBytes from 512 to 4194304")


def anchor_cover(anchors: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Breaks of a cover of each text by anchors [start16, end16): gaps and overlaps, none in a sound map."""
    w = Window.partitionBy(doc).orderBy("start16", "end16")
    following = F.lead("start16").over(w)
    rows = anchors.withColumn("next16", following)
    return rows.where("next16 is not null and next16 <> end16").withColumn("kind", F.when(F.col("next16") > F.col("end16"), "gap").otherwise("overlap"))


def locate(points: DataFrame, segments: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """The segment that holds each offset, a range join inside equal keys."""
    return points.join(segments, keys).where((F.col("start16") <= F.col(at)) & (F.col(at) < F.col("end16"))).withColumn("inner16", F.col(at) - F.col("start16"))


def merge_intervals(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching ranges become one: keys, start, end, merged."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.when(F.coalesce(F.max(end).over(before) >= F.col(start), F.lit(False)), 0).otherwise(1)
    return ranges.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(running)).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("_island")


def keyed_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """insert, delete and text changes of objects by key; equal values are left out."""
    a, b = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_a")), after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    kind = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").otherwise("text")
    return both.withColumn("kind", kind).where("kind <> 'text' or not (before <=> after)").drop("_a", "_b")


def positional_diff(before: DataFrame, after: DataFrame, doc: str = "doc_id", order: str = "block_ix") -> DataFrame:
    """Unit i against unit i; an insertion makes every later unit differ."""
    return keyed_diff(before, after, [doc, order], "text")
