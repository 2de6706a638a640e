"""Ordered and nested structure: pairing of markers, list counters, inheritance, cascades, table grids, revisions."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _upto(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def pair_nested(markers: DataFrame, opens: Column, closes: Column, keys: list[str], order: str = "pos") -> DataFrame:
    """Begin and end markers of a flow paired as a stack: keys, begin_pos, end_pos, depth.

    An end without a begin has begin_pos null, an unclosed begin end_pos null. An end matches the begin that
    stands directly before it among the markers of its own level, so that no stack has to be kept.
    """
    rows = markers.where(opens | closes).withColumn("_d", F.when(opens, 1).otherwise(-1))
    rows = rows.withColumn("_sum", F.sum("_d").over(_upto(keys, order)))
    rows = rows.withColumn("_level", F.when(F.col("_d") == 1, F.col("_sum")).otherwise(F.col("_sum") + 1))
    own = Window.partitionBy(*keys, "_level").orderBy(order)
    rows = rows.withColumn("_next_d", F.lead("_d").over(own)).withColumn("_next", F.lead(order).over(own)).withColumn("_prev_d", F.lag("_d").over(own))
    begins = rows.where("_d = 1").select(*keys, F.col(order).alias("begin_pos"), F.when(F.col("_next_d") == -1, F.col("_next")).alias("end_pos"), F.col("_level").cast("long").alias("level"))
    orphans = rows.where("_d = -1 and (_prev_d is null or _prev_d = -1)").select(*keys, F.lit(None).cast(begins.schema["begin_pos"].dataType).alias("begin_pos"), F.col(order).alias("end_pos"), F.col("_level").cast("long").alias("level"))
    return begins.unionByName(orphans)


def pair_ranges(starts: DataFrame, ends: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The n-th start and the n-th end of a key in order: keys, start_pos, end_pos, status (paired, reversed, orphan end, unclosed)."""
    w = Window.partitionBy(*keys).orderBy(order)
    a = starts.select(*keys, F.col(order).alias("start_pos"), F.row_number().over(w).alias("nth"))
    b = ends.select(*keys, F.col(order).alias("end_pos"), F.row_number().over(w).alias("nth"))
    both = a.join(b, [*keys, "nth"], "full_outer")
    status = F.when(F.col("start_pos").isNull(), "orphan end").when(F.col("end_pos").isNull(), "unclosed").when(F.col("start_pos") > F.col("end_pos"), "reversed").otherwise("paired")
    return both.withColumn("nth", F.col("nth").cast("long")).withColumn("status", status)


def list_counters(items: DataFrame, keys: list[str], order: str = "pos", level: str = "level", start: int = 1, levels: int = 9) -> DataFrame:
    """The counter of each list item at its level: a lower level met since the last item restarts it.

    Epochs: an item of level k restarts all deeper levels, so the counter is the item's place among
    those of its level since the last lower level. One running sum a level; no sequential code.
    """
    running = _upto(keys, order)
    rows = items
    for k in range(1, levels):
        rows = rows.withColumn(f"_e{k}", F.sum(F.when(F.col(level) < k, 1).otherwise(0)).over(running))
    epoch = F.coalesce(*[F.when(F.col(level) == k, F.col(f"_e{k}")) for k in range(1, levels)], F.lit(0))
    rows = rows.withColumn("_epoch", epoch)
    own = Window.partitionBy(*keys, level, "_epoch").orderBy(order)
    return rows.withColumn("counter", (F.row_number().over(own) + start - 1).cast("long")).drop("_epoch", *[f"_e{k}" for k in range(1, levels)])


def last_declared(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """The value declared last at or before each row; one declared nowhere before stays null."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(_upto(keys, order)))


def next_declared(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """The first value at or after each row: the section that a node belongs to."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn(out, F.first(value, ignorenulls=True).over(w))


def island(rows: DataFrame, keys: list[str], order: str, breaks: Column, out: str) -> DataFrame:
    """Number of breaks before each row: a row that breaks belongs to what it ends."""
    b = F.when(breaks, 1).otherwise(0)
    return rows.withColumn(out, (F.sum(b).over(_upto(keys, order)) - b).cast("long"))


def settled(df: DataFrame) -> DataFrame:
    """df kept under spark.checkpoint.dir (a local folder where that is absent), so that the plan of a loop doesn't grow."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"file://{tempfile.gettempdir()}/leafpress-work")
    return df.checkpoint()


def style_chain(styles: DataFrame) -> DataFrame:
    """Chains leaf to root over (style_id, based_on, kind): style_id, ancestor, distance.

    A chain ends at a style that is missing, of another kind, or met before. Styles are declarations, few a
    document; every step is a join on keys, and a step without a row ends the search.
    """
    keys = [c for c in ("doc_id",) if c in styles.columns]
    parents = styles.select(*keys, F.col("style_id").alias("ancestor"), F.col("based_on").alias("up"), F.col("kind").alias("up_kind"))
    step = settled(styles.select(*keys, "style_id", F.col("style_id").alias("ancestor"), F.lit(0).cast("long").alias("distance"), F.col("based_on").alias("next"), "kind", F.array("style_id").alias("seen")))
    out = None
    while not step.isEmpty():
        out = step if out is None else out.unionByName(step)
        found = step.select(*keys, "style_id", F.col("next").alias("ancestor"), (F.col("distance") + 1).alias("distance"), "kind", "seen").where("ancestor is not null and not array_contains(seen, ancestor)")
        step = settled(found.join(parents, [*keys, "ancestor"]).where("kind = up_kind").select(*keys, "style_id", "ancestor", "distance", F.col("up").alias("next"), "kind", F.concat("seen", F.array("ancestor")).alias("seen")))
    return (step if out is None else out).select(*keys, "style_id", "ancestor", "distance")


def cascade(layers: DataFrame, keys: list[str], rank: str = "rank", prop: str = "prop", value: str = "value", source: str = "source") -> DataFrame:
    """The value of the highest layer that declares a property, and the layer it came from."""
    return layers.where(F.col(value).isNotNull()).groupBy(*keys, prop).agg(F.max_by(value, rank).alias(value), F.max_by(source, rank).alias(source))


def toggle(layers: DataFrame, keys: list[str], flag: str, direct: str, default: str) -> DataFrame:
    """A toggle property: a direct value wins, else the exclusive or of the layers that declare it, else the default.

    layers has a row for each layer: flag (nullable), direct (its value if the layer is direct formatting), default.
    """
    g = layers.groupBy(*keys).agg(F.bool_or(direct).alias("_direct"), F.bit_xor(F.col(flag).cast("int")).alias("_xor"), F.bool_or(default).alias("_default"))
    return g.select(*keys, F.coalesce("_direct", F.col("_xor") == 1, "_default", F.lit(False)).alias("value"), F.when(F.col("_direct").isNotNull(), "direct").when(F.col("_xor").isNotNull(), "styles").when(F.col("_default").isNotNull(), "defaults").otherwise("none").alias("source"))


def grid_check(cells: DataFrame, table: list[str], row: str = "row_ix") -> DataFrame:
    """Width of each row in grid columns and whether all rows of a table agree: table, columns, consistent, rows."""
    widths = cells.groupBy(*table, row).agg(F.sum("span").cast("long").alias("w"))
    return widths.groupBy(*table).agg(F.max("w").alias("columns"), (F.min("w") == F.max("w")).alias("consistent"), F.count("*").alias("rows"))


def column_widths(cells: DataFrame, table: list[str], col_ix: str = "col_ix", width: str = "width") -> DataFrame:
    """The widest unspanned cell of each column; complete only if every such cell has a width."""
    return cells.where("span = 1").groupBy(*table, col_ix).agg(F.max(width).alias("width"), F.bool_and(F.col(width).isNotNull()).alias("complete"))


def column_edges(cells: DataFrame, table: list[str], tolerance: int = 0, limit: int = 96) -> DataFrame:
    """Right edges of all rows' cells, snapped within a tolerance; a table of more than `limit` edges is left out."""
    running = Window.partitionBy(*table, "row_ix").orderBy("col_ix").rowsBetween(Window.unboundedPreceding, 0)
    edges = cells.select(*table, F.sum("width").over(running).alias("edge")).distinct()
    prev = F.lag("edge").over(Window.partitionBy(*table).orderBy("edge"))
    kept = edges.withColumn("_p", prev).where(F.col("_p").isNull() | (F.col("edge") - F.col("_p") > tolerance)).drop("_p")
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy(*table))).where(F.col("_n") <= limit).drop("_n")


def vertical_merges(cells: DataFrame, table: list[str]) -> DataFrame:
    """For each cell the row that its vertical merge starts in (its own row if it continues nothing)."""
    w = Window.partitionBy(*table, "col_ix").orderBy("row_ix").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(~F.col("continues"), F.col("row_ix")), ignorenulls=True).over(w)
    return cells.withColumn("start_row", F.coalesce(start, F.col("row_ix")))


def band_condition(row: Column, rows: Column, column: Column, columns: Column, band: int = 1) -> Column:
    """The strongest conditional format of a cell: first row, last row, first column, last column, then bands."""
    return F.when(row == 0, "firstRow").when(row == rows - 1, "lastRow").when(column == 0, "firstCol").when(column == columns - 1, "lastCol").when(F.floor((row - 1) / band) % 2 == 0, "band1Horz").otherwise("band2Horz")


def accepted(segments: DataFrame, kind: str = "rev", accept: bool = True) -> DataFrame:
    """The accept or reject view: deletions and move sources go when accepting, insertions and move targets when rejecting."""
    gone = ["del", "moveFrom"] if accept else ["ins", "moveTo"]
    return segments.where(F.col(kind).isNull() | ~F.col(kind).isin(*gone))


def fingerprint(segments: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """SHA-256 of each document's text in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text])
    return segments.groupBy(*keys).agg(F.sha2(F.array_join(parts, "\n"), 256).alias("fingerprint"))


def session_expiry(events: DataFrame, keys: list[str], ts: str, idle: str = "30 minutes") -> DataFrame:
    """Sessions that end after an idle time: keys, session_start, session_end (with the idle time), n."""
    w = F.session_window(F.col(ts), idle)
    return events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def allocate_ids(rows: DataFrame, keys: list[str], order: str, highest: DataFrame, out: str = "new_id") -> DataFrame:
    """New ids above the highest in use of each key; highest has keys and `top`."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.join(highest, keys, "left").withColumn(out, (F.coalesce("top", F.lit(0)) + F.row_number().over(w)).cast("long")).drop("top")


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (doc_id, id) that no chain of edges (doc_id, source, target) from a root reaches.

    A round for each step of the longest shortest chain, until a round finds nothing new.
    """
    reached = front = settled(roots.select("doc_id", "id").distinct())
    rounds = 0
    while not front.isEmpty():
        step = edges.join(front.withColumnRenamed("id", "source"), ["doc_id", "source"]).select("doc_id", F.col("target").alias("id")).distinct()
        front = settled(step.join(reached, ["doc_id", "id"], "left_anti"))
        rounds += 1
        reached = reached.unionByName(front)
        if rounds % 16 == 0:
            reached = settled(reached)
    return nodes.join(reached, ["doc_id", "id"], "left_anti")
