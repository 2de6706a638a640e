"""Effective values and comparisons: fonts, cells, batches of ids, property patches, JSON differences, diagnostics, placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafpress.functions.text import OBJECT, escape_markers, glob_regex, index_free_path
from leafpress.functions.values import language_font, on_off

# Explanations and the capability that each diagnostic takes away.
DIAGNOSTICS = {
    "truncated": ("the container ends early", "read"), "bad central directory": ("the list of parts is damaged", "read"), "checksum differs": ("a part's bytes are damaged", "part"), "too many parts": ("more parts than are allowed", "read"),
    "orphan end": ("an end without a start", "range"), "unclosed": ("a start without an end", "range"), "reversed": ("the end lies before the start", "range"),
}
# The largest height of a row in twips.
MAX_ROW_HEIGHT = 31680


def diagnostic_view(rows: DataFrame, code: str = "code") -> DataFrame:
    """explanation and impact of each diagnostic; a code that isn't known keeps its own name."""
    text = F.create_map(*[F.lit(x) for k, v in DIAGNOSTICS.items() for x in (k, v[0])])
    impact = F.create_map(*[F.lit(x) for k, v in DIAGNOSTICS.items() for x in (k, v[1])])
    return rows.withColumn("explanation", F.coalesce(text[F.col(code)], F.col(code))).withColumn("impact", F.coalesce(impact[F.col(code)], F.lit("unknown")))


def defect_counts(rows: DataFrame, code: str = "code") -> DataFrame:
    return rows.groupBy(code).agg(F.count("*").alias("n"))


def enforce(rows: DataFrame) -> None:
    """Raises if any violation is there; looks at one row at most."""
    first = rows.limit(1).collect()
    if first:
        raise AssertionError(f"invariant violated: {first[0].asDict()}")


def patch(before: Column, after: Column) -> Column:
    """struct(op, value): keep, unset or set, which a null alone can't tell."""
    return F.struct(F.when(before.eqNullSafe(after), "keep").when(after.isNull(), "unset").otherwise("set").alias("op"), F.when(~before.eqNullSafe(after), after).alias("value"))


def property_diff(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, op, before, after for the fields that change; owners on one side only have all their fields unset or set."""
    shape = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(f), F.col(f).cast("string")) for f in fields])))
    a, b = before.select(*keys, shape.alias("field", "before")), after.select(*keys, shape.alias("field", "after"))
    both = a.join(b, [*keys, "field"], "full_outer")
    return both.withColumn("op", patch(F.col("before"), F.col("after"))["op"]).where("op <> 'keep'")


def apply_patches(rows: DataFrame, patches: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The rows with `set` and `unset` patches (keys, field, op, after) carried out."""
    wide = patches.groupBy(*keys).agg(*[F.max(F.when(F.col("field") == f, F.struct("op", "after"))).alias(f"_{f}") for f in fields])
    joined = rows.join(wide, keys, "left")
    value = lambda f: F.when(F.col(f"_{f}.op") == "unset", F.lit(None)).when(F.col(f"_{f}.op") == "set", F.col(f"_{f}.after").cast(rows.schema[f].dataType)).otherwise(F.col(f))
    return joined.select(*[value(c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def json_leaves(df: DataFrame, keys: list[str], json: str, depth: int = 8) -> DataFrame:
    """keys, path, value: the leaves of a JSON text, with a.b and a[0] paths, down to a depth; deeper parts stay JSON."""
    rows = df.select(*keys, F.lit("").alias("path"), F.parse_json(json).alias("v"))
    out = None
    for _ in range(depth):
        kind = F.schema_of_variant("v")
        inner = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaves = rows.where(~F.coalesce(inner, F.lit(False))).select(*keys, "path", F.col("v").cast("string").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        nested = rows.where(inner)
        nested.createOrReplaceTempView("_nested")
        spark = df.sparkSession
        names = ", ".join(f"`{k}`" for k in keys)
        rows = spark.sql(f"SELECT {names}, CASE WHEN e.key IS NULL THEN concat(path, '[', e.pos, ']') WHEN path = '' THEN e.key ELSE concat(path, '.', e.key) END AS path, e.value AS v FROM _nested, LATERAL variant_explode(v) AS e")
    return out.unionByName(rows.select(*keys, "path", F.to_json("v").alias("value")))


def json_diff(expected: DataFrame, actual: DataFrame, keys: list[str], json: str) -> DataFrame:
    """keys, path, expected, actual for each leaf that differs or is on one side only."""
    a = json_leaves(expected, keys, json).withColumnRenamed("value", "expected").withColumn("_e", F.lit(True))
    b = json_leaves(actual, keys, json).withColumnRenamed("value", "actual").withColumn("_a", F.lit(True))
    both = a.join(b, [*keys, "path"], "full_outer")
    return both.where("_e is null or _a is null or not (expected <=> actual)").drop("_e", "_a")


def by_path_key(diffs: DataFrame) -> DataFrame:
    """Differences counted by path without indices, with a sample."""
    return diffs.groupBy(index_free_path("path").alias("key")).agg(F.count("*").alias("n"), F.min("path").alias("sample"))


def split_known(diffs: DataFrame, patterns: list[str]) -> DataFrame:
    """`known`: whether a path matches one of the globs of an allow-list."""
    any_ = F.lit(False)
    for p in patterns:
        any_ = any_ | F.col("path").rlike(glob_regex(p))
    return diffs.withColumn("known", any_)


def fonts(slots: DataFrame) -> DataFrame:
    """The face of each script: a direct face, else its theme slot's, else for an empty East Asian slot the language's.

    slots: keys, script (ascii, hAnsi, eastAsia, cs), face, theme_face, lang.
    """
    blank = F.coalesce("theme_face", F.lit("")) == ""
    return slots.withColumn("font", F.coalesce("face", F.when(~blank, F.col("theme_face")), F.when((F.col("script") == "eastAsia") & blank, language_font("lang"))))


def complex_script(cs: Column, plain: Column, complex_: Column) -> Column:
    """Bold, italic or size by whether the run is in a complex script."""
    return F.when(F.coalesce(cs, F.lit(False)), complex_).otherwise(plain)


def cell_borders(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Each edge from the highest layer that has it: layers are keys, rank, top, left, bottom, right."""
    edges = ["top", "left", "bottom", "right"]
    return layers.groupBy(*keys).agg(*[F.max_by(e, F.when(F.col(e).isNotNull(), F.col("rank"))).alias(e) for e in edges])


def row_height(height: Column, rule: Column) -> Column:
    """struct(height, rule): at most the largest height; the rule is atLeast without one."""
    return F.struct(F.least(height, F.lit(MAX_ROW_HEIGHT)).alias("height"), F.coalesce(rule, F.lit("atLeast")).alias("rule"))


def resolve_ids(ids: DataFrame, effective: DataFrame, keys: list[str], column: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """One row for each asked id, in order: its effective values, or an error for an id that isn't there. `carry` goes along."""
    asked = ids.select(*keys, *(carry or []), F.posexplode(column).alias("nth", "id"))
    found = asked.join(effective.withColumn("_found", F.lit(True)), [*keys, "id"], "left")
    return found.withColumn("error", F.when(F.col("_found").isNull(), F.concat(F.lit("no object "), F.col("id").cast("string")))).drop("_found")


def flow_ids(roots: DataFrame, keys: list[str]) -> DataFrame:
    """Flow roots numbered in document order."""
    return roots.withColumn("flow_id", (F.row_number().over(Window.partitionBy(*keys).orderBy("pre")) - 1).cast("long"))


def snap_to_fields(ranges: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """Range ends inside a field's code move to the field's borders: the start before it, the end behind it."""
    f = fields.select(*keys, F.col("begin_pos").alias("_b"), F.col("end_pos").alias("_e"))
    ids = [*keys, "id", "start", "end"]
    hit = ranges.join(f, keys, "left")
    inside = lambda c: (F.col("_b") < F.col(c)) & (F.col(c) <= F.col("_e"))
    return hit.groupBy(*ids).agg(F.least("start", F.min(F.when(inside("start"), F.col("_b")))).alias("snapped_start"), F.greatest("end", F.max(F.when(inside("end"), F.col("_e") + 1))).alias("snapped_end"))


def form_state(checked: Column, default: Column) -> Column:
    """A check box's state: what is set, else its default, else off."""
    return F.coalesce(on_off(checked), on_off(default), F.lit(False))


def vml_colour(value: Column) -> Column:
    """A VML colour as six hex digits: a name, #rgb, #rrggbb; an index in brackets after it is left out."""
    # Colour names.
    names = {"black": "000000", "white": "FFFFFF", "red": "FF0000", "green": "008000", "blue": "0000FF", "yellow": "FFFF00", "gray": "808080", "silver": "C0C0C0", "maroon": "800000", "navy": "000080", "purple": "800080", "teal": "008080", "olive": "808000", "lime": "00FF00", "aqua": "00FFFF", "fuchsia": "FF00FF"}
    v = F.lower(F.trim(F.regexp_replace(value, r"\[.*$", "")))
    short = F.regexp_replace(v, "^#([0-9a-f])([0-9a-f])([0-9a-f])$", "$1$1$2$2$3$3")
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(v.rlike("^#[0-9a-f]{6}$"), F.upper(F.substring(v, 2, 6))).when(v.rlike("^#[0-9a-f]{3}$"), F.upper(short)).otherwise(table[v])


def placeholder(kind: Column, nth: Column, detail: Column) -> Column:
    """What stands for an object in readable text."""
    tag = F.when(kind == "field", F.concat(F.lit("field "), detail, F.lit(" #"), nth.cast("string"))).when(kind.isin("image", "math", "ink"), F.concat(kind, F.lit(" #"), nth.cast("string"))).otherwise(kind)
    return F.concat(F.lit("["), tag, F.lit("]"))


def readable(segments: DataFrame, keys: list[str], order: str = "pre") -> DataFrame:
    """The canonical readable text of each block: plain text escaped, objects as placeholders, inserted and deleted text in marks."""
    nth = F.sum(F.when(F.col("text") == OBJECT, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    shown = F.when(F.col("text") == OBJECT, placeholder(F.coalesce("kind", F.lit("object")), nth, F.lit(""))).otherwise(escape_markers("text"))
    marked = F.when(F.col("rev").isNull(), shown).otherwise(F.concat(F.lit("["), F.col("rev"), F.lit("]"), shown, F.lit("[/"), F.col("rev"), F.lit("]")))
    rows = segments.withColumn("_shown", marked)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_shown"))), lambda x: x["_shown"]), "").alias("text"))


def table_text(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Tables as rows of cells between bars: keys, text. cells: keys, row_ix, col_ix, text."""
    rows = cells.groupBy(*keys, "row_ix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_ix", "text"))), lambda x: x["text"]), " | ").alias("r"))
    line = F.concat(F.lit("| "), F.col("r"), F.lit(" |"))
    return rows.select(*keys, "row_ix", line.alias("line")).groupBy(*keys).agg(F.concat(F.lit("[table]\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ix", "line"))), lambda x: x["line"]), "\n"), F.lit("\n[/table]")).alias("text"))
