"""An XPath subset compiled to joins over node tables: child and descendant steps, name and * tests, attributes,
text(), . and .., positions, attribute and child predicates; count, string and normalize-space around a path."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafpress.functions.text import collapse_space
from leafpress.sources.docx import string_values

KEYS = ["doc_id", "part_id"]
_STEP = re.compile(r"(//|/)?(\.\.|\.|text\(\)|@?[\w.*:-]+)((?:\[[^\]]*\])*)")


@dataclass
class Step:
    deep: bool
    test: str
    predicates: list[str] = field(default_factory=list)


def parse(path: str) -> list[Step]:
    steps, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or m.end() == at:
            raise ValueError(f"not in the subset: {path[at:]!r}")
        steps.append(Step(m.group(1) == "//", m.group(2), re.findall(r"\[([^\]]*)\]", m.group(3))))
        at = m.end()
    return steps


def _named(rows: DataFrame, test: str) -> DataFrame:
    local = test.rpartition(":")[2]
    if test == "text()":
        return rows.where("local = '#text'")
    return rows.where("local <> '#text'") if local == "*" else rows.where(F.col("local") == local)


def _attribute(name: str):
    local = name.rpartition(":")[2]
    found = F.filter(F.map_entries("attrs"), lambda e: F.regexp_replace(e["key"], r"^\{[^}]*\}", "") == local)
    return F.get(found, F.lit(0))["value"]


def select(nodes: DataFrame, path: str, context: DataFrame | None = None) -> DataFrame:
    """Nodes that a path reaches, each once, from the roots or from the nodes of `context`; a last @name step adds `value`.

    Names are compared without their prefix.
    """
    own = [*KEYS, "node_id", "parent_id", "pre", "post", "depth", "ns", "local", "attrs", "text"]
    nodes = nodes.select(*own)
    rows = context.select(*own) if context is not None else None
    for step in parse(path):
        if step.test.startswith("@"):
            base = rows if rows is not None else nodes
            return base.withColumn("value", _attribute(step.test[1:])).where("value is not null")
        if step.test == ".":
            continue
        if step.test == "..":
            up = rows.select(*KEYS, F.col("parent_id").alias("node_id")).distinct()
            rows = nodes.join(up, [*KEYS, "node_id"])
            continue
        if rows is None:
            found = _named(nodes if step.deep else nodes.where("parent_id is null"), step.test)
        elif step.deep:
            around = rows.select(*KEYS, F.col("pre").alias("_pre"), F.col("post").alias("_post"))
            found = _named(nodes, step.test).join(around, KEYS).where("pre > _pre and post < _post").drop("_pre", "_post").dropDuplicates([*KEYS, "node_id"])
        else:
            found = _named(nodes, step.test).join(rows.select(*KEYS, F.col("node_id").alias("parent_id")), [*KEYS, "parent_id"]).select(*own)
        for p in step.predicates:
            if p.isdigit() or p == "last()":
                w = Window.partitionBy(*KEYS, "parent_id")
                found = found.withColumn("_n", F.row_number().over(w.orderBy("pre"))).withColumn("_last", F.count("*").over(w))
                found = found.where(F.col("_n") == (F.col("_last") if p == "last()" else int(p))).drop("_n", "_last")
            elif m := re.fullmatch(r"@([\w:.-]+)(?:\s*(!?=)\s*['\"](.*)['\"])?", p):
                value = _attribute(m.group(1))
                found = found.where(value.isNotNull() if m.group(2) is None else value == m.group(3) if m.group(2) == "=" else value != m.group(3))
            elif re.fullmatch(r"[\w:.-]+", p):
                inner = _named(nodes, p).select(*KEYS, F.col("parent_id").alias("node_id")).distinct()
                found = found.join(inner, [*KEYS, "node_id"], "left_semi")
            else:
                raise ValueError(f"predicate not in the subset: {p!r}")
        rows = found
    return rows


def evaluate(nodes: DataFrame, expression: str) -> DataFrame:
    """doc_id, part_id, value (string): count(path), string(path) or normalize-space(path) of each part; of a bare path the count."""
    m = re.fullmatch(r"(count|string|normalize-space)\((.*)\)", expression.strip())
    kind, path = (m.group(1), m.group(2)) if m else ("count", expression)
    every = nodes.select(*KEYS).distinct()
    found = select(nodes, path)
    if kind == "count":
        got = found.groupBy(*KEYS).agg(F.count("*").cast("string").alias("value"))
        return every.join(got, KEYS, "left").withColumn("value", F.coalesce("value", F.lit("0")))
    if "value" in found.columns:
        got = found.groupBy(*KEYS).agg(F.min_by("value", "pre").alias("value"))
    else:
        first = found.groupBy(*KEYS).agg(F.min_by("node_id", "pre").alias("node_id"))
        chosen = found.join(first, [*KEYS, "node_id"])
        plain = chosen.where("local = '#text'").select(*KEYS, F.col("text").alias("value"))
        got = string_values(nodes, chosen.where("local <> '#text'").select(*KEYS, "node_id", "pre", "post")).select(*KEYS, "value").unionByName(plain)
    value = F.coalesce("value", F.lit(""))
    return every.join(got, KEYS, "left").withColumn("value", F.trim(collapse_space(value)) if kind == "normalize-space" else value)
