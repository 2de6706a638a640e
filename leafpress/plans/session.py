"""The user's surface: a set of documents and the tools over it, with budgets, cursors, versions and reports.

Reads are lazy DataFrames until the last page, which alone is collected, and only up to its budget. A
cursor is a token of (tool, configuration, snapshot, position): it holds nothing on the server.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.functions.text import utf16_length
from leafpress.operators import folding
from leafpress.operators import reading as R
from leafpress.operators import structure as S
from leafpress.operators.package_edits import fold_packages
from leafpress.sources import docx
from leafpress.sources.adapters import text_blocks

# Default budgets (UTF-16 units, bytes) of the tools, the number of reports and their bytes.
BUDGETS = {"outline": (4000, 16000), "find": (4000, 24000)}
DEFAULT_BUDGET = (8000, 24000)
REPORTS, REPORT_BYTES = 32, 16 << 20
VERSION = {"engine": "leafpress 0.1", "protocol": "1", "projection": "1"}

TOOLS: dict[str, Callable] = {}


class BadCursor(ValueError):
    """A token that this tool never issued, or with another configuration."""


class StaleCursor(ValueError):
    """A token of an older snapshot."""


class BudgetTooSmall(ValueError):
    """Not even one unit fits; carries the sizes that would do."""

    def __init__(self, limit: int, size: int):
        super().__init__(f"needs limit {limit} and maxBytes {size}")
        self.min_limit, self.min_bytes = limit, size


def tool(f: Callable) -> Callable:
    TOOLS[f.__name__] = f
    return f


def issue(name: str, config: dict, snapshot: str, at: list) -> str:
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
    return json.dumps([name, digest, snapshot, at]).encode().hex()


def resume(token: str, name: str, config: dict, snapshot: str) -> list:
    try:
        tool_name, digest, snap, at = json.loads(bytes.fromhex(token))
    except ValueError:
        raise BadCursor("unreadable cursor") from None
    if tool_name != name or digest != hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]:
        raise BadCursor("cursor of another request")
    if snap != snapshot:
        raise StaleCursor("the documents have changed since")
    return at


def _kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; without one (a notebook) it is computed whenever it is read."""
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df
    path = f"{base.rstrip('/')}/leafpress-{df.sparkSession.sparkContext.applicationId}/edited-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class DocSet:
    """Blocks (doc_id, block_ix, text, n16 and more) of a set of documents at one version."""

    blocks: DataFrame
    packages: DataFrame | None = None
    version: int = 0
    reports: list[dict] = field(default_factory=list)
    models: DataFrame | None = None

    @staticmethod
    def of_text(docs: DataFrame) -> DocSet:
        return DocSet(text_blocks(docs))

    @staticmethod
    def of_packages(spark: SparkSession, path: str) -> DocSet:
        packages = docx.read_packages(spark, path)
        return DocSet.of_content(packages)

    @staticmethod
    def of_content(packages: DataFrame) -> DocSet:
        found = docx.parts(packages)
        nodes = docx.nodes(found.where("uri like '%.xml' or uri like '%.rels'"))
        blocks = docx.blocks(nodes).join(docx.main_parts(found, nodes), ["doc_id", "part_id"]).withColumn("n16", utf16_length("text"))
        return DocSet(blocks, packages)

    def snapshot(self) -> str:
        """A hash of what is read, order-free, computed where the data is."""
        row = self.blocks.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "block_ix", "text").cast("decimal(38,0)"))).first()
        return f"{self.version}.{row[0]}.{row[1]}"

    def page(self, name: str, rows: DataFrame, order: list[str], text: str, cursor: str | None = None, limit: int | None = None, max_bytes: int | None = None, **config) -> dict:
        """Whole rows in order that fit the budget, and a cursor if more follow."""
        base = BUDGETS.get(name, DEFAULT_BUDGET)
        limit, max_bytes = limit or base[0], max_bytes or base[1]
        R.validate_budget(limit, max_bytes)
        snapshot = self.snapshot()
        if cursor:
            at = resume(cursor, name, config, snapshot)
            after = F.lit(False)
            for i in reversed(range(len(order))):
                after = (F.col(order[i]) > F.lit(at[i])) | ((F.col(order[i]) == F.lit(at[i])) & after)
            rows = rows.where(after)
        # A row holds a unit at least or a byte of JSON, so no more than max_bytes rows can fit.
        got, used, size, more = [], 0, 0, False
        for row in rows.orderBy(*order).limit(min(limit, max_bytes) + 1).toLocalIterator():
            record = row.asDict(recursive=True)
            n, b = len((record[text] or "").encode("utf-16-le")) // 2, len(json.dumps(record, ensure_ascii=False, default=str).encode())
            if used + n > limit or size + b > max_bytes:
                if not got:
                    raise BudgetTooSmall(n, b)
                more = True
                break
            got.append(record)
            used, size = used + n, size + b
        return {
            "records": got, "usage": {"contentUtf16": used, "responseBytes": size, "estimatedTokens": -(-size // 4)}, "hasMore": more,
            "cursor": issue(name, config, snapshot, [got[-1][c] for c in order]) if more else None,
        }

    # --- tools -----------------------------------------------------------------------------------

    @tool
    def text(self, **kw) -> dict:
        return self.page("text", self.blocks.select("doc_id", "block_ix", "text"), ["doc_id", "block_ix"], "text", **kw)

    @tool
    def outline(self, levels: tuple[int, int] = (1, 9), **kw) -> dict:
        """Headings where documents have them, else groups of 32 blocks."""
        rows = R.outline_groups(self.blocks).withColumnRenamed("group_ix", "place").withColumn("level", F.lit(None).cast("int"))
        if "level" in self.blocks.columns:
            heads = self.blocks.where(F.col("level").between(*levels)).select("doc_id", F.col("block_ix").alias("place"), F.col("text").alias("title"), F.lit(0).cast("long").alias("block_count"), F.col("n16").alias("char_count"), F.col("level").cast("int").alias("level"))
            rows = heads.unionByName(rows.join(heads.select("doc_id").distinct(), "doc_id", "left_anti"))
        return self.page("outline", rows, ["doc_id", "place"], "title", levels=list(levels), **kw)

    @tool
    def find(self, pattern: str, literal: bool = True, insensitive: bool = False, deadline_ms: int | None = None, max_hits: int = 1000, **kw) -> dict:
        """Hits with context. A deadline (1 to 2000 ms) cancels the search's jobs by their tag."""
        regex = R.validate_pattern(pattern, literal)
        regex = f"(?iu){regex}" if insensitive else regex
        hits = R.find_regex(self.blocks, regex, ["doc_id", "block_ix"]).orderBy("doc_id", "block_ix", "hit_ix").limit(max_hits)
        spark, tag, timer = self.blocks.sparkSession, f"find-{id(self)}", None
        if deadline_ms is not None:
            import threading

            if not 1 <= deadline_ms <= 2000:
                raise ValueError("deadline is from 1 to 2000 ms")
            spark.addTag(tag)
            timer = threading.Timer(deadline_ms / 1000, lambda: spark.interruptTag(tag))
            timer.start()
        try:
            return self.page("find", hits, ["doc_id", "block_ix", "hit_ix"], "match", pattern=pattern, literal=literal, insensitive=insensitive, **kw)
        finally:
            if timer:
                timer.cancel()
                spark.removeTag(tag)

    @tool
    def context(self, doc_id: int, block_ix: int, before: int = 2, after: int = 2, **kw) -> dict:
        rows = self.blocks.where((F.col("doc_id") == doc_id) & F.col("block_ix").between(block_ix - before, block_ix + after))
        return self.page("context", rows.select("doc_id", "block_ix", "text"), ["doc_id", "block_ix"], "text", doc_id=doc_id, block_ix=block_ix, before=before, after=after, **kw)

    @tool
    def model(self, fields: list[str] | None = None, block_range: tuple[int, int] | None = None, **kw) -> dict:
        """Columns and block ranges are pruned before anything is read."""
        rows = self.blocks if block_range is None else self.blocks.where((F.col("block_ix") >= block_range[0]) & (F.col("block_ix") < block_range[1]))
        unknown = set(fields or []) - set(rows.columns)
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        rows = rows.select(*dict.fromkeys(["doc_id", "block_ix", "text", *(fields or rows.columns)]))
        return self.page("model", rows, ["doc_id", "block_ix"], "text", fields=fields, block_range=block_range, **kw)

    @tool
    def diagnostics(self) -> DataFrame:
        """Parts and packages that can't be read."""
        if self.packages is None:
            return self.blocks.sparkSession.createDataFrame([], "doc_id long, uri string, error string")
        return docx.parts(self.packages).where("error is not null").select("doc_id", "uri", "error")

    @tool
    def media(self) -> DataFrame:
        if self.packages is None:
            return self.blocks.sparkSession.createDataFrame([], "doc_id long, uri string, size long")
        return docx.parts(self.packages).where("uri like '/word/media/%'").select("doc_id", "uri", "size")

    @tool
    def diff(self, other: DocSet) -> DataFrame:
        return R.positional_diff(self.blocks.select("doc_id", "block_ix", "text"), other.blocks.select("doc_id", "block_ix", "text"))

    @tool
    def check(self) -> dict[str, int]:
        """Violations of what must hold: none in a sound set."""
        starts = R.offsets(self.blocks.withColumn("n16", F.col("n16")), gap=0)
        out = {"cover": R.anchor_cover(starts).count(), "repeated": self.blocks.groupBy("doc_id", "block_ix").count().where("count > 1").count()}
        if self.packages is not None:
            none = self.packages.select("doc_id", F.lit("").alias("uri"), F.lit(None).cast("binary").alias("bytes")).limit(0)
            saved = docx.save(self.packages, none).select("doc_id", F.col("content").alias("saved"))
            out["identity"] = self.packages.join(saved, "doc_id").where("content <> saved").count()
        return out

    @tool
    def fingerprint(self) -> DataFrame:
        return S.fingerprint(self.blocks, ["doc_id"], ["block_ix"])

    @tool
    def summary(self) -> list[dict]:
        return list(self.reports)

    @staticmethod
    def version_info() -> dict[str, str]:
        return dict(VERSION)

    # --- edits -----------------------------------------------------------------------------------

    def as_models(self) -> DataFrame:
        """doc_id, model: the blocks of each document as an editable model."""
        if self.models is not None:
            return self.models
        rows = self.blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_ix", "text"))).alias("b"))

        def run(batches):
            for pdf in batches:
                pdf["model"] = [json.dumps(folding.empty([x["text"] for x in b])) for b in pdf.pop("b")]
                yield pdf

        return rows.mapInPandas(run, "doc_id long, model string")

    def preview(self, edits: DataFrame) -> DataFrame:
        """What edits (doc_id, batch, ops) would give, without a trace: doc_id, model (or content), version, receipts."""
        if self.packages is not None:
            return fold_packages(self.packages, edits)
        return folding.fold_edits(self.as_models(), edits)

    def save(self, folder: str) -> None:
        """The packages as files of a folder."""
        if self.packages is None:
            raise ValueError("a set of plain texts has no packages")
        docx.write_packages(self.packages, folder)

    @tool
    def edit(self, edits: DataFrame, expected_version: int) -> DocSet:
        """A new set one version on, with a report; refused if the version isn't the expected one. This set stays as it is."""
        if expected_version != self.version:
            raise ValueError(f"version is {self.version}, not {expected_version}")
        if self.packages is not None:
            # The edited packages are written down: what follows reads them many times.
            after = _kept(fold_packages(self.packages, edits))
            report = {"version": self.version + 1, "receipts": after.select("doc_id", "receipts")}
            again = DocSet.of_content(after.select("doc_id", "content"))
            return DocSet(again.blocks, again.packages, self.version + 1, [*self.reports, report][-REPORTS:])
        after = self.preview(edits)
        schema = "struct<blocks: array<struct<text: string>>>"
        spread = after.select("doc_id", F.posexplode(F.from_json("model", schema)["blocks"]).alias("block_ix", "b"))
        blocks = spread.select("doc_id", F.col("block_ix").cast("long").alias("block_ix"), F.coalesce(F.col("b")["text"], F.lit("")).alias("text")).withColumn("n16", utf16_length("text"))
        report = {"version": self.version + 1, "receipts": after.select("doc_id", "receipts")}
        return DocSet(blocks, None, self.version + 1, [*self.reports, report][-REPORTS:], after.select("doc_id", "model"))
