"""Delta-maintained token counts by source, language and tokenizer version.

A ledger is a folder. Totals stand in it version by version: version n + 1 is version n plus the signed,
already added-up changes of one batch, so a commit costs the batch and the few rows of the totals,
never the batches before. log/<n> names the batch and the folder of version n. Whoever creates
that file first has committed: a writer that finds it taken looks whether its own batch is in by now,
and else adds its changes to the newer totals. What lost writers and failed attempts leave is never read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.llm.bpe import Encoder
from leafpress.llm.common import persist, texts, workdir

KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["docs", "tokens", "bytes"]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long, bytes long"


def _count_texts(column: pa.Array, encoder: Encoder) -> Iterator[int]:
    """Ids of each text; chunks that texts share are encoded once a worker."""
    for _, _, buf, offs in texts(column):
        yield from np.diff(encoder.run(buf, offs)[1]).tolist()


def _count(path: str, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path)
        for batch in batches:
            n = pa.array(_count_texts(batch.column(text_at), encoder), pa.int64())
            columns = [c for i, c in enumerate(batch.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*columns, n], names=[x for i, x in enumerate(batch.schema.names) if i != text_at] + ["n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, n_bytes, n_tokens of every row; a null text has none of either."""
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), "source", "lang", F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text")
    )
    return base.mapInArrow(_count(tokenizer_path, 4), "doc_id long, source string, lang string, n_bytes long, n_tokens long")


def inserts(counts: DataFrame, tokenizer: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"), F.col("n_bytes").alias("bytes"))


def deletes(counts: DataFrame, tokenizer: str) -> DataFrame:
    return inserts(counts, tokenizer).select(*KEYS, *[(-F.col(m)).alias(m) for m in MEASURES])


def revisions(old: DataFrame, new: DataFrame, tokenizer: str) -> DataFrame:
    """Both hold rows of the same documents before and after: what went is taken off, what came is added."""
    return deletes(old, tokenizer).unionByName(inserts(new, tokenizer))


def _added(changes: DataFrame) -> DataFrame:
    sums = changes.groupBy(*KEYS).agg(*[F.sum(F.coalesce(m, F.lit(0))).cast("long").alias(m) for m in MEASURES])
    return sums.where(" or ".join(f"{m} <> 0" for m in MEASURES))


class TokenLedger:
    """Totals of n documents, tokens and bytes by (source, lang, tokenizer); null keys are keys of their own.

    The folder's file system must create a file for one of several writers only, as HDFS and local disks do.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._log: list[tuple[str, str]] = []  # (batch, folder of the totals) of each version that was read

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _refresh(self) -> None:
        while True:
            fs, path = self._path(f"log/{len(self._log) + 1:012d}")
            if not fs.exists(path):
                return
            stream = fs.open(path)
            try:
                entry = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            self._log.append((entry["batch"], entry["totals"]))

    def batches(self) -> list[str]:
        """Names of the committed batches, in the order of their commits."""
        self._refresh()
        return [b for b, _ in self._log]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes (the columns of DELTA, any number of rows); False if it is there already."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch is named by letters, digits, _ . and -")
        if batch in self.batches():
            return False
        deltas = persist(_added(changes), "deltas")  # counted once, however often the commit is tried
        while batch not in self.batches():
            name = f"totals/{len(self._log) + 1:012d}-{uuid.uuid4().hex}"
            _added(self.totals().unionByName(deltas)).coalesce(1).write.parquet(f"{self.folder}/{name}")
            fs, path = self._path(f"log/{len(self._log) + 1:012d}")
            try:
                stream = fs.create(path, False)
            except Py4JJavaError:
                if not fs.exists(path):
                    raise
                continue  # another writer was first
            try:
                stream.write(json.dumps({"batch": batch, "totals": name}).encode())
            finally:
                stream.close()
            return True
        return False

    def totals(self) -> DataFrame:
        """The newest version; a key whose measures are all zero is gone."""
        self._refresh()
        if not self._log:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(f"{self.folder}/{self._log[-1][1]}")


def token_count_rollup(spark: SparkSession, docs: DataFrame, tokenizer_path: str, tokenizer: str) -> DataFrame:
    """A ledger's life over all documents: provisional counts come in, the first batch is sent twice, and the
    tokenizer's exact counts then replace the provisional ones, version and all.

    Returns source, lang, tokenizer, docs, tokens, bytes. Null sources and languages are groups of their own, a
    null or empty text counts as a document of no tokens, repeated rows count each, columns beside
    these are not looked at, and an empty table gives no rows.
    """
    ledger = TokenLedger(spark, workdir(spark, "ledger"))
    guess = docs.select("source", "lang", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    guess = inserts(guess.withColumn("n_tokens", F.ceil(F.col("n_bytes") / 4).cast("long")), "estimate")
    ledger.commit("provisional", guess)
    ledger.commit("provisional", guess)
    undo = ledger.totals().select(*KEYS, *[(-F.col(m)).alias(m) for m in MEASURES])
    ledger.commit("exact", undo.unionByName(inserts(count_tokens(docs, tokenizer_path), tokenizer)))
    return ledger.totals()
