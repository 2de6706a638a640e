"""Streaming forms, an extension beyond single documents: idle expiry of sessions, and edits applied as they come."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafpress.operators import folding


def expiring_sessions(accesses: DataFrame, key: str = "user_id", ts: str = "ts", idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, session_start, session_end, n of a stream of accesses; rows later than `late` are left out.

    State is one window a key and open session, dropped with the watermark. An access exactly when the idle
    time is over joins the session here, while the batch form opens a new one.
    """
    w = F.session_window(F.col(ts), idle)
    grouped = accesses.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


class EditProcessor(StatefulProcessor):
    """Keeps each document's model as state and folds batches of edits into it, each batch once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", "model string, version long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        model, version, last = self.model.get() if self.model.exists() else (json.dumps(folding.empty([])), 0, -1)
        out = []
        for batch, ops in sorted((int(b), o) for pdf in rows for b, o in zip(pdf.batch, pdf.ops)):
            if batch <= last:
                continue
            try:
                after, ran = folding.apply_batch(json.loads(model), json.loads(ops or "[]"))
                model, version, note = json.dumps(after), version + 1, f"applied {len(ran)}"
            except folding.Refused as why:
                note = f"refused: {why}"
            last = batch
            out.append((key[0], batch, version, note))
        self.model.update((model, version, last))
        yield pd.DataFrame(out, columns=["doc_id", "batch", "version", "note"])

    def close(self) -> None:
        pass


def apply_edit_stream(edits: DataFrame) -> DataFrame:
    """A stream of (doc_id, batch, ops) to receipts (doc_id, batch, version, note). Needs the RocksDB state store."""
    return edits.groupBy("doc_id").transformWithStateInPandas(EditProcessor(), "doc_id long, batch long, version long, note string", "Update", "None")
