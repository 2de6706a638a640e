import datetime
import json

import pytest

from leafpress.operators import structure as S
from leafpress.streaming import sessions


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_sessions_expire(spark, tmp_path):
    rows = [(1, at(0)), (1, at(29)), (1, at(60)), (1, at(120)), (2, at(5)), (9, at(2000))]
    spark.createDataFrame(rows, "user_id long, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/in")
    q = sessions.expiring_sessions(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("closed").collect()}
    assert got == {(1, at(0), at(59), 2), (1, at(60), at(90), 1), (1, at(120), at(150), 1), (2, at(5), at(35), 1)}
    batch = S.session_expiry(spark.read.parquet(f"{tmp_path}/in"), ["user_id"], "ts")
    assert got == {tuple(r) for r in batch.where("user_id < 9").collect()}


def test_edit_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    new = json.dumps([{"op": "insertBlock", "at": {}, "block": {"text": "x"}}])
    spark.createDataFrame([(1, 0, new), (1, 1, "[{}]"), (2, 0, new)], "doc_id long, batch long, ops string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, batch long, ops string").parquet(f"{tmp_path}/in")
    q = sessions.apply_edit_stream(stream).writeStream.format("memory").queryName("receipts").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        got = sorted((r.doc_id, r.batch, r.version, r.note.split()[0]) for r in spark.table("receipts").collect())
        assert got == [(1, 0, 1, "applied"), (1, 1, 1, "refused:"), (2, 0, 1, "applied")]
    finally:
        q.stop()
