"""Shared pieces of the training-data operators: work folders, table reads, vectorised words.

Words are found on the UTF-8 bytes of a whole Arrow batch at once: a 256-entry table tells word
bytes from separators, and a word's 64-bit hash is a difference of one running polynomial sum. No
Python object is made for a word. All bytes above 0x7F count as word bytes, so a multi-byte
character is never cut.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.sources.adapters import spread

#: Bytes of text that are worked on at once; a longer text is still worked on whole.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def workdir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session (tests, a notebook) may go without the setting; a local folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/leafpress-work"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/leafpress-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_work(spark: SparkSession) -> None:
    """Delete all that this application's operators have put down; results that weren't read yet go with it."""
    delete(spark, workdir(spark, "x").rsplit("/", 1)[0])


def persist(df: DataFrame, name: str, instead: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors.

    instead holds the folders that this one makes needless; they are deleted, and it is put in their place.
    """
    path = workdir(df.sparkSession, name)
    df.write.parquet(path)
    for old in instead or ():
        delete(df.sparkSession, old)
    if instead is not None:
        instead[:] = [path]
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A column that names a row, of a name that no table has.
ROW = "__leafpress_row"


def _plain_scan(df: DataFrame) -> bool:
    """Whether df is rows of a Parquet table, each at most once: only selections and filters over one scan."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.toString().lower()


def row_keys(df: DataFrame) -> DataFrame:
    """df with a number of its own for every row in column ROW, the same however often it is computed.

    Rows of a Parquet table are numbered by file and place in the file, which costs nothing. Any other
    frame is written down with its numbers.
    """
    if not _plain_scan(df):
        return persist(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    tagged = df.select("*", F.col("_metadata.file_path").alias(ROW + "f"), F.col("_metadata.row_index").alias(ROW + "i"))
    files = persist(tagged.groupBy(ROW + "f").agg(F.count("*")).select(ROW + "f").coalesce(1).sortWithinPartitions(ROW + "f").withColumn(ROW + "n", F.monotonically_increasing_id()), "files")  # a row a file
    return tagged.join(files, ROW + "f").withColumn(ROW, F.shiftleft(ROW + "n", 40) + F.col(ROW + "i")).drop(ROW + "f", ROW + "i", ROW + "n")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more than one row in so many is hot; there are fewer hot keys than this.
HOT = 1000


def join_by_key(rows: DataFrame, values: DataFrame, key: str, own: str) -> DataFrame:
    """rows with the columns of values, which has one row a key: key, size (its rows in rows) and others.

    Hot keys, fewer than HOT whatever the input, are sent out; their rows are dealt by column own
    instead of meeting in one task. Both frames are read twice, so they should be written tables.
    Rows whose key is null or has no value get nulls.
    """
    names = [c for c in values.columns if c not in (key, "size")]
    hot = values.where(F.col("size") * HOT > rows.count()).select(key, F.struct(*names).alias("__hot"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__part", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(own), F.lit(HOT)).cast("int")))
    cold = values.select(key, F.lit(0).alias("__part"), F.struct(*names).alias("__cold"))
    value = F.coalesce("__hot", "__cold")
    return dealt.join(cold, [key, "__part"], "left").select(*rows.columns, *[value[c].alias(c) for c in names])


# --- hashing ------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but U+0020 and U+0009 to U+000D.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[32, *range(9, 14)]] = False
#: Digits, lower-case ASCII letters and all beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ np.uint64(seed * 0xA24BAED4963EE407 & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            p, q = np.full(max(n, CHUNK_BYTES + 1), _BASE), np.full(max(n, CHUNK_BYTES + 1), _BASE_INV)
            p[0] = q[0] = 1
            _POW, _INV = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _POW[:n], _INV[:n]


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts buf[offs[i]:offs[i+1]], A-Z lower-cased: (text index, hash, start, end)."""
    b = LOWER[buf]
    m = table[b]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    first[inner] = m[inner]
    last[inner - 1] = m[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(len(buf) + 1)
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[:-1], out=run[1:])
    h = mix((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64))
    return np.searchsorted(offs[1:], start, side="right"), h, start, end


def texts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def shingles(doc: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text: (text index, hash)."""
    if len(h) < k:
        return doc[:0], h[:0]
    s = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        s = s * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i]
    own = doc[: len(s)] == doc[k - 1 :]
    return doc[: len(s)][own], mix(s[own], k)
