"""SimHash fingerprints and the search for all fingerprints within a Hamming radius, in DataFrame functions.

Terms are pairs of neighbouring words, weighted by their length in bytes, so that pairs of short
function words count less. Each term's 64-bit hash votes on 64 bits. A sum holds two bits' votes in
lanes of 32 bits, which can't overflow: the weights of a text add up to at most twice its bytes.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafpress.llm.common import join_by_key, persist, shuffle_partitions
from leafpress.llm.ordered import NULL_ID, range_bucket

_LANES = 0x0000000100000001


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and `fp`, the 64-bit fingerprint (long) of the text; rows with equal keys are one text.

    A text without words has fingerprint 0. Needs no exchange if df is already dealt by some of keys.
    """
    spread = df.select(*keys, F.split(F.coalesce(F.lower(text), F.lit("")), r"\s+").alias("_w")).select(*keys, "_w", F.posexplode("_w").alias("_i", "_a"))
    follow = F.try_element_at("_w", F.col("_i") + 2)
    weight = F.octet_length("_a") + F.coalesce(F.octet_length(follow), F.lit(0))
    terms = spread.select(*keys, F.xxhash64("_a", follow).alias("_h"), F.when(F.col("_a") == "", 0).otherwise(weight).cast("long").alias("_x"))
    votes = terms.groupBy(*keys).agg(
        F.sum("_x").alias("_all"),
        *[F.sum(F.col("_x") * F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(_LANES))).alias(f"_v{i}") for i in range(32)],
    )
    fp = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"_v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_v{i}", 32)
        fp = fp.bitwiseOR(F.when(2 * low > F.col("_all"), F.lit(1 << i)).otherwise(F.lit(0)))
        fp = fp.bitwiseOR(F.when(2 * high > F.col("_all"), F.lit((1 << (i + 32)) - (1 << 64 if i == 31 else 0))).otherwise(F.lit(0)))
    return votes.select(*keys, fp.alias("fp"))


def hex16(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: str, b: str) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def near_fingerprints(fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs of different fingerprints a < b (long column `fp`, repeats allowed) within the radius, with `distance`.

    The 64 bits are cut into blocks. Two fingerprints that differ in at most `radius` bits agree on
    blocks - radius blocks at least, so a table for each choice of that many blocks, keyed by their
    bits, finds every pair; a pair counts in the first table that has it. Nulls are left out.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be under blocks")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    tables = [sum(masks[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in tables]
    distinct = fps.where("fp is not null").select("fp").distinct()
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "k"))
    left, right = keyed.select("t", "k", F.col("fp").alias("a")), keyed.select("t", "k", F.col("fp").alias("b"))
    pairs = left.join(right, ["t", "k"]).where("a < b").withColumn("x", F.col("a").bitwiseXOR(F.col("b")))
    agree = F.array(*[F.col("x").bitwiseAND(F.lit(m)) == 0 for m in signed])
    return pairs.withColumn("distance", F.bit_count("x")).where((F.col("distance") <= radius) & (F.array_position(agree, True) == F.col("t") + 1)).select("a", "b", "distance")


def simhash_edited(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited forms, and the likeness to both neighbours.

    The edited text has its last floor(n/3) code points replaced by the first as many of the next
    document in descending id order (after the last the first; a single row is its own next). Null
    texts count as empty; null ids come last; equal ids are ordered by text, descending. Returns a
    row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_near (other rows whose fingerprint is within the radius).

    The text moves once, dealt by ranges of ids; the next document of a range's last row is the
    first of the following range, fetched by id from a list of one id a range.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bucket = range_bucket(base.select("id"), "id", 4 * shuffle_partitions(spark))
    base = base.withColumn("bucket", bucket)
    # One row a range from here on: the ids that open each range, and the range after it.
    opens = base.groupBy("bucket").agg(F.max("id").alias("id"))
    heads = base.join(F.broadcast(opens), ["bucket", "id"]).groupBy("bucket").agg(F.max("text").alias("text"))
    order = Window.orderBy("bucket")
    after = opens.select("bucket", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("after"))
    heads = persist(heads.join(fingerprints(heads, ["bucket"], "text"), "bucket"), "heads")
    edge = after.join(heads.select(F.col("bucket").alias("after"), F.col("text").alias("edge_text"), F.col("fp").alias("edge_fp")), "after").drop("after")

    own = Window.partitionBy("bucket").orderBy(F.desc("id"), F.desc("text"))
    rows = base.withColumn("row", F.row_number().over(own)).withColumn("next", F.lead("text").over(own))
    rows = rows.join(edge, "bucket", "left")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next", "edge_text"), F.lit(1), cut))
    rows = rows.select("bucket", "row", "id", "edge_fp", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.select("bucket", "row", "id", "edge_fp", "n_chars", F.sha2("edited", 256).alias("sha"), F.posexplode(F.array("text", "edited")).alias("which", "t"))
    keys = ["bucket", "row", "id", "edge_fp", "n_chars", "sha"]
    both = fingerprints(rows, [*keys, "which"], "t")
    wide = both.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("efp"))
    wide = wide.withColumn("nfp", F.coalesce(F.lead("fp").over(Window.partitionBy("bucket").orderBy("row")), "edge_fp"))
    wide = persist(wide.select("id", "n_chars", "sha", "fp", "efp", "nfp"), "prints")

    sizes = wide.groupBy("fp").agg(F.count("*").alias("size"))
    pairs = near_fingerprints(sizes.select("fp"), radius)
    pairs = pairs.select("a", "b").union(pairs.select("b", "a"))
    other = pairs.join(sizes.select(F.col("fp").alias("b"), "size"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("size").alias("others"))
    counts = sizes.join(other, "fp", "left").select("fp", "size", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))
    return join_by_key(wide, persist(counts, "near"), "fp", "id").select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"), hex16("fp").alias("fingerprint"), hex16("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"), likeness("fp", "nfp").alias("near_next"), "n_near",
    )
