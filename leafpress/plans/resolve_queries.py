"""Queries of effective values, patches and JSON differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.operators import resolve as X
from leafpress.plans.registry import Tables, query


@query("""SELECT p_partkey, f AS field, op, before, after FROM (
SELECT p_partkey, 'p_size' AS f, CAST(p_size AS VARCHAR) AS before, CAST(p_size + (p_partkey % 2) AS VARCHAR) AS after, CASE WHEN p_partkey % 2 = 0 THEN 'keep' ELSE 'set' END AS op FROM part
UNION ALL SELECT p_partkey, 'p_brand', p_brand, CASE WHEN p_size <= 25 THEN p_brand END, CASE WHEN p_size <= 25 THEN 'keep' ELSE 'unset' END FROM part) WHERE op <> 'keep'""")
def property_diff(t: Tables) -> DataFrame:
    part = t("part").select("p_partkey", "p_size", "p_brand")
    after = part.select("p_partkey", (F.col("p_size") + F.col("p_partkey") % 2).alias("p_size"), F.when(F.col("p_size") <= 25, F.col("p_brand")).alias("p_brand"))
    return X.property_diff(part, after, ["p_partkey"], ["p_size", "p_brand"])


@query("SELECT p_partkey, CAST(p_size + (p_partkey % 2) AS BIGINT) AS p_size, CASE WHEN p_size <= 25 THEN p_brand END AS p_brand FROM part")
def property_apply(t: Tables) -> DataFrame:
    part = t("part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"), "p_brand")
    after = part.select("p_partkey", (F.col("p_size") + F.col("p_partkey") % 2).alias("p_size"), F.when(F.col("p_size") <= 25, F.col("p_brand")).alias("p_brand"))
    return X.apply_patches(part, X.property_diff(part, after, ["p_partkey"], ["p_size", "p_brand"]), ["p_partkey"], ["p_size", "p_brand"])


@query("""WITH k AS (SELECT event_id, unnest(json_keys(props)) AS path, props FROM events), v AS (SELECT event_id, path, json_extract_string(props, '$.' || path) AS value FROM k)
SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(a.path, b.path) AS path, a.value AS expected, b.value AS actual FROM (SELECT event_id + 1 AS event_id, path, value FROM v) a FULL OUTER JOIN v b ON a.event_id = b.event_id AND a.path = b.path
WHERE a.value IS DISTINCT FROM b.value""")
def json_diff(t: Tables) -> DataFrame:
    events = t("events").select("event_id", "props")
    return X.json_diff(events.withColumn("event_id", F.col("event_id") + 1), events, ["event_id"], "props")


@query("SELECT o_orderkey, least(CAST(floor(o_totalprice) AS BIGINT), 31680) AS height, 'atLeast' AS rule FROM orders")
def row_heights(t: Tables) -> DataFrame:
    h = X.row_height(F.floor(F.col("o_totalprice")), F.lit(None).cast("string"))
    return t("orders").select("o_orderkey", h["height"].alias("height"), h["rule"].alias("rule"))


@query("""SELECT c_custkey, nth, c_custkey + nth * 700 AS id, CASE WHEN b.k IS NULL THEN concat('no object ', c_custkey + nth * 700) END AS error, b.v AS value FROM (SELECT c_custkey, CAST(unnest([0, 1, 2]) AS BIGINT) AS nth FROM customer) q LEFT JOIN (SELECT c_custkey AS k, c_mktsegment AS v FROM customer) b ON b.k = c_custkey + nth * 700""")
def resolve_batch(t: Tables) -> DataFrame:
    asked = t("customer").select("c_custkey", F.array(*[F.col("c_custkey") + i * 700 for i in range(3)]).alias("ids"))
    every = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    # Every document may be asked for: the ids are looked up without a key around them.
    return X.resolve_ids(asked, every, [], carry=["c_custkey"]).select("c_custkey", F.col("nth").cast("long").alias("nth"), "id", "error", "value")


@query("""SELECT l_orderkey, concat('[table]', chr(10), string_agg(line, chr(10) ORDER BY l_linenumber), chr(10), '[/table]') AS text FROM (SELECT l_orderkey, l_linenumber, concat('| ', min(l_returnflag), ' | ', max(l_linestatus), ' |') AS line FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey""")
def table_text(t: Tables) -> DataFrame:
    g = t("lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("row_ix")).agg(F.min("l_returnflag").alias("a"), F.max("l_linestatus").alias("b"))
    cells = g.select("l_orderkey", "row_ix", F.posexplode(F.array("a", "b")).alias("col_ix", "text"))
    return X.table_text(cells, ["l_orderkey"])


@query("SELECT event_id, event_type AS code, CASE event_type WHEN 'view' THEN 'an end without a start' ELSE event_type END AS explanation, CASE event_type WHEN 'view' THEN 'range' ELSE 'unknown' END AS impact FROM events")
def diagnostic_view(t: Tables) -> DataFrame:
    rows = t("events").select("event_id", F.when(F.col("event_type") == "view", "orphan end").otherwise(F.col("event_type")).alias("c"), F.col("event_type").alias("code"))
    return X.diagnostic_view(rows, "c").drop("c")


@query("SELECT event_type AS code, count(*) AS n FROM events GROUP BY event_type")
def defect_counts(t: Tables) -> DataFrame:
    return X.defect_counts(t("events").select(F.col("event_type").alias("code")))
