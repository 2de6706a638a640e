"""Queries of scalar functions: units, colours, codecs, JSON, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.functions import text as T
from leafpress.functions import values as V
from leafpress.plans.registry import Tables, query


@query("""WITH x AS (SELECT p_partkey, CAST(p_partkey * 7919 % 16777216 AS BIGINT) AS c, CAST(p_size * 5 AS DOUBLE) AS s FROM part), r AS (SELECT p_partkey, s, c // 65536 AS r, (c // 256) % 256 AS g, c % 256 AS b FROM x)
SELECT p_partkey, printf('%02X%02X%02X', CAST(r AS INTEGER), CAST(g AS INTEGER), CAST(b AS INTEGER)) AS rgb,
printf('%02X%02X%02X', CAST(floor(r * s / 255 + 0.5) AS INTEGER), CAST(floor(g * s / 255 + 0.5) AS INTEGER), CAST(floor(b * s / 255 + 0.5) AS INTEGER)) AS shaded,
printf('%02X%02X%02X', CAST(floor(r * s / 255 + (255 - s) + 0.5) AS INTEGER), CAST(floor(g * s / 255 + (255 - s) + 0.5) AS INTEGER), CAST(floor(b * s / 255 + (255 - s) + 0.5) AS INTEGER)) AS tinted FROM r""")
def colour_tint_shade(t: Tables) -> DataFrame:
    c = F.col("p_partkey") * 7919 % 16777216
    rows = t("part").select("p_partkey", F.lpad(F.hex(c), 6, "0").alias("rgb"), (F.col("p_size") * 5).cast("double").alias("s"))
    return rows.select("p_partkey", "rgb", V.tint_shade("rgb", shade=F.col("s")).alias("shaded"), V.tint_shade("rgb", tint=F.col("s")).alias("tinted"))


@query("SELECT p_partkey, CAST(floor(p_retailprice * 12700 + 0.5) AS BIGINT) AS emu, CAST(floor(p_size * 914400 + 0.5) AS BIGINT) AS inch, CAST(floor(p_size / 2.0 * 360000 + 0.5) AS BIGINT) AS cm, CAST(p_size * 20 AS BIGINT) AS twips FROM part")
def unit_lengths(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t("part").select(
        "p_partkey", V.emu(F.col("p_retailprice"), "pt").alias("emu"), V.parse_length(F.concat(size.cast("string"), F.lit("in"))).alias("inch"), V.parse_length(F.concat((size / 2).cast("string"), F.lit(" cm"))).alias("cm"),
        V.parse_measure(F.concat(size.cast("string"), F.lit("pt")), V.TWIPS_PER_POINT).alias("twips"),
    )


@query("SELECT event_id, CASE event_type WHEN 'view' THEN true WHEN 'click' THEN false WHEN 'signup' THEN true WHEN 'error' THEN false END AS flag FROM events")
def on_off_codec(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in {"view": " On", "click": "0", "signup": "TRUE", "error": "off", "purchase": "maybe"}.items() for x in kv])
    return t("events").select("event_id", V.on_off(names[F.col("event_type")]).alias("flag"))


@query("SELECT c_custkey, TRY_CAST(regexp_extract(substr(c_name, 10), '^\\s*([+-]?[0-9]+)', 1) AS BIGINT) AS n, TRY_CAST(c_mktsegment AS BIGINT) AS none, CASE WHEN TRY_CAST(c_mktsegment AS BIGINT) IS NULL THEN c_mktsegment END AS raw FROM customer")
def lenient_int(t: Tables) -> DataFrame:
    seg = V.value_or_raw("c_mktsegment", "bigint")
    return t("customer").select("c_custkey", T.first_int(F.substring("c_name", 10, 100)).alias("n"), seg["value"].alias("none"), seg["raw"].alias("raw"))


@query("SELECT p_partkey, CAST(DATE '1899-12-30' + CAST(p_partkey + 40000 AS INTEGER) AS VARCHAR) AS day FROM part")
def serial_dates(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", V.serial_date(F.col("p_partkey") + 40000).cast("string").alias("day"))


@query("SELECT page_id, lower(hex(encode(url))) AS token, url FROM pages")
def hex_tokens(t: Tables) -> DataFrame:
    return t("pages").select("page_id", T.hex_token("url").alias("token"), T.from_hex_token(T.hex_token("url")).alias("url"))


@query("SELECT page_id, regexp_matches(url, '^http.*/en/.*$') AS hit, regexp_replace(concat('main[', page_id, '].runs[0].text'), '\\[[0-9]+\\]', '[]', 'g') AS key FROM pages")
def glob_paths(t: Tables) -> DataFrame:
    path = F.concat(F.lit("main["), F.col("page_id").cast("string"), F.lit("].runs[0].text"))
    return t("pages").select("page_id", F.col("url").rlike(T.glob_regex("http*/en/*")).alias("hit"), T.index_free_path(path).alias("key"))


@query("SELECT doc_id, 'data:text/plain;base64,' || base64(encode(text)) AS url FROM documents")
def data_urls(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", T.data_url(F.lit("text/plain"), F.encode("text", "UTF-8")).alias("url"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS path FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_leaves(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))


@query("SELECT event_id, string_agg(k, ',' ORDER BY k) AS keys FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) GROUP BY event_id")
def canonical_json(t: Tables) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    return t("events").select("event_id", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys")).where("keys <> ''")


@query("""WITH s AS (SELECT p_partkey, replace(lower(p_type || ' ' || p_name), ' ', '_') AS snake FROM part), w AS (SELECT *, string_split(snake, '_') AS ws FROM s)
SELECT p_partkey, snake, ws[1] || array_to_string(list_transform(ws[2:], lambda w: upper(left(w, 1)) || substr(w, 2)), '') AS camel FROM w""")
def camel_names(t: Tables) -> DataFrame:
    """The type and name of every part, as one name."""
    snake = F.replace(F.lower(F.concat("p_type", F.lit(" "), "p_name")), F.lit(" "), F.lit("_"))
    return t("part").select("p_partkey", snake.alias("snake")).withColumn("camel", T.camel_case("snake"))


@query("SELECT s_suppkey, concat(CAST(s_nationkey AS VARCHAR), 'px') AS width, 'red' AS color FROM supplier")
def style_maps(t: Tables) -> DataFrame:
    m = V.style_pairs(F.concat(F.lit("Width : "), F.col("s_nationkey").cast("string"), F.lit("px ; COLOR:red;")))
    return t("supplier").select("s_suppkey", m["width"].alias("width"), m["color"].alias("color"))


@query("SELECT lang, count(*) AS n, CASE lang WHEN 'de' THEN 'SimSun' WHEN 'fr' THEN 'MS Mincho' WHEN 'es' THEN 'Batang' END AS font FROM documents GROUP BY lang")
def language_fonts(t: Tables) -> DataFrame:
    code = F.create_map(*[F.lit(x) for kv in {"de": "zh-CN", "fr": "ja-JP", "es": "ko-KR", "en": "en-US"}.items() for x in kv])
    return t("documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", "n", V.language_font(code[F.col("lang")]).alias("font"))


@query("""WITH s AS (SELECT l_orderkey, CAST(l_partkey * 7919 % 16777216 AS BIGINT) AS c FROM lineitem),
m AS (SELECT l_orderkey, count(*) AS n, floor(sum(c // 65536) / count(*) + 0.5) AS r, floor(sum((c // 256) % 256) / count(*) + 0.5) AS g, floor(sum(c % 256) / count(*) + 0.5) AS b FROM s GROUP BY l_orderkey)
SELECT l_orderkey, n, printf('%02X%02X%02X', CAST(r AS INTEGER), CAST(g AS INTEGER), CAST(b AS INTEGER)) AS mean FROM m""")
def gradient_stops(t: Tables) -> DataFrame:
    """An order is a gradient, its lines the stops."""
    stop = F.lpad(F.hex(F.col("l_partkey") * 7919 % 16777216), 6, "0")
    stops = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.collect_list(stop).alias("stops"))
    return stops.select("l_orderkey", "n", V.mean_colour("stops").alias("mean"))
