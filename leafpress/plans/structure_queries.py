"""Queries of ordered and nested structure, over the tables that stand in for markers, lists, sections and styles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafpress.functions import fields as I
from leafpress.functions import values as V
from leafpress.operators import reading as R
from leafpress.operators import structure as S
from leafpress.plans.registry import Tables, query
from leafpress.sources.adapters import event_markers, turn_blocks

MARKERS = """m AS (SELECT user_id AS flow_id, event_id, event_type AS marker, value, epoch_us(ts) AS at0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"""


@query(f"""WITH {MARKERS}, d AS (SELECT *, CASE WHEN marker = 'view' THEN 1 ELSE -1 END AS d FROM m WHERE marker IN ('view', 'purchase')),
s AS (SELECT *, sum(d) OVER (PARTITION BY flow_id ORDER BY pos) AS sm FROM d), l AS (SELECT *, CASE WHEN d = 1 THEN sm ELSE sm + 1 END AS level FROM s),
x AS (SELECT *, lead(d) OVER w AS nd, lead(pos) OVER w AS np, lag(d) OVER w AS pd FROM l WINDOW w AS (PARTITION BY flow_id, level ORDER BY pos))
SELECT flow_id, pos AS begin_pos, CASE WHEN nd = -1 THEN np END AS end_pos, CAST(level AS BIGINT) AS level FROM x WHERE d = 1 UNION ALL SELECT flow_id, NULL, pos, CAST(level AS BIGINT) FROM x WHERE d = -1 AND (pd IS NULL OR pd = -1)""")
def field_pairs(t: Tables) -> DataFrame:
    return S.pair_nested(event_markers(t("events")), F.col("marker") == "view", F.col("marker") == "purchase", ["flow_id"])


@query(f"""WITH {MARKERS}, a AS (SELECT flow_id, pos AS start_pos, row_number() OVER (PARTITION BY flow_id ORDER BY pos) AS nth FROM m WHERE marker = 'view'), b AS (SELECT flow_id, pos AS end_pos, row_number() OVER (PARTITION BY flow_id ORDER BY pos) AS nth FROM m WHERE marker = 'click')
SELECT coalesce(a.flow_id, b.flow_id) AS flow_id, coalesce(a.nth, b.nth) AS nth, start_pos, end_pos, CASE WHEN start_pos IS NULL THEN 'orphan end' WHEN end_pos IS NULL THEN 'unclosed' WHEN start_pos > end_pos THEN 'reversed' ELSE 'paired' END AS status FROM a FULL OUTER JOIN b ON a.flow_id = b.flow_id AND a.nth = b.nth""")
def range_pairs(t: Tables) -> DataFrame:
    m = event_markers(t("events"))
    return S.pair_ranges(m.where("marker = 'view'"), m.where("marker = 'click'"), ["flow_id"])


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def orphan_spans(t: Tables) -> DataFrame:
    opened = t("orders").select("o_orderkey", F.lit(0).alias("pos"))
    closed = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("pos"))
    return S.pair_ranges(opened, closed, ["o_orderkey"]).where("status = 'unclosed'").select("o_orderkey")


@query(f"""WITH {MARKERS}, r AS (SELECT flow_id, event_id AS span_id, pos AS lo, pos + 3 AS hi FROM m WHERE marker = 'signup')
SELECT m.flow_id, m.pos, count(span_id) AS covering, min(span_id) AS first_span FROM m JOIN r ON m.flow_id = r.flow_id AND r.lo <= m.pos AND m.pos < r.hi GROUP BY m.flow_id, m.pos""")
def interval_cover(t: Tables) -> DataFrame:
    m = event_markers(t("events"))
    spans = m.where("marker = 'signup'").select("flow_id", F.col("event_id").alias("span_id"), F.col("pos").alias("start16"), (F.col("pos") + 3).alias("end16"))
    return R.locate(m.select("flow_id", "pos"), spans, ["flow_id"], at="pos").groupBy("flow_id", "pos").agg(F.count("span_id").alias("covering"), F.min("span_id").alias("first_span"))


@query(f"""WITH {MARKERS}, r AS (SELECT flow_id, pos AS "start", pos + CAST(floor(value) AS BIGINT) % 5 + 1 AS "end" FROM m WHERE marker IN ('view', 'click') AND value IS NOT NULL),
n AS (SELECT *, CASE WHEN coalesce(max("end") OVER (PARTITION BY flow_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= "start", false) THEN 0 ELSE 1 END AS f FROM r),
i AS (SELECT *, sum(f) OVER (PARTITION BY flow_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT flow_id, min("start") AS "start", max("end") AS "end", count(*) AS merged FROM i GROUP BY flow_id, island""")
def interval_merge(t: Tables) -> DataFrame:
    m = event_markers(t("events")).where("marker in ('view', 'click') and value is not null")
    ranges = m.select("flow_id", F.col("pos").alias("start"), (F.col("pos") + F.floor("value") % 5 + 1).alias("end"))
    return R.merge_intervals(ranges, ["flow_id"])


_LEVEL = "CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2 ELSE 3 END"


@query(f"""WITH i AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS pos, CAST(max({_LEVEL}) AS BIGINT) AS level FROM lineitem GROUP BY 1, 2),
e AS (SELECT *, coalesce(CASE level WHEN 1 THEN 0 WHEN 2 THEN sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) OVER w WHEN 3 THEN sum(CASE WHEN level < 3 THEN 1 ELSE 0 END) OVER w END, 0) AS ep FROM i WINDOW w AS (PARTITION BY l_suppkey ORDER BY pos))
SELECT l_suppkey, pos, level, row_number() OVER (PARTITION BY l_suppkey, level, ep ORDER BY pos) AS counter FROM e""")
def list_markers(t: Tables) -> DataFrame:
    items = t("lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.expr(_LEVEL).cast("long").alias("level")).groupBy("l_suppkey", "pos").agg(F.max("level").alias("level"))
    return S.list_counters(items, ["l_suppkey"], levels=4).select("l_suppkey", "pos", "level", "counter")


@query("""SELECT p_partkey, p_size, ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][p_size // 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][p_size % 10 + 1] AS raw_roman,
repeat(chr(CAST(97 + (p_size - 1) % 26 AS INTEGER)), (p_size - 1) // 26 + 1) AS letter, CASE WHEN p_size < 10 THEN concat('0', p_size) ELSE CAST(p_size AS VARCHAR) END AS zero FROM part""")
def number_formats(t: Tables) -> DataFrame:
    n = F.col("p_size")
    return t("part").select("p_partkey", "p_size", V.format_number(F.lit("lowerRoman"), n).alias("raw_roman"), V.format_number(F.lit("lowerLetter"), n).alias("letter"), V.format_number(F.lit("decimalZero"), n).alias("zero"))


@query(f"""WITH {MARKERS} SELECT flow_id, pos, last_value(CASE WHEN marker = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY flow_id ORDER BY pos) AS header FROM m""")
def section_inherit(t: Tables) -> DataFrame:
    m = event_markers(t("events")).withColumn("declared", F.expr("CASE WHEN marker = 'signup' THEN event_id END"))
    return S.last_declared(m, ["flow_id"], "pos", "declared", "header").select("flow_id", "pos", "header")


@query(f"""WITH {MARKERS} SELECT flow_id, pos, first_value(CASE WHEN marker = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY flow_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS section,
CAST(sum(CASE WHEN marker = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY pos) - CASE WHEN marker = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS section_ix FROM m""")
def section_of(t: Tables) -> DataFrame:
    m = event_markers(t("events")).withColumn("sect", F.expr("CASE WHEN marker = 'purchase' THEN event_id END"))
    rows = S.island(S.next_declared(m, ["flow_id"], "pos", "sect", "section"), ["flow_id"], "pos", F.col("marker") == "purchase", "section_ix")
    return rows.select("flow_id", "pos", "section", "section_ix")


_STYLES = """st AS (SELECT concat('c', c_custkey) AS style_id, concat('n', c_nationkey) AS based_on, 'p' AS kind FROM customer UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), 'p' FROM nation UNION ALL SELECT concat('r', r_regionkey), CASE WHEN r_regionkey > 0 THEN concat('r', r_regionkey - 1) ELSE 'r4' END, 'p' FROM region)"""


@query(f"""WITH RECURSIVE {_STYLES}, ch AS (SELECT style_id, style_id AS ancestor, CAST(0 AS BIGINT) AS distance, based_on AS nxt, [style_id] AS seen FROM st UNION ALL
SELECT ch.style_id, st.style_id, ch.distance + 1, st.based_on, list_append(ch.seen, st.style_id) FROM ch JOIN st ON st.style_id = ch.nxt WHERE NOT list_contains(ch.seen, st.style_id))
SELECT style_id, ancestor, distance FROM ch""")
def style_chain(t: Tables) -> DataFrame:
    customer = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("style_id"), F.concat(F.lit("n"), "c_nationkey").alias("based_on"))
    nation = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("style_id"), F.concat(F.lit("r"), "n_regionkey").alias("based_on"))
    region = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("style_id"), F.expr("CASE WHEN r_regionkey > 0 THEN concat('r', r_regionkey - 1) ELSE 'r4' END").alias("based_on"))
    return S.style_chain(customer.union(nation).union(region).withColumn("kind", F.lit("p")))


_LAYERS = """ly AS (SELECT p_partkey AS run, 'size' AS prop, CAST(1 AS BIGINT) AS "rank", 'defaults' AS source, 10.0 AS value FROM part UNION ALL SELECT p_partkey, 'size', 2, 'paragraph style', CASE WHEN p_size > 20 THEN CAST(p_size AS DOUBLE) END FROM part
UNION ALL SELECT p_partkey, 'size', 3, 'direct', CASE WHEN p_retailprice > 1200 THEN p_retailprice END FROM part UNION ALL SELECT p_partkey, 'weight', 2, 'paragraph style', CASE WHEN p_type LIKE '%STEEL%' THEN 1.0 END FROM part)"""


@query(f"""WITH {_LAYERS} SELECT run, prop, CAST(arg_max(value, "rank") AS DOUBLE) AS value, arg_max(source, "rank") AS source FROM ly WHERE value IS NOT NULL GROUP BY run, prop""")
def cascade(t: Tables) -> DataFrame:
    part = t("part")

    def layer(prop, rank, source, value):
        return part.select(F.col("p_partkey").alias("run"), F.lit(prop).alias("prop"), F.lit(rank).cast("long").alias("rank"), F.lit(source).alias("source"), F.expr(value).cast("double").alias("value"))

    layers = layer("size", 1, "defaults", "10.0").union(layer("size", 2, "paragraph style", "CASE WHEN p_size > 20 THEN p_size END"))
    layers = layers.union(layer("size", 3, "direct", "CASE WHEN p_retailprice > 1200 THEN p_retailprice END")).union(layer("weight", 2, "paragraph style", "CASE WHEN p_type LIKE '%STEEL%' THEN 1.0 END"))
    return S.cascade(layers, ["run"])


@query("""WITH x AS (SELECT l_orderkey, l_returnflag = 'A' AS flag, CASE WHEN l_linestatus = 'F' AND l_quantity > 45 THEN true END AS direct, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag = 'A' END AS declared FROM lineitem),
g AS (SELECT l_orderkey, bool_or(direct) AS d, bit_xor(CAST(declared AS INTEGER)) AS x FROM x GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(d, x = 1, false) AS value, CASE WHEN d IS NOT NULL THEN 'direct' WHEN x IS NOT NULL THEN 'styles' ELSE 'none' END AS source FROM g""")
def toggle_xor(t: Tables) -> DataFrame:
    layers = t("lineitem").select("l_orderkey", F.expr("CASE WHEN l_linestatus = 'F' AND l_quantity > 45 THEN true END").alias("direct"), F.expr("CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END").alias("flag"), F.lit(None).cast("boolean").alias("fallback"))
    return S.toggle(layers, ["l_orderkey"], "flag", "direct", "fallback")


_CELLS = "raw AS (SELECT l_orderkey AS tbl, CAST(l_linenumber AS BIGINT) AS row_ix, CAST(0 AS BIGINT) AS col_ix, CAST(l_quantity AS BIGINT) % 3 + 1 AS span, CAST(l_quantity AS BIGINT) * 10 AS width, l_returnflag = 'N' AS cont FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 1, CAST(l_quantity AS BIGINT) % 2 + 1, CASE WHEN l_discount > 0.02 THEN CAST(l_quantity AS BIGINT) * 7 END, l_returnflag = 'R' FROM lineitem), cells AS (SELECT tbl, row_ix, col_ix, max(span) AS span, max(width) AS width, bool_or(cont) AS cont FROM raw GROUP BY tbl, row_ix, col_ix)"


def _cells(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    base = lambda col_ix, span, width, flag: t("lineitem").select(F.col("l_orderkey").alias("tbl"), F.col("l_linenumber").cast("long").alias("row_ix"), F.lit(col_ix).cast("long").alias("col_ix"), span.alias("span"), width.alias("width"), (F.col("l_returnflag") == flag).alias("continues"))
    both = base(0, q % 3 + 1, q * 10, "N").union(base(1, q % 2 + 1, F.when(F.col("l_discount") > 0.02, q * 7), "R"))
    return both.groupBy("tbl", "row_ix", "col_ix").agg(F.max("span").alias("span"), F.max("width").alias("width"), F.bool_or("continues").alias("continues"))


@query(f"WITH {_CELLS}, w AS (SELECT tbl, row_ix, sum(span) AS w FROM cells GROUP BY tbl, row_ix) SELECT tbl, CAST(max(w) AS BIGINT) AS columns, min(w) = max(w) AS consistent, count(*) AS rows FROM w GROUP BY tbl")
def grid_check(t: Tables) -> DataFrame:
    return S.grid_check(_cells(t), ["tbl"])


@query(f"WITH {_CELLS} SELECT tbl, col_ix, max(width) AS width, bool_and(width IS NOT NULL) AS complete FROM cells WHERE span = 1 GROUP BY tbl, col_ix")
def col_widths(t: Tables) -> DataFrame:
    return S.column_widths(_cells(t), ["tbl"])


@query(f"""WITH {_CELLS}, e AS (SELECT DISTINCT tbl, sum(width) OVER (PARTITION BY tbl, row_ix ORDER BY col_ix ROWS UNBOUNDED PRECEDING) AS edge FROM cells WHERE width IS NOT NULL),
p AS (SELECT tbl, edge, lag(edge) OVER (PARTITION BY tbl ORDER BY edge) AS q FROM e) SELECT tbl, CAST(edge AS BIGINT) AS edge FROM p WHERE q IS NULL OR edge - q > 15""")
def grid_reconcile(t: Tables) -> DataFrame:
    return S.column_edges(_cells(t).where("width is not null"), ["tbl"], tolerance=15)


@query(f"WITH {_CELLS} SELECT tbl, row_ix, col_ix, coalesce(last_value(CASE WHEN NOT cont THEN row_ix END IGNORE NULLS) OVER (PARTITION BY tbl, col_ix ORDER BY row_ix), row_ix) AS start_row FROM cells")
def vertical_merge(t: Tables) -> DataFrame:
    return S.vertical_merges(_cells(t), ["tbl"]).select("tbl", "row_ix", "col_ix", "start_row")


@query("""WITH x AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS r, count(*) OVER (PARTITION BY l_orderkey) AS n, l_linenumber FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN r = 0 THEN 'firstRow' WHEN r = n - 1 THEN 'lastRow' WHEN (r - 1) % 2 = 0 THEN 'band1Horz' ELSE 'band2Horz' END AS cond FROM x""")
def table_bands(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w.orderBy("l_linenumber")) - 1).alias("r"), F.count("*").over(w).alias("n"))
    return rows.select("l_orderkey", "l_linenumber", S.band_condition(F.col("r"), F.col("n"), F.lit(1), F.lit(3)).alias("cond"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def prune_orphans(t: Tables) -> DataFrame:
    """From suppliers over all their orders to the parts of large lines; the SQL states the end of those chains."""
    one, items = F.lit(0).alias("doc_id"), t("lineitem")

    def name(kind, key):
        return F.concat_ws(" ", F.lit(kind), key)  # a null key is a node as well

    nodes = t("part").select(one, F.concat(F.lit("part "), "p_partkey").alias("id"), "p_partkey")
    roots = items.select(one, name("supplier", "l_suppkey").alias("id"))
    orders = items.select(one, name("supplier", "l_suppkey").alias("source"), name("order", "l_orderkey").alias("target"))
    lines = items.where("l_quantity > 48").select(one, name("order", "l_orderkey").alias("source"), F.concat(F.lit("part "), "l_partkey").alias("target"))
    return S.unreachable(nodes, orders.unionByName(lines), roots).select("p_partkey")


@query("SELECT o_orderkey, CAST(coalesce(m, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS new_id FROM orders LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey) AS m FROM orders GROUP BY 1) ON k = o_custkey")
def id_alloc(t: Tables) -> DataFrame:
    top = t("orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("top"))
    return S.allocate_ids(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey", top).select("o_orderkey", "new_id")


@query(f"WITH {MARKERS} SELECT event_id, marker AS label, concat(marker, ' ', row_number() OVER (PARTITION BY flow_id, marker ORDER BY pos)) AS caption FROM m")
def seq_captions(t: Tables) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("flow_id", "marker").orderBy("pos"))
    return event_markers(t("events")).select("event_id", F.col("marker").alias("label"), F.concat_ws(" ", "marker", nth).alias("caption"))




@query(rf"""WITH i AS (SELECT event_id, concat('TOC \o "1-', CAST(1 + event_id % 9 AS VARCHAR), '" \h \t "', event_type, ',', CAST(user_id AS VARCHAR), '" ', event_type) AS raw FROM events),
x AS (SELECT event_id, regexp_extract_all(raw, '("(?:[^"\\]|\\.)*"|\\[^\s]|[^\s"\\]+)') AS k FROM i)
SELECT event_id, CAST(unnest(generate_series(0, len(k) - 1)) AS BIGINT) AS token_ix, unnest(k) AS token FROM x""")
def tokenise_instr(t: Tables) -> DataFrame:
    raw = F.concat(F.lit('TOC \\o "1-'), (1 + F.col("event_id") % 9).cast("string"), F.lit('" \\h \\t "'), "event_type", F.lit(","), F.col("user_id").cast("string"), F.lit('" '), "event_type")
    return t("events").select("event_id", F.posexplode(I.instruction_tokens(raw)).alias("token_ix", "token")).withColumn("token_ix", F.col("token_ix").cast("long"))


@query("SELECT event_id, upper(event_type) AS keyword, CASE event_type WHEN 'view' THEN 'Block' WHEN 'click' THEN 'Link' WHEN 'purchase' THEN 'Form' WHEN 'signup' THEN 'Atom' ELSE 'Unknown' END AS policy, 1 + event_id % 9 AS last_level FROM events")
def policy_lookup(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in {"view": "TOC", "click": "HYPERLINK", "purchase": "FORMTEXT", "signup": "PAGE"}.items() for x in kv])
    raw = F.concat(F.lit('TOC \\o "1-'), (1 + F.col("event_id") % 9).cast("string"), F.lit('"'))
    return t("events").select("event_id", F.upper("event_type").alias("keyword"), I.policy(F.coalesce(names[F.col("event_type")], F.upper("event_type"))).alias("policy"), I.toc_options(raw)["last"].cast("long").alias("last_level"))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_expiry(t: Tables) -> DataFrame:
    rows = S.session_expiry(t("events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts")
    return rows.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


@query("SELECT conv_id AS doc_id, count(*) FILTER (WHERE role = 'assistant') AS by_author, count(DISTINCT role) AS authors, max(CAST(turn AS BIGINT)) AS top FROM conversations GROUP BY conv_id")
def revisions_by_author(t: Tables) -> DataFrame:
    return turn_blocks(t("conversations")).groupBy("doc_id").agg(F.count_if(F.col("author") == "assistant").alias("by_author"), F.count_distinct("author").alias("authors"), F.max("block_ix").alias("top"))


@query("SELECT DISTINCT role AS author FROM conversations")
def authors(t: Tables) -> DataFrame:
    return turn_blocks(t("conversations")).select("author").distinct()


def _view(t: Tables, accept: bool) -> DataFrame:
    turns = turn_blocks(t("conversations")).withColumn("rev", F.when(F.col("author") == "assistant", "ins").when(F.col("author") == "system", "del"))
    return S.fingerprint(S.accepted(turns, accept=accept), ["doc_id"], ["block_ix"])


@query("SELECT conv_id AS doc_id, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS fingerprint FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def accept_view(t: Tables) -> DataFrame:
    return _view(t, True)


@query("SELECT conv_id AS doc_id, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS fingerprint FROM conversations WHERE role <> 'assistant' GROUP BY conv_id")
def reject_view(t: Tables) -> DataFrame:
    return _view(t, False)


@query("SELECT a.doc_id, a.lang FROM documents a JOIN labels l ON a.doc_id = l.doc_id WHERE l.quality = 1")
def label_join(t: Tables) -> DataFrame:
    return t("documents").join(t("labels").where("quality = 1"), "doc_id").select("doc_id", "lang")


@query("SELECT r_name, n_name, count(c_custkey) AS leaves, GROUPING(n_name) AS total FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name))")
def declaration_rollup(t: Tables) -> DataFrame:
    tree = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return tree.groupingSets([["r_name", "n_name"], ["r_name"]], "r_name", "n_name").agg(F.count("c_custkey").alias("leaves"), F.grouping("n_name").cast("long").alias("total"))


@query("WITH a AS (SELECT event_type AS name, user_id, min(event_id) AS src FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2) SELECT f.user_id AS name, f.src AS from_id, t.src AS to_id FROM (SELECT * FROM a WHERE name = 'view') f FULL OUTER JOIN (SELECT * FROM a WHERE name = 'click') t ON f.user_id = t.user_id WHERE f.user_id IS NOT NULL")
def move_pairs(t: Tables) -> DataFrame:
    a = t("events").where("event_type in ('view', 'click')").groupBy("event_type", "user_id").agg(F.min("event_id").alias("src"))
    sources = a.where("event_type = 'view'").select(F.col("user_id").alias("name"), F.col("src").alias("from_id"))
    targets = a.where("event_type = 'click'").select(F.col("user_id").alias("name"), F.col("src").alias("to_id"))
    return sources.join(targets, "name", "full_outer").where("from_id is not null")
