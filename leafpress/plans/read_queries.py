"""Queries of the read surface over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafpress.functions import text as T
from leafpress.operators import reading as R
from leafpress.plans.registry import Tables, query
from leafpress.sources.adapters import active_html, page_pieces, text_blocks, turn_blocks

N16 = r"(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))"
BLOCKS = f"""l AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS p FROM documents),
b0 AS (SELECT doc_id, source AS part, lang AS section, CAST(unnest(generate_series(0, len(p) - 1)) AS BIGINT) AS block_ix, unnest(p) AS text FROM l),
b AS (SELECT *, {N16} AS n16 FROM b0)"""
FIRST = r"trim(regexp_extract(text, '^[^.!?。！？\n]*[.!?。！？\n]?', 0), concat(' ', chr(9), chr(10), chr(13)))"


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix, text FROM b")
def text_units(t: Tables) -> DataFrame:
    return text_blocks(t("documents")).select("doc_id", "block_ix", "text")


@query(f"SELECT doc_id, {N16} AS n16, n_chars FROM documents")
def utf16_lengths(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", T.utf16_length("text").alias("n16"), "n_chars")


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix, CAST(coalesce(sum(n16 + 1) OVER w, 0) AS BIGINT) AS start16, CAST(coalesce(sum(n16 + 1) OVER w, 0) + n16 AS BIGINT) AS end16 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY block_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def utf16_offsets(t: Tables) -> DataFrame:
    return R.offsets(text_blocks(t("documents"))).select("doc_id", "block_ix", "start16", "end16")


@query("""WITH d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
c AS (SELECT k, i, substr(text, i, 1) AS ch, CASE WHEN unicode(substr(text, i, 1)) > 65535 THEN 2 ELSE 1 END AS w FROM d, range(1, 31) r(i) WHERE i <= length(text)),
s AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY i) AS e FROM c),
p AS (SELECT k, string_agg(CASE WHEN e - w >= 10 AND e <= 30 THEN ch WHEN e > 10 AND e - w < 30 THEN chr(65533) END, '' ORDER BY i) AS piece FROM s GROUP BY k)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(piece, '') END AS piece FROM d LEFT JOIN p USING (k)""")
def utf16_substring(t: Tables) -> DataFrame:
    """Code units 10 to 30 of every document; a null text stays null."""
    return t("documents").select("doc_id", T.utf16_slice("text", F.lit(10), F.least(T.utf16_length("text"), F.lit(30))).alias("piece"))


@query(f"""WITH {BLOCKS}, s AS (SELECT *, block_ix // 32 AS group_ix, {FIRST} AS s FROM b)
SELECT doc_id, CAST(group_ix AS BIGINT) AS group_ix, coalesce(arg_min(s, block_ix) FILTER (WHERE s <> ''), '') AS title, count(*) AS block_count, CAST(sum(n16) AS BIGINT) AS char_count FROM s GROUP BY doc_id, group_ix""")
def outline_groups(t: Tables) -> DataFrame:
    return R.outline_groups(text_blocks(t("documents")))


_PIECES = r"""h AS (SELECT page_id, string_split(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '<') AS p FROM pages),
h0 AS (SELECT page_id, CAST(unnest(generate_series(0, len(p) - 1)) AS BIGINT) AS piece_ix, unnest(p) AS raw FROM h),
pieces AS (SELECT page_id, piece_ix, lower(regexp_extract(raw, '^(/?[a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, regexp_replace(raw, '(?s)^[^>]*>', '') AS text FROM h0 WHERE regexp_extract(raw, '^(/?[a-zA-Z][a-zA-Z0-9]*)', 1) <> '')"""


@query(f"""WITH {_PIECES}, t AS (SELECT page_id, max(piece_ix) + 1 AS n FROM pieces GROUP BY page_id),
hd AS (SELECT page_id, piece_ix, 1 AS level, text FROM pieces WHERE tag = 'h1')
SELECT hd.page_id, hd.piece_ix, CAST(level AS BIGINT) AS level, text AS title, CAST(coalesce(lead(hd.piece_ix) OVER (PARTITION BY hd.page_id ORDER BY hd.piece_ix), n) AS BIGINT) AS end_ix,
CAST((SELECT count(*) FROM pieces q WHERE q.page_id = hd.page_id AND q.tag = 'p' AND q.piece_ix > hd.piece_ix) AS BIGINT) AS paragraphs FROM hd JOIN t USING (page_id)""")
def outline_headings(t: Tables) -> DataFrame:
    pieces = page_pieces(t("pages"))
    w = Window.partitionBy("page_id").orderBy("piece_ix")
    rows = pieces.withColumn("n_blocks", (F.max("piece_ix").over(Window.partitionBy("page_id")) + 1))
    rows = rows.withColumn("paragraphs", F.count_if(F.col("tag") == "p").over(w.rowsBetween(1, Window.unboundedFollowing)))
    heads = rows.where("tag = 'h1'").select("page_id", "piece_ix", F.col("piece_ix").alias("block_ix"), F.lit(1).cast("long").alias("level"), F.col("text").alias("title"), "n_blocks", "paragraphs")
    return R.chapters(heads, doc="page_id").select("page_id", "piece_ix", "level", "title", "end_ix", "paragraphs")


#: Depth of lists and paragraphs stands in for heading levels, so that parents and ends have several levels.
_LEVELS = "CASE tag WHEN 'h1' THEN 1 WHEN 'p' THEN 2 WHEN 'li' THEN 3 WHEN 'a' THEN 4 WHEN 'b' THEN 3 END"


@query(f"""WITH {_PIECES}, x AS (SELECT page_id, piece_ix AS block_ix, CAST({_LEVELS} AS BIGINT) AS level FROM pieces), hd AS (SELECT * FROM x WHERE level IS NOT NULL), n AS (SELECT page_id, max(piece_ix) + 1 AS n FROM pieces GROUP BY page_id)
SELECT a.page_id, a.block_ix, a.level,
(SELECT max(b.block_ix) FROM hd b WHERE b.page_id = a.page_id AND b.block_ix < a.block_ix AND b.level < a.level) AS parent_ix,
CAST(coalesce((SELECT min(b.block_ix) FROM hd b WHERE b.page_id = a.page_id AND b.block_ix > a.block_ix AND b.level <= a.level), n.n) AS BIGINT) AS end_ix FROM hd a JOIN n USING (page_id)""")
def heading_parent(t: Tables) -> DataFrame:
    pieces = page_pieces(t("pages")).withColumn("n_blocks", F.max("piece_ix").over(Window.partitionBy("page_id")) + 1)
    heads = pieces.select("page_id", F.col("piece_ix").alias("block_ix"), F.expr(_LEVELS).cast("long").alias("level"), "n_blocks").where("level is not null")
    return R.chapters(heads, doc="page_id", levels=4).select("page_id", "block_ix", "level", "parent_ix", "end_ix")


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS hits FROM documents")
def find_literal(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", T.count_literal("text", "the").alias("hits"))


@query("""WITH h AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+ing') AS h FROM documents)
SELECT doc_id, CAST(unnest(generate_series(0, len(h) - 1)) AS BIGINT) AS hit_ix, unnest(h) AS match FROM h WHERE len(h) > 0""")
def find_regex_hits(t: Tables) -> DataFrame:
    return R.find_regex(t("documents"), R.validate_pattern("[A-Z][a-z]+ing"), ["doc_id"]).select("doc_id", "hit_ix", "match")


@query("""WITH h AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Z][a-z]+ing') AS h, string_split_regex(text, '[A-Z][a-z]+ing') AS g FROM documents),
x AS (SELECT doc_id, text, h, g, unnest(generate_series(1, len(h))) AS i FROM h WHERE len(h) > 0),
y AS (SELECT doc_id, text, CAST(i - 1 AS BIGINT) AS hit_ix, h[i] AS match, CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS start FROM x)
SELECT doc_id, hit_ix, match, start, substr(text, greatest(0, start - 40) + 1, start - greatest(0, start - 40)) AS before, substr(text, start + length(match) + 1, 40) AS after FROM y""")
def hit_context(t: Tables) -> DataFrame:
    return R.find_regex(t("documents"), "[A-Z][a-z]+ing", ["doc_id"])


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'und', ''))) / 3 AS BIGINT) AS hits FROM documents")
def find_casefold(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", T.count_literal(T.fold_case("text"), "und").alias("hits"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS n_collapsed, CAST(len(regexp_extract_all(regexp_replace(text, '[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), 'of the')) AS BIGINT) AS hits FROM documents")
def find_whitespace(t: Tables) -> DataFrame:
    flat = T.collapse_space("text")
    return t("documents").select("doc_id", F.length(flat).cast("long").alias("n_collapsed"), T.count_literal(flat, "of the").alias("hits"))


@query("SELECT doc_id, translate(translate(text, 'aeiou', 'ａｅｉｏｕ'), 'ａｅｉｏｕ', 'aeiou') = text AS folded_back, md5(text) AS digest FROM documents")
def find_width(t: Tables) -> DataFrame:
    wide = F.translate("text", "aeiou", "ａｅｉｏｕ")
    return t("documents").select("doc_id", (T.fold_width(wide) == F.col("text")).alias("folded_back"), F.md5(T.fold_width(wide)).alias("digest"))


@query(f"""WITH {BLOCKS} SELECT doc_id, block_ix, string_agg(text, chr(10) ORDER BY block_ix) OVER (PARTITION BY doc_id ORDER BY block_ix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM b""")
def context_blocks(t: Tables) -> DataFrame:
    return R.context_blocks(text_blocks(t("documents")), 2, 2).select("doc_id", "block_ix", "context")


_OFFSETS = "o AS (SELECT *, CAST(coalesce(sum(n16 + 1) OVER (PARTITION BY doc_id ORDER BY block_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start16 FROM b), u AS (SELECT *, start16 + n16 AS end16 FROM o)"


@query(f"""WITH {BLOCKS}, {_OFFSETS}, m AS (SELECT doc_id, max(block_ix) // 2 AS mid FROM u GROUP BY doc_id), c AS (SELECT u.doc_id, start16 - 200 AS lo, end16 + 200 AS hi, start16 AS s FROM u JOIN m ON u.doc_id = m.doc_id AND block_ix = mid)
SELECT u.doc_id, block_ix, start16, end16 FROM u JOIN c USING (doc_id) WHERE end16 > lo AND start16 < hi""")
def context_utf16(t: Tables) -> DataFrame:
    units = R.offsets(text_blocks(t("documents")))
    mid = F.floor(F.max("block_ix").over(Window.partitionBy("doc_id")) / 2)
    units = units.withColumn("mid", mid)
    return R.context_units(units, F.col("block_ix") == F.col("mid"), 200).select("doc_id", "block_ix", "start16", "end16")


_PAGE = """r AS (SELECT doc_id, block_ix, n16, octet_length(encode(text)) AS b, sum(n16) OVER w AS s16, sum(octet_length(encode(text))) OVER w AS sb FROM b WHERE block_ix >= {at} WINDOW w AS (PARTITION BY doc_id ORDER BY block_ix)),
f AS (SELECT *, s16 <= {limit} AND sb <= {bytes} AS fits FROM r)
SELECT doc_id, min(block_ix) FILTER (WHERE NOT fits) AS next_ix, count(*) FILTER (WHERE fits) AS units, CAST(coalesce(max(s16) FILTER (WHERE fits), arg_min(n16, block_ix)) AS BIGINT) AS used16,
CAST(coalesce(max(sb) FILTER (WHERE fits), arg_min(b, block_ix)) AS BIGINT) AS used_bytes, CASE WHEN count(*) FILTER (WHERE fits) = 0 THEN 'budget too small' END AS error FROM f GROUP BY doc_id"""


@query(f"WITH {BLOCKS}, {_PAGE.format(at=0, limit=400, bytes=4000)}")
def page_first(t: Tables) -> DataFrame:
    return R.budget_prefix(text_blocks(t("documents")), 400, 4000)


@query(f"WITH {BLOCKS}, {_PAGE.format(at=3, limit=800, bytes=8000)}")
def page_next(t: Tables) -> DataFrame:
    return R.budget_prefix(text_blocks(t("documents")), 800, 8000, from_ix=3)


@query(f"""SELECT conv_id AS doc_id, CAST(sum(CASE WHEN role = 'user' THEN {N16} ELSE 0 END) AS BIGINT) AS source16, CAST(sum(CASE WHEN role <> 'user' THEN {N16} ELSE 0 END) AS BIGINT) AS presentation16, CAST(sum(length(text)) AS BIGINT) AS scalars FROM conversations GROUP BY conv_id""")
def anchor_counts(t: Tables) -> DataFrame:
    blocks = turn_blocks(t("conversations"))
    return blocks.groupBy("doc_id").agg(
        F.sum(F.when(F.col("author") == "user", F.col("n16")).otherwise(0)).alias("source16"), F.sum(F.when(F.col("author") != "user", F.col("n16")).otherwise(0)).alias("presentation16"),
        F.sum(F.length("text")).alias("scalars"),
    )


@query(f"WITH {_PIECES} SELECT page_id, tag, count(*) AS n FROM pieces WHERE tag IN ('a', 'b', 'br', 'img', 'table', 'div', 'nav', 'footer') GROUP BY page_id, tag")
def omission_counts(t: Tables) -> DataFrame:
    shown = ("a", "b", "br", "img", "table", "div", "nav", "footer")
    return page_pieces(t("pages")).where(F.col("tag").isin(*shown)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(h, '<p>')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(h, '<a ')) AS BIGINT) AS links, CAST(len(regexp_extract_all(h, '<li>')) AS BIGINT) AS items
FROM (SELECT page_id, regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g') AS h FROM pages)""")
def element_counts(t: Tables) -> DataFrame:
    html = active_html(t("pages"))
    return html.select("page_id", *[F.regexp_count("html", F.lit(p)).cast("long").alias(n) for p, n in (("<p>", "paragraphs"), ("<a ", "links"), ("<li>", "items"))])


@query(f"""WITH {BLOCKS}, a AS (SELECT doc_id + 1 AS doc_id, block_ix, text FROM b)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.block_ix, b.block_ix) AS block_ix, a.text AS before, b.text AS after, CASE WHEN a.doc_id IS NULL THEN 'insert' WHEN b.doc_id IS NULL THEN 'delete' ELSE 'text' END AS kind
FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.block_ix = b.block_ix WHERE a.text IS DISTINCT FROM b.text""")
def diff_positional(t: Tables) -> DataFrame:
    blocks = text_blocks(t("documents"))
    return R.positional_diff(blocks.withColumn("doc_id", F.col("doc_id") + 1), blocks)


@query("""WITH a AS (SELECT conv_id + 1 AS conv_id, turn, text FROM conversations), c AS (SELECT conv_id, turn, text FROM conversations)
SELECT coalesce(a.conv_id, c.conv_id) AS conv_id, CAST(coalesce(a.turn, c.turn) AS BIGINT) AS turn, a.text AS before, c.text AS after, CASE WHEN a.conv_id IS NULL THEN 'insert' WHEN c.conv_id IS NULL THEN 'delete' ELSE 'text' END AS kind
FROM a FULL OUTER JOIN c ON a.conv_id = c.conv_id AND a.turn = c.turn WHERE a.text IS DISTINCT FROM c.text""")
def diff_keyed(t: Tables) -> DataFrame:
    turns = t("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    return R.keyed_diff(turns.withColumn("conv_id", F.col("conv_id") + 1), turns, ["conv_id", "turn"], "text")


@query("SELECT doc_id, sha256(text) AS sha, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def part_hash(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text), lang) AS media_id FROM documents")
def media_dedupe(t: Tables) -> DataFrame:
    hashed = t("documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    return hashed.join(hashed.groupBy("sha", "lang").agg(F.min("doc_id").alias("media_id")), ["sha", "lang"]).select("doc_id", "media_id")


@query("SELECT DISTINCT source FROM documents")
def media_list(t: Tables) -> DataFrame:
    return t("documents").select("source").distinct()


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix, left(trim(regexp_replace(text, '[\\x{{9}}-\\x{{D}}\\x{{20}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')), 80) AS preview, {FIRST} AS sentence FROM b")
def block_preview(t: Tables) -> DataFrame:
    return text_blocks(t("documents")).select("doc_id", "block_ix", T.preview("text").alias("preview"), T.first_sentence("text").alias("sentence"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '([\\\[\]|#])', '\\\1', 'g')) AS escaped FROM documents")
def marker_escape(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.md5(T.escape_markers("text")).alias("escaped"))


@query("SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped, replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') = text AS round_trip FROM documents")
def xml_escape(t: Tables) -> DataFrame:
    e = T.escape_xml("text")
    return t("documents").select("doc_id", F.md5(e).alias("escaped"), (T.unescape_xml(e) == F.col("text")).alias("round_trip"))


@query(f"""WITH {BLOCKS}, w AS (SELECT *, {FIRST} AS s FROM b), k AS (SELECT doc_id, block_ix, s FROM w WHERE block_ix % 32 = 0 AND s <> '')
SELECT doc_id, block_ix, concat(repeat('  ', 0), s, chr(9), CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_ix) AS VARCHAR)) AS entry FROM k""")
def toc_entries(t: Tables) -> DataFrame:
    heads = text_blocks(t("documents")).withColumn("s", T.first_sentence("text")).where("block_ix % 32 = 0 and s <> ''")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_ix"))
    return heads.select("doc_id", "block_ix", F.concat(F.col("s"), F.lit("\t"), nth.cast("string")).alias("entry"))


@query(r"""WITH w AS (SELECT source, unnest(regexp_extract_all(text, '[A-Z][a-z]{8,}')) AS term FROM documents), d AS (SELECT DISTINCT source, term FROM w)
SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY term COLLATE "binary") AS place FROM d""")
def index_terms(t: Tables) -> DataFrame:
    terms = t("documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{8,})"), 1)).alias("term")).distinct()
    return terms.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("term")).cast("long"))


@query(f"""WITH {BLOCKS} SELECT doc_id, section, count(*) AS blocks, count(*) FILTER (WHERE text = '') AS empty, CAST(sum(n16) AS BIGINT) AS n16, CAST(max(n16) AS BIGINT) AS longest FROM b GROUP BY doc_id, section""")
def document_summary(t: Tables) -> DataFrame:
    return text_blocks(t("documents")).groupBy("doc_id", "section").agg(F.count("*").alias("blocks"), F.count_if(F.col("text") == "").alias("empty"), F.sum("n16").cast("long").alias("n16"), F.max("n16").alias("longest"))


@query(f"WITH {BLOCKS} SELECT doc_id, block_ix, text FROM b WHERE block_ix >= 2 AND block_ix < 5")
def block_range(t: Tables) -> DataFrame:
    return text_blocks(t("documents")).where("block_ix >= 2 and block_ix < 5").select("doc_id", "block_ix", "text")


@query(f'WITH {BLOCKS}, m AS (SELECT doc_id, block_ix FROM b WHERE length(text) > 200), p AS (SELECT doc_id, block_ix * 10 + 3 AS pt FROM m), {_OFFSETS} SELECT u.doc_id, pt AS "at", block_ix, pt - start16 AS inner16 FROM u JOIN p USING (doc_id) WHERE start16 <= pt AND pt < end16')
def offset_anchor(t: Tables) -> DataFrame:
    blocks = text_blocks(t("documents"))
    points = blocks.where("length(text) > 200").select("doc_id", (F.col("block_ix") * 10 + 3).alias("at"))
    return R.locate(points, R.offsets(blocks), ["doc_id"]).select("doc_id", "at", "block_ix", "inner16")


@query(f"WITH {BLOCKS}, {_OFFSETS}, n AS (SELECT doc_id, end16, lead(start16) OVER (PARTITION BY doc_id ORDER BY start16, end16) AS next16 FROM u) SELECT doc_id, count(*) AS breaks FROM n WHERE next16 IS NOT NULL AND next16 <> end16 GROUP BY doc_id")
def anchor_breaks(t: Tables) -> DataFrame:
    return R.anchor_cover(R.offsets(text_blocks(t("documents")))).groupBy("doc_id").agg(F.count("*").alias("breaks"))


@query("SELECT conv_id, to_json(list(struct_pack(turn := CAST(turn AS BIGINT), \"role\" := role) ORDER BY turn)) AS model FROM conversations GROUP BY conv_id")
def model_json(t: Tables) -> DataFrame:
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role"))).alias("m"))
    return rows.select("conv_id", F.to_json("m").alias("model"))
