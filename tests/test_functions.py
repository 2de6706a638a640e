import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from leafpress.functions import fields as I
from leafpress.functions import text as T
from leafpress.functions import values as V


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column).first()[0]


@pytest.mark.parametrize("s", ["", "abc", "aé￼", "x😀y", "👩‍👩‍👧", "ẞ́"])
def test_utf16(spark, s):
    assert one(spark, T.utf16_length("s"), s=s) == len(s.encode("utf-16-le")) // 2
    assert one(spark, T.utf16_slice("s", F.lit(0), T.utf16_length("s")), s=s) == s
    assert one(spark, T.utf16_length(F.lit(None).cast("string"))) is None


def test_surrogates(spark):
    assert [one(spark, T.splits_pair("s", F.lit(i)), s="x😀y") for i in range(4)] == [False, False, True, False]


def test_folds(spark):
    assert one(spark, T.collapse_space("s"), s=" a 　\t b ") == " a b "
    assert one(spark, T.fold_width("s"), s="ＡＢＣ　１！") == "ABC 1!"
    assert [one(spark, T.first_sentence("s"), s=s) for s in ("Hi there. You", "多い。次", "none", "", "a\nb")] == ["Hi there.", "多い。", "none", "", "a"]
    assert one(spark, T.escape_markers("s"), s="a[b]|#\\") == "a\\[b\\]\\|\\#\\\\"
    assert one(spark, T.trim_xml_space("s"), s=" \t x\r\n") == " x"


def test_codecs(spark):
    assert [one(spark, V.on_off("s"), s=s) for s in ("1", "TRUE", "on", "0", "False", "off", "x")] == [True, True, True, False, False, False, None]
    assert one(spark, V.on_off(F.lit(None).cast("string"), F.lit(True))) is True
    assert tuple(one(spark, V.hex_colour("s"), s="ff00aa")) == (False, "FF00AA", None)
    assert tuple(one(spark, V.hex_colour("s"), s="auto")) == (True, None, None)
    assert tuple(one(spark, V.hex_colour("s"), s="red")) == (False, None, "red")
    assert one(spark, T.first_int("s"), s=" -12px") == -12
    assert one(spark, T.first_int("s"), s="px") is None


def test_units(spark):
    assert [one(spark, V.parse_length("s"), s=s) for s in ("1in", "2.54cm", "72pt", "96px", "96", "x")] == [914400, 914400, 914400, 914400, 914400, None]
    assert [one(spark, V.parse_measure("s", 20), s=s) for s in ("1in", "12pt", "240", "q")] == [1440, 240, 240, None]
    assert one(spark, V.serial_date(F.lit(45000.7))) == datetime.date(2023, 3, 15)


def test_numbers(spark):
    rows = spark.range(0, 4001).select("id", V.roman("id").alias("r"), V.letters("id").alias("a")).collect()

    def roman(n):
        out = ""
        for v, s in V.ROMAN:
            out, n = out + s * (n // v), n % v
        return out

    assert all(r.r == (roman(r.id) if 1 <= r.id <= 3999 else None) for r in rows)
    assert [rows[i].a for i in (0, 1, 26, 27, 53)] == [None, "a", "z", "aa", "aaa"]
    assert one(spark, V.format_number(F.lit("ordinalText"), F.lit(3))) is None


def test_colour(spark):
    assert one(spark, V.tint_shade(F.lit("4F81BD"), shade=F.lit(128))) == "28415F"
    assert one(spark, V.mean_colour(F.array(F.lit("000000"), F.lit("FFFFFF")))) == "808080"


def test_fields(spark):
    raw = r'TOC \o "1-3" \h "a \"b" word'
    assert one(spark, I.instruction_tokens("s"), s=raw) == ["TOC", "\\o", '"1-3"', "\\h", '"a \\"b"', "word"]
    assert one(spark, I.switch("s", "o"), s=raw) == "1-3"
    assert one(spark, I.switch("s", "z"), s=raw) is None
    assert [one(spark, I.policy("s"), s=s) for s in ("TOC", "XE", "PAGE", "NOPE")] == ["Block", "Marker", "Atom", "Unknown"]
    assert len(I.KEYWORD_POLICY) == sum(len(w.split()) for w in I.POLICIES.values())


def test_signatures(spark):
    assert one(spark, V.signature_mime("b"), b=bytearray(b"\xff\xd8\xff\xe0rest")) == "image/jpeg"
    assert one(spark, V.signature_mime("b"), b=bytearray(b"plain")) is None


def test_data_urls_hold_whole_texts(spark, tmp_path):
    import base64

    from leafpress import catalogue

    texts = ["", "short", "é😀" * 50, "a long line of words\n" * 5000, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.url for r in catalogue.QUERIES["data_urls"](spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else "data:text/plain;base64," + base64.b64encode(t.encode()).decode() for i, t in enumerate(texts)}


def test_camel_names_come_from_the_table(spark, sf):
    from leafpress import catalogue

    rows = catalogue.QUERIES["camel_names"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/part.parquet").count()
    for r in rows:
        first, *rest = r.snake.split("_")
        assert r.camel == first + "".join(w[:1].upper() + w[1:] for w in rest)


def test_number_formats_have_every_part(spark, sf):
    from leafpress import catalogue

    rows = catalogue.QUERIES["number_formats"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/part.parquet").count()
    assert {"xl", "l"} <= {r.raw_roman for r in rows}


@pytest.mark.parametrize("s", ["x😀y", "😀😀", "👩‍👩‍👧", "aé￼"])
def test_utf16_slices_cut_pairs(spark, s):
    raw, n = s.encode("utf-16-be"), len(s.encode("utf-16-be")) // 2
    spans = [(a, b) for a in range(n + 2) for b in range(a, n + 3)]
    got = spark.createDataFrame([(s, *x) for x in spans], "s string, a int, b int").select(T.utf16_slice("s", F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [raw[2 * a : 2 * b].decode("utf-16-be", "replace") for a, b in spans]


def test_utf16_substring_has_every_document(spark, tmp_path):
    from leafpress import catalogue

    texts = ["0123456789abcdefghijklmnopqrstuvwxyz", "😀" * 20, "x" + "😀" * 20, "short", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.piece for r in catalogue.QUERIES["utf16_substring"](spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else t.encode("utf-16-be")[20:60].decode("utf-16-be", "replace") for i, t in enumerate(texts)}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.execute("select doc_id, piece from (" + catalogue.ORACLES["utf16_substring"] + ")").fetchall()) == got
