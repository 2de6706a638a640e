"""Operators on single texts against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafpress.llm import bpe as B
from leafpress.llm import common as C
from leafpress.llm import decontaminate as D
from leafpress.llm import html_extract as H
from leafpress.llm import license_scan as L
from leafpress.llm import quality as Q
from leafpress.llm import sharding, token_counts, token_files
from leafpress.llm.common import CHUNK_BYTES

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_words(nasty):
    texts = [t for _, t in rows_of(nasty)]
    for table, pattern in ((C.SPACE_WORDS, r"[^\x20\x09-\x0D]+"), (C.ALNUM_WORDS, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for limit in (1, 50, 1 << 20):
            got, hashes = [], {}
            for lo, _, buf, offs in C.texts(pa.array([*texts, None]), limit):
                for d, h, a, b in zip(*C.words(buf, offs, table)):
                    w = bytes(C.LOWER[buf[a:b]]).decode()
                    got.append((lo + d, w))
                    assert hashes.setdefault(w, h) == h
            assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, t.translate(LOWER))]
            assert len(set(hashes.values())) == len(hashes)


def test_shards(documents, nasty, nothing):
    for df in (documents, nasty):
        out = sorted(sharding.byte_shards(df).collect(), key=lambda r: (r.shard, r.slot))
        rows = rows_of(df)
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == collections.Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows)
        ids = [-(2**63) if r.doc_id is None else r.doc_id for r in out]
        assert ids == sorted(ids) and {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
        total, before, at = sum(r.size for r in out), 0, collections.Counter()
        for r in out:
            assert r.shard == (2 * before + r.size) * 24 // (2 * total) and r.slot == at[r.shard]
            before += r.size
            at[r.shard] += 1
    assert sharding.byte_shards(nothing).count() == 0


def test_licenses(documents, nasty, nothing):
    for df in (documents, nasty):
        want = []
        for i, t in rows_of(df):
            w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
            places = [(j, label) for p, label in L.BASE.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
            want.append((i, len(w), len(places), min((j for j, _ in places), default=None), max((j for j, _ in places), default=None), ",".join(sorted({x for _, x in places}))))
        out = L.license_scan(df).collect()
        assert sorted([tuple(r)[:6] for r in out], key=key) == sorted(want, key=key)
        for r in out:
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert L.license_scan(nothing).count() == 0


def test_fuzzy_notices(spark):
    """Every notice with as many errors as are allowed is found, wherever the errors stand; with many more it isn't."""
    rng = random.Random(2)
    rows, n = [], 0
    for notice, label in L.NOTICES.items():
        for _ in range(12):
            s = list(notice)
            for _ in range(L.errors_allowed(notice)):
                i = rng.randrange(len(s))
                s[i : i + 1] = rng.choice([[], ["~"], [s[i], "~"]])
            pre = "é" * rng.randint(0, 9) + " "
            rows.append((n, pre + "".join(s).upper() + " end", label, len(pre)))
            n += 1
        rows.append((n, "".join("~" if i % 3 == 0 else c for i, c in enumerate(notice)), None, 0))
        n += 1
    out = {r.doc_id: r for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string, label string, at int")).collect()}
    for i, text, label, at in rows:
        if label is None:
            assert not out[i].spans
        else:
            assert label in out[i].labels.split(","), text
            assert any(s.label == label and abs(s.start - at) <= 6 and text[s.start : s.end] for s in out[i].spans)


def test_bpe(spark, documents, nasty, nothing, bpe):
    tok = Tokenizer.from_file(bpe)
    for df, bits in ((documents, B.CHUNK_BITS), (nasty, B.CHUNK_BITS), (nasty, 3)):
        want = []
        for i, t in rows_of(df):
            ids = tok.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted(map(tuple, B.bpe_digests(df, bpe, bits).collect()), key=key) == sorted(want, key=key)
    for r in B.bpe_encode(nasty.where("text is not null"), bpe).join(nasty.select("doc_id", "text"), "doc_id").where("doc_id > 8").collect():
        assert r.ids == tok.encode(r.text, add_special_tokens=False).ids and r.decoded == r.text
    assert B.bpe_digests(nothing, bpe).count() == 0


def test_chunks_are_shared(bpe):
    """A passage that two texts hold is encoded once, whatever stands before it."""
    rng = random.Random(0)
    passage = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)).encode()
    own = B.Encoder(bpe)
    seen, plain = [], own.plain
    own.plain = lambda piece: seen.append(piece) or plain(piece)
    for text in (b"start here " + passage, b"another and longer beginning, " * 3 + passage):
        del seen[:]
        own.run(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert sum(map(len, seen)) < 0.1 * len(passage)


@pytest.mark.parametrize("bits", [1, 2, 3, 5])
def test_joins_are_repaired(bpe, bits):
    """Cuts anywhere: inside words, white space, numbers, contractions, characters and added tokens."""
    tok, own, rng = Tokenizer.from_file(bpe), B.Encoder(bpe), random.Random(bits)
    atoms = ["a", "the", " ", "  ", "\n", "\r\n", "\t", "'", "'s", "'re", "n't", "1", "234", ".", ",", "...", "é", "漢字", "😀", "\u00a0", "\u3000", "<|endoftext|>", "<|endof", "text|>", "Hello", "ing", "\u0301", "\x00", "-"]
    for size in (3, 12, 40, 400):
        texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(size))) for _ in range(60)]
        raw = [t.encode() for t in texts]
        offs = np.cumsum([0, *map(len, raw)])
        ids, at = own.run(np.frombuffer(b"".join(raw), np.uint8), offs, bits)
        assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert [bytes(x).decode() for x in own.decimals(ids, at)] == [",".join(map(str, ids[x:y])) for x, y in zip(at[:-1], at[1:])]
        assert list(own.decode(ids, at)) == texts


def test_long_texts(bpe, word_bpe):
    """Texts beyond the bytes that are worked on at once, and white space that one library's patterns can't take."""
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta,", "Gamma's", "δέλτα", "5", "\n"]) for _ in range(400_000))
    assert len(long.encode()) > CHUNK_BYTES
    tok, own = Tokenizer.from_file(bpe), B.Encoder(bpe)
    for t in (long, " " * 1_200_000, "x" * 300_000):
        raw = np.frombuffer(t.encode(), np.uint8)
        assert own.run(raw, np.array([0, len(raw)]))[0].tolist() == tok.encode(t, add_special_tokens=False).ids
    tok, own = Tokenizer.from_file(word_bpe), token_files.WordEncoder(word_bpe)
    assert np.frombuffer(next(iter(own.encode([long.encode()]))), own.dtype).tolist() == tok.encode(long, add_special_tokens=False).ids


def test_both_libraries_agree(bpe, word_bpe):
    """Letters of all scripts (every 7th code point), and each word of the vocabulary by itself."""
    chars = [chr(c) for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c} {c}{c}1{c} A{c} {c}, ΑΣ" for c in chars]
    tok, own = Tokenizer.from_file(bpe), B.Encoder(bpe)
    assert own.fast is not None
    texts += [own.bytes[a : a + n].tobytes().decode(errors="ignore") for a, n in zip(own.start, own.size)]
    for t, e in zip(texts, tok.encode_batch_fast(texts, add_special_tokens=False)):
        assert "<|" in t or own.plain(t.encode()).tolist() == e.ids
    tok, own = Tokenizer.from_file(word_bpe), token_files.WordEncoder(word_bpe)
    assert own.fast is not None
    texts += [t.removesuffix("</w>") for t in tok.get_vocab()]
    for t, ids, e in zip(texts, own.encode([t.encode() for t in texts]), tok.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, own.dtype).tolist() == e.ids, t


def test_token_files(spark, documents, nasty, nothing, word_bpe, tmp_path):
    tok = Tokenizer.from_file(word_bpe)
    for n, df in enumerate((documents, nasty)):
        folder = f"file://{tmp_path}/{n}"
        parts = token_files.write_token_files(df, word_bpe, folder)
        out = token_files.read_token_files(parts, folder, with_ids=True).collect()
        start, want = 0, []
        for i, t in sorted(((-(2**63) if i is None else i), t.encode()) for i, t in rows_of(df)):
            ids = [*tok.encode(t.decode(), add_special_tokens=False).ids, 2]
            want.append((None if i == -(2**63) else i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
            start += len(ids)
        assert sorted(map(tuple, out), key=lambda r: r[1]) == want
        flat = np.concatenate([np.fromfile(p, "<u2") for p in sorted((tmp_path / str(n)).glob("*.bin"))])
        assert flat.tolist() == [x for w in want for x in w[4]]
        assert token_files.write_token_files(df, word_bpe, folder).agg(F.sum("ids")).first()[0] == start  # again over the same files
    assert token_files.token_file_digests(spark, nothing, word_bpe).count() == 0


def test_token_counts(spark, documents, nasty, nothing, bpe):
    tok = Tokenizer.from_file(bpe)
    for df in (documents, nasty):
        got = token_counts.count_tokens(df, bpe).select("doc_id", "n_tokens", "n_bytes").collect()
        assert sorted(map(tuple, got), key=key) == sorted([(i, len(tok.encode(t, add_special_tokens=False).ids), len(t.encode())) for i, t in rows_of(df)], key=key)
        want = collections.Counter()
        for r in df.select("source", "lang", "text").collect():
            want[r.source, r.lang] += len(tok.encode(r.text or "", add_special_tokens=False).ids)
        out = token_counts.token_count_rollup(spark, df, bpe, "v1").collect()
        assert {(r.source, r.lang): r.tokens for r in out} == dict(want) and {r.tokenizer for r in out} == {"v1"} and sum(r.docs for r in out) == df.count()
    assert token_counts.token_count_rollup(spark, nothing, bpe, "v1").count() == 0


def test_ledger(spark, tmp_path):
    ledger = token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger")
    rows = lambda *r: spark.createDataFrame(list(r), "source string, lang string, n_tokens long, n_bytes long")
    assert ledger.totals().count() == 0
    a = rows(("s", "en", 10, 40), ("s", "en", 5, 20), ("t", None, 7, 9))
    assert ledger.commit("b1", token_counts.inserts(a, "v1")) and not ledger.commit("b1", token_counts.inserts(a, "v1"))
    assert ledger.commit("b2", token_counts.deletes(rows(("t", None, 7, 9)), "v1"))
    assert ledger.commit("b3", token_counts.revisions(rows(("s", "en", 5, 20)), rows(("s", "en", 6, 20)), "v1"))
    spark.range(0).write.parquet(f"file://{tmp_path}/ledger/totals/000000000004-torn")  # of an attempt that never committed
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "v1", 2, 16, 60)]
    with pytest.raises(ValueError):
        ledger.commit("../x", a)


def test_writers_meet(spark, tmp_path):
    """A second writer commits between the first one's reading and its commit: both count, and a batch of both counts once."""
    one, two = (token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger") for _ in range(2))
    row = lambda n: token_counts.inserts(spark.createDataFrame([("s", "en", n, 1)], "source string, lang string, n_tokens long, n_bytes long"), "v1")
    assert one.commit("a", row(1))
    totals, met = one.totals, []

    def late():
        out = totals()
        if not met:
            met.append(two.commit("b", row(10)) and two.commit("c", row(100)))
        return out

    one.totals = late
    assert one.commit("d", row(1000)) and met == [True]
    assert not one.commit("b", row(5)) and two.batches() == ["a", "b", "c", "d"]
    assert [tuple(r) for r in two.totals().collect()] == [("s", "en", "v1", 4, 1111, 4)]


def test_quality(spark, sf, documents, nasty, nothing):
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    machine = Q.fit_quality(docs, labels)
    out = Q.score_quality(docs, machine).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(out.doc_id, out.held_out))
    assert (held.predicted == held.quality).mean() > 0.95
    scored = Q.score_quality(nasty, machine).collect()
    assert len(scored) == nasty.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
    kept = Q.keep_quality(nasty, machine)
    assert kept.columns == nasty.columns and kept.count() == sum(r.predicted for r in scored)
    assert Q.score_quality(nothing, machine).count() == 0
    blank = Q.fit_quality(docs, labels.limit(0))
    assert {r.score for r in Q.score_quality(nasty, blank).collect()} == {0.5}


def test_held_out_labels_are_not_used(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(Q.fit_quality(docs, labels).linear, Q.fit_quality(docs, flipped).linear)


def test_quality_is_learnt_from_whole_texts(spark):
    same = "a clean sentence of plain words about the weather. " * 1400
    tails = ["and so the day went on as calmly as it began. " * 1400, "$$$ CLICK!!! 999 @@@ ### WIN >>> " * 1400]
    rows = [(i, same + tails[i % 2], 1 - i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    scored = {r.doc_id: r.score for r in Q.score_quality(docs, Q.fit_quality(docs, labels)).collect()}
    assert all((scored[i] > 0.5) == bool(label) for i, _, label in rows)


def test_machine_equals_pairwise_sum():
    rng = np.random.default_rng(0)
    size = Q.WORDS + len(Q._STATS) * (Q.BINS + 1)
    m = Q.FactorisationMachine(np.sort(rng.normal(size=(len(Q._STATS), Q.BINS)), axis=1), 0.3, rng.normal(size=size) / 9, rng.normal(size=(size, Q.RANK)) / 9)
    (_, _, stats, own, place, weight), = Q.features(pa.array(["some words are here, here!", "", None]))
    at = m.places(m.edges, stats)
    for d in range(3):
        x = np.zeros(size)
        x[place[own == d]] = weight[own == d]
        x[at[d]] = 1 / np.sqrt(at.shape[1])
        nz = np.flatnonzero(x)
        z = m.bias + x @ m.linear + sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for a, i in enumerate(nz) for j in nz[:a])
        assert abs(m.score(stats, own, place, weight)[d] - 1 / (1 + np.exp(-z))) < 1e-9


def plain_tiles(text, item, least):
    """Greedy string tiling by looking at all pairs of places, again and again."""
    tf, pf, total = [True] * len(text), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for b in range(len(item)):
            for a in range(len(text)):
                k = 0
                while a + k < len(text) and b + k < len(item) and tf[a + k] and pf[b + k] and text[a + k] == item[b + k]:
                    k += 1
                best = max(best, (k, -b, -a))
        k, b, a = best[0], -best[1], -best[2]
        if k < least:
            return total
        total += k
        tf[a : a + k], pf[b : b + k] = [False] * k, [False] * k


def test_tiling_equals_plain_tiling():
    rng = random.Random(4)
    for _ in range(150):
        text, item = [rng.randrange(3) for _ in range(rng.randint(0, 30))], [rng.randrange(3) for _ in range(rng.randint(1, 20))]
        tiles = D.tiles(text, item, 3)
        assert sum(t[2] for t in tiles) == plain_tiles(text, item, 3)
        for a, b, k in tiles:
            assert text[a : a + k] == item[b : b + k]


def test_contamination(spark, documents, sf):
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(40))) for i in range(12)] + [(90, "tiny item"), (91, ""), (92, None)]
    rows = []
    for i, t in items[:12]:
        w = t.split()
        rows += [(len(rows), f"before it, {t.upper()}. after"), (len(rows) + 1, " ".join(w[20:] + ["zz"] + w[:20])), (len(rows) + 2, " ".join(w[:10])), (len(rows) + 3, " ".join(reversed(w)))]
    rows += [(100, "a Tiny, item here"), (101, None), (102, ""), (None, "tiny item")]
    out = D.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    assert got == {(4 * i + j, i) for i in range(12) for j in (0, 1)} | {(100, 90), (None, 90)}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    exact = set()
    texts = [(r.doc_id, f" {' '.join(re.findall('[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', r.text.translate(LOWER)))} ") for r in documents.collect()]
    for r in bench.collect():
        w = " ".join(re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.translate(LOWER)))
        exact |= {(i, r.item_id) for i, t in texts if f" {w} " in t}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in D.contamination(documents, bench).collect()}
    assert D.contamination(documents, bench.limit(0)).count() == 0


def test_contamination_in_blocks(spark, documents, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, D.contamination(documents, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 3000)
    assert sorted(map(tuple, D.contamination(documents, bench).collect())) == whole


PAGE = """<!doctype html><html><head><title>no</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="has-sidebar"><header>Site <nav><ul><li>Menu</li></ul></nav></header>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>Head&amp;line</h1><div class="share">Share</div></header><p>First <b>bold</b>
 text<br>line</p><p>Open <i>para &lt;tag&gt; &copy; &#233;<p>Next<div class="ad">Buy</div><ul><li>one<li>two</ul><form>Name <input></form><aside>Side</aside><!-- gone --><table><tr><td>cell</td></tr></table></article>
<section id="comments"><article class="comment">Nice!</article></section></main><div class="sidebar">S</div><footer>&copy; foot</footer></body></html>"""


def test_html():
    text = [t for t, k in H.page_lines(PAGE) if k == H.ARTICLE]
    assert text == ["Head&line", "First bold text line", "Open para <tag> © é", "Next", "one", "two", "cell"]
    for odd in ("", "<", "<p", "text only", "<!-- open", "<script>never closed", "a < b > c", "</p></div>", "<p>&am", "<a b='>'>x</a>"):
        H.page_lines(odd)
    assert H.page_lines("text only") == [("text only", H.OPEN)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><header class='entry-header'><h1>Title</h1></header><p class='alert'>An alert</p><p class='widget'>A widget</p></article>", ["Title", "An alert", "A widget"]),
        ("<article class='news-item related'><p>Body</p></article>", ["Body"]),
        ("<article>" + "\u0130" * 12 + "<script>x</SCRIPT ><p>after</p></article>", ["\u0130" * 12, "after"]),
        ("<article><p>a</p><div class='notice'></div><p class='ad'>b<p>c</article>", ["a", "b", "c"]),
        ("<article><ul><li hidden>gone<li>stays</ul><p hidden>gone<p>kept</article>", ["stays", "kept"]),
        ("<article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p></article>", ["If x=2 then"]),
        ("<article><p class=\"open>one</p><p>two</p></article>", ["one", "two"]),
        ("<article><p>text</p><div class='ad-box'>Buy</div><div class='share buttons'>Share</div><div id='comments'>Nice</div><div class='address'>1 Road</div></article>", ["text", "1 Road"]),
        ("<article><p>long</p>" + "<p>and more words of it</p>" * 60_000 + "</article>", ["long", *["and more words of it"] * 60_000]),
    ],
)
def test_article_text(page, want):
    assert [t for t, k in H.page_lines(page) if k == H.ARTICLE] == want


def test_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        got = H.shared_lines(a, b)
        assert len(got) == t[-1][-1] and got == sorted(set(got))
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in got))


def test_page_differencing(spark):
    page = lambda own: f"<body><div>Home</div><div>Sections</div><p>{own}</p><div>All about us</div></body>"
    rows = [(1, "http://a.x/news/1", page("story one")), (2, "http://a.x/news/2", page("story two")), (3, "http://a.x/zzz", "<article><p>Home</p></article><div>Home</div>"), (4, "http://alone/1", page("alone")), (5, None, None), (5, "http://[bad", ""), (None, "http://a.x/news/2", PAGE)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, lines string")
    out = {(r.page_id, r.url): r for r in H.extract_pages(df).collect()}
    assert len(out) == len(rows)
    assert out[1, "http://a.x/news/1"].text == "story one" and out[1, "http://a.x/news/1"].shared_lines == 3
    assert out[3, "http://a.x/zzz"].text == "Home"
    assert out[4, "http://alone/1"].text == "Home\n\nSections\n\nalone\n\nAll about us"
    assert out[5, None].text == "" and out[5, None].n_chars == 0
    assert H.extract_pages(df.limit(0)).count() == 0


def test_differencing_finds_templates(spark):
    """A site without any markup of its parts: only what the next page lacks is the text, on every page."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    menu, foot, promo = ([f"{kind} {i} {word()}" for i in range(6)] for kind in ("menu", "foot", "promo"))
    rows, want = [], {}
    for i in range(60):
        story = [" ".join(word() for _ in range(12)) for _ in range(rng.randint(1, 5))]
        lines = [*menu, story[0], promo[0], *story[1:], *promo[1 : rng.randint(1, 6)], *foot]
        rows.append((i, f"http://site.x/section{i % 3}/{i:03d}", "".join(f"<div>{x}</div>" for x in lines)))
        want[i] = "\n\n".join(story)
    rows += [rows[5], rows[5]]  # equal rows are one page
    out = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 62
    plain = {i: "\n\n".join(t for t, _ in H.page_lines(h)) for i, _, h in rows}
    assert sum(r.text != plain[r.page_id] for r in out) == 62 and all(r.shared_lines >= 12 for r in out)
    for r in out:
        left = r.text.split("\n\n")
        assert [x for x in left if x not in promo[1:]] == want[r.page_id].split("\n\n")  # promos stay where the neighbour has fewer
    assert sum(r.text == want[r.page_id] for r in out) > 31


def test_pages_of_the_tables(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in H.extract_pages(pages).collect():
        body = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
