"""The corpus pipeline, stage by stage, against plain versions of the stages."""

import hashlib
import re

from tokenizers import Tokenizer

import corpus_pipeline as P
from leafpress.llm import decontaminate as D
from leafpress.llm import quality as Q
from tests.llm.test_pairs import LOWER, classes


def test_stages(spark, sf, bpe):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "encoding"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    kept = P.quality(spark, docs, sf)
    machine = Q.fit_quality(docs, labels)
    good = {r.doc_id for r in Q.score_quality(docs, machine).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    single = P.near_duplicates(spark, kept, sf)
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {least for _, _, least in classes(rows)}

    clean = P.decontamination(spark, single, sf)
    words = lambda t: " ".join(re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER)))
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in clean.collect()}
    held = {r.doc_id for r in single.collect() if any(f" {i} " in f" {words(r.text)} " for i in items)}
    assert clean.columns == docs.columns and held and not held & set(left)
    assert single.count() - len(left) == len({r.doc_id for r in D.contamination(single, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()})

    tok = Tokenizer.from_file(bpe)
    for r in P.encoding(spark, clean, sf).collect():
        ids = tok.encode(left[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert {r.doc_id for r in P.run(spark, sf).collect()} == set(left)


def test_rows_not_ids(spark, sf, nasty, nothing, monkeypatch):
    """Ids that repeat or are null, and columns of clashing names: each row goes or stays by its own text."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    story = " ".join(f"word{i}" for i in range(40))
    rows = [(1, f"see {item}"), (1, "a clean text under the same id"), (None, " ".join([item, *(f"more{i}" for i in range(60))])), (None, "a clean text without an id"), (2, None), (2, ""), (5, story), (3, story), (3, story + " end"), (None, story), (3, "another text of id three")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, b"sig", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, sig binary, n int")
    for limit in (D.BLOCK_BYTES, 100):  # a benchmark that is sent out, and one that stays dealt
        monkeypatch.setattr(D, "BLOCK_BYTES", limit)
        clean = P.decontamination(spark, docs, sf)
        assert clean.columns == docs.columns
        assert sorted(map(str, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(map(str, (r for r in rows if item not in (r[1] or ""))))
    single = P.near_duplicates(spark, docs, sf)
    kept = [(r.doc_id, r.text) for r in single.collect()]
    assert single.columns == docs.columns and len(kept) == 8
    assert [r for r in kept if (r[1] or "").startswith(story)] in ([(3, story)], [(3, story + " end")])
    assert sorted(map(str, (r for r in kept if not (r[1] or "").startswith(story)))) == sorted(map(str, (r for r in rows if not (r[1] or "").startswith(story))))
    for stage in (P.near_duplicates, P.decontamination):
        assert stage(spark, nothing, sf).count() == 0 and stage(spark, nasty, sf).columns == nasty.columns
    assert P.quality(spark, nothing, sf).count() == 0 and P.encoding(spark, nasty, sf).count() == nasty.count()


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 10
