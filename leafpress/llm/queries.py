"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafpress.llm.bpe import bpe_digests
from leafpress.llm.common import read
from leafpress.llm.decontaminate import contamination
from leafpress.llm.html_extract import extract_pages
from leafpress.llm.jaccard_join import ngram_jaccard_components
from leafpress.llm.license_scan import license_scan
from leafpress.llm.quality import fit_quality, score_quality
from leafpress.llm.sharding import byte_shards
from leafpress.llm.simhash import simhash_edited
from leafpress.llm.token_counts import token_count_rollup
from leafpress.llm.token_files import token_file_digests


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """The file of a public tokenizer: in the folder leafpress.tokenizers names, else where its package has it."""
    folder = spark.conf.get("leafpress.tokenizers", None)
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(read(spark, sf_dir, "documents"))


def op2_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_edited(read(spark, sf_dir, "documents"))


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).drop("spans")


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents"), tokenizer_path(spark, "byte_bpe_50k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(spark, read(spark, sf_dir, "documents"), tokenizer_path(spark, "word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count_rollup(spark, read(spark, sf_dir, "documents"), tokenizer_path(spark, "byte_bpe_50k.json"), "byte_bpe_50k")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_ALL = (
    op1_ngram_jaccard_join, op2_simhash_fingerprints, op3_byte_shards, op4_html_extraction, op5_license_scan,
    op6_bpe_roundtrip, op7_token_files, op8_token_counts, op9_quality_classifier, op10_benchmark_decontamination,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: SQL for the same rows, where SQL can say it. The rest needs hashes, tokenizers, edit distances or a model, and is
#: held against brute force in the tests.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS t FROM s),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM x JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * i >= 75 * (len(p.s) + len(q.s) - i)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, d.b FROM r JOIN d ON r.other = d.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m ON s.doc_id = m.doc_id
""",
}
