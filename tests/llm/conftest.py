import pytest

from leafpress.llm import queries

NASTY = [
    None, "", " ", "\n", "one", "two words", "a b c d", "a b c d e", "A B C D E", "a b c d e f", "a  b\tc\nd\re", "é ü ß 漢字 😀 x", "same text here for all of us", "same text here for all of us",
    "word " * 3000, "x" * 20000, " " * 500, "<|endoftext|> and <|endoftext|>", "it's we're I'll 'tis", "tab\tand nbsp  two  blanks \n\n\n end ", "́combining ́ marks", "1234567890 12 3", "ends with blank ",
    "MIT License", "mit-license", "Released under the MTI Licence.", "gnu general public license gnu general public license", "\x00control\x1f chars", "Ⅷ ǅ İ ſ K",
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Rows with nulls, empties, repeats, ties, long texts and clashing extra columns."""
    rows = [(i, t, "en", "s", i) for i, t in enumerate(NASTY)] + [(3, "tie of an id", None, None, None), (None, "no id", "en", "s", 1), (None, None, None, None, None), (7, NASTY[7], "en", "s", 7)]
    rows = [(*r, "clash", 1, b"x", "y") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string, n int, sig binary, bucket string")


@pytest.fixture(scope="session")
def nothing(nasty):
    return nasty.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def bpe(spark):
    return queries.tokenizer_path(spark, "byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_bpe(spark):
    return queries.tokenizer_path(spark, "word_bpe_49k.json")
