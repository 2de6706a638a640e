"""Text functions as Column expressions; offsets are UTF-16 code units throughout."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The White_Space code points, as a regular-expression class.
WHITE_SPACE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Full-width ASCII forms and their plain ones.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
OBJECT = "￼"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(c: Column | str) -> Column:
    """UTF-16 code units of a string; null stays null."""
    return F.shiftright(F.octet_length(F.encode(col(c), "UTF-16BE")).cast("long"), 1)


def utf16_slice(c: Column | str, start: Column, end: Column) -> Column:
    """Code units start (inclusive) to end (exclusive); a cut surrogate pair gives a replacement character."""
    raw = F.encode(col(c), "UTF-16BE")
    head, tail = ((splits_pair(c, at) & (start < end)).cast("int") for at in (start, end))
    whole = F.decode(F.substring(raw, 2 * (start.cast("int") + head) + 1, (2 * (end - start - head - tail)).cast("int")), "UTF-16BE")
    return F.concat(F.repeat(F.lit("\ufffd"), head), whole, F.repeat(F.lit("\ufffd"), tail))


def splits_pair(c: Column | str, at: Column) -> Column:
    """Whether an offset stands inside a surrogate pair: its code unit is a low surrogate."""
    unit = F.hex(F.substring(F.encode(col(c), "UTF-16BE"), 2 * at.cast("int") + 1, F.lit(1)))
    return F.coalesce((unit >= "DC") & (unit <= "DF"), F.lit(False))


def collapse_space(c: Column | str) -> Column:
    """Runs of White_Space become one blank; nothing is trimmed."""
    return F.regexp_replace(col(c), WHITE_SPACE + "+", " ")


def fold_width(c: Column | str) -> Column:
    """Full-width ASCII forms and the ideographic blank become their plain forms."""
    return F.translate(col(c), FULL_WIDTH, HALF_WIDTH)


def fold_case(c: Column | str) -> Column:
    return F.lower(col(c))


def first_sentence(c: Column | str) -> Column:
    """Up to and with the first full stop, exclamation or question mark (Western or CJK) or line feed, trimmed."""
    return F.trim(F.regexp_extract(col(c), "^[^.!?。！？\n]*[.!?。！？\n]?", 0), F.lit(" \t\r\n"))


def escape_markers(c: Column | str) -> Column:
    """A backslash before each of \\ [ ] | #."""
    return F.regexp_replace(col(c), r"([\\\[\]|#])", r"\\$1")


def trim_xml_space(c: Column | str, preserve: Column | bool = False) -> Column:
    """Blanks, tabs and line ends are trimmed unless xml:space says preserve."""
    keep = preserve if isinstance(preserve, Column) else F.lit(preserve)
    return F.when(keep, col(c)).otherwise(F.regexp_replace(col(c), r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def preview(c: Column | str, n: int = 80) -> Column:
    return F.substring(F.trim(collapse_space(c)), 1, n)


def glob_regex(pattern: str) -> str:
    """A glob in which * stands for any characters, as an anchored regular expression."""
    import re

    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def literal_regex(pattern: str) -> str:
    import re

    return re.escape(pattern)


def count_literal(c: Column | str, needle: str) -> Column:
    """Leftmost non-overlapping places of a literal; 0 for a null text."""
    gone = F.length(F.replace(col(c), F.lit(needle), F.lit("")))
    return F.coalesce(((F.length(col(c)) - gone) / len(needle)).cast("long"), F.lit(0).cast("long"))


def camel_case(c: Column | str) -> Column:
    """snake_case to camelCase."""
    parts = F.split(col(c), "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def index_free_path(c: Column | str) -> Column:
    """A JSON path without its array indices, the key under which differences are counted."""
    return F.regexp_replace(col(c), r"\[[0-9]+\]", "[]")


def hex_token(c: Column | str) -> Column:
    return F.lower(F.hex(F.encode(col(c), "UTF-8")))


def from_hex_token(c: Column | str) -> Column:
    return F.decode(F.unhex(col(c)), "UTF-8")


def escape_xml(c: Column | str, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if attribute else out


def unescape_xml(c: Column | str) -> Column:
    """The five named references; anything else stays as it is."""
    out = col(c)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def data_url(mime: Column | str, content: Column | str) -> Column:
    """Spark breaks base64 into lines of 76; a URL has none."""
    return F.concat(F.lit("data:"), col(mime), F.lit(";base64,"), F.translate(F.base64(col(content)), "\r\n", ""))


def first_int(c: Column | str) -> Column:
    """The leading integer of a text, null without one or out of range."""
    return F.regexp_extract(col(c), r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def fold_full(c: Column | str) -> Column:
    """The full width fold: U+3000 and U+FF00 to U+FFEF are decomposed by compatibility, then all is composed (NFC).

    Python's Unicode tables are needed, so this is an Arrow function; fold_width covers ASCII without one.
    """
    def one(s):
        if s is None or s.isascii():
            return s
        return unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFKD", x) if x == "　" or "＀" <= x <= "￯" else x for x in s))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one)

    return run(col(c))


def decode_symbol(font: Column | str, code: Column | str) -> Column:
    """The character of a symbol font's code (hexadecimal): Greek letters of Symbol, else the private-use character."""
    # Letters of the Symbol font by their ASCII place.
    greek = dict(zip("abgdezhqiklmnxoprstufcyw", "αβγδεζηθικλμνξοπρστυφχψω"))
    table = F.create_map(*[F.lit(x) for k, v in greek.items() for x in (ord(k), v)])
    n = F.conv(col(code), 16, 10).cast("int") % 256
    private = F.decode(F.unhex(F.lpad(F.hex(F.lit(0xF000) + n), 4, "0")), "UTF-16BE")
    return F.coalesce(F.when(col(font) == "Symbol", table[n]), private)
