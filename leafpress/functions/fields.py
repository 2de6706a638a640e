"""Field instructions: keyword, switches, arguments, and the policy of a keyword."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafpress.functions.text import col

# The policy of each field keyword; a keyword that isn't here is Unknown.
POLICIES = {
    "Marker": "XE TA TC RD PRIVATE SET",
    "Link": "HYPERLINK",
    "Form": "FORMCHECKBOX FORMTEXT FORMDROPDOWN",
    "Picture": "INCLUDEPICTURE",
    "Object": "EMBED LINK",
    "Block": "TOC INDEX BIBLIOGRAPHY INCLUDETEXT DATABASE",
    "Atom": "PAGE NUMPAGES SECTION SECTIONPAGES PAGEREF REF NOTEREF STYLEREF SEQ DATE TIME CREATEDATE SAVEDATE PRINTDATE EDITTIME AUTHOR TITLE SUBJECT KEYWORDS COMMENTS FILENAME FILESIZE LASTSAVEDBY NUMCHARS NUMWORDS REVNUM TEMPLATE USERNAME USERADDRESS USERINITIALS DOCPROPERTY DOCVARIABLE CITATION QUOTE SYMBOL EQ ADVANCE AUTOTEXT AUTONUM AUTONUMLGL AUTONUMOUT AUTOTEXTLIST LISTNUM MACROBUTTON GOTOBUTTON BARCODE DISPLAYBARCODE MERGEBARCODE MERGEFIELD MERGEREC MERGESEQ ADDRESSBLOCK GREETINGLINE NEXT NEXTIF SKIPIF IF COMPARE ASK FILLIN PRINT",
}
KEYWORD_POLICY = {k: policy for policy, words in POLICIES.items() for k in words.split()}

TOKEN = r'("(?:[^"\\]|\\.)*"|\\[^\s]|[^\s"\\]+)'


def instruction_tokens(raw: Column | str) -> Column:
    """Quoted arguments, switches (\\x) and bare words of an instruction, in order; never fails."""
    return F.regexp_extract_all(col(raw), F.lit(TOKEN), 1)


def keyword(raw: Column | str) -> Column:
    return F.upper(F.regexp_extract(col(raw), r"^\s*([A-Za-z=]+)", 1))


def policy(word: Column | str) -> Column:
    """The policy of an upper-case keyword."""
    table = F.create_map(*[F.lit(x) for kv in KEYWORD_POLICY.items() for x in kv])
    return F.coalesce(table[col(word)], F.lit("Unknown"))


def switch(raw: Column | str, name: str) -> Column:
    """The argument after a switch without its quotes; empty if the next token is a switch; null without the switch."""
    import re

    found = F.regexp_extract(col(raw), rf'\\{re.escape(name)}\s*("((?:[^"\\]|\\.)*)"|([^\s"\\]+))?', 0)
    argument = F.regexp_replace(F.regexp_extract(col(raw), rf'\\{re.escape(name)}\s*("(?:[^"\\]|\\.)*"|[^\s"\\]+)?', 1), '^"|"$', "")
    return F.when(found != "", argument)


def toc_options(raw: Column | str) -> Column:
    """struct(first, last, outline, links, styles) of a table-of-contents instruction; the levels default to 1 to 9."""
    o = switch(raw, "o")
    first, last = F.regexp_extract(o, r"^([1-9])-([1-9])$", 1).try_cast("int"), F.regexp_extract(o, r"^([1-9])-([1-9])$", 2).try_cast("int")
    return F.struct(F.coalesce(first, F.lit(1)).alias("first"), F.coalesce(last, F.lit(9)).alias("last"), switch(raw, "u").isNotNull().alias("outline"), switch(raw, "h").isNotNull().alias("links"), switch(raw, "t").alias("styles"))
