"""Text expressions.  ``(?U)`` makes Java's classes Unicode-aware where results must be those of Unicode rules."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters and patterns that the cleaning rules name.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
PHONE = r"(?U)(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)"
NATIONAL_ID = r"(?U)(?<!\d)([1-9]\d{5})\d{8}(\d{3}[\dXx])(?!\d)"
EMAIL = r"([a-zA-Z0-9_.+-]+)@([a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)"
#: What ends a line, besides the line feed, where text is cut into lines by Unicode rules.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: White space by Unicode's property, and the separators that strings' own strip takes.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends, by Unicode's classes."""
    return F.btrim(c, F.lit(SPACE))


def is_blank(c: Column) -> Column:
    """Whether nothing is left by ``strip``; reads no further than the first other character."""
    return ~c.rlike(rf"[^{SPACE}]")


def lines(c: Column) -> Column:
    """The lines of a text; a last line end opens no further line.  The text is named twice only, as expressions are worked out wherever they stand."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, rf"(?:{LINE_ENDS})\z", ""), LINE_ENDS))


def drop_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, for which Spark has no expression."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def tidy_space(c: Column, compose: bool = True) -> Column:
    """Composes, strips each line (any Unicode line end ends one), runs of blanks to one, of three or more line feeds to two, strips the whole."""
    c = nfkc(c) if compose else c
    each = F.transform(lines(c), lambda x: F.regexp_replace(strip(x), r"[ \t]+", " "))
    return strip(F.regexp_replace(F.array_join(each, "\n"), r"\n{3,}", "\n\n"))


def mask_phone(c: Column) -> Column:
    return F.regexp_replace(c, PHONE, "$1****$2")


def mask_national_id(c: Column) -> Column:
    return F.regexp_replace(c, NATIONAL_ID, "$1********$2")


def mask_email(c: Column) -> Column:
    """Keeps the first and last character of a name of three or more, else the first and one star; the domain stays.

    Addresses are taken one by one from the left: what stands between them is
    cut out by the same pattern, and the two are put together again.
    """

    def mask(e: Column) -> Column:
        n = F.instr(e, "@") - 1
        name = F.when(n <= 2, F.concat(F.substring(e, 1, 1), F.lit("*"))).otherwise(F.concat(F.substring(e, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(e, n, F.lit(1))))
        return F.concat(name, F.substring(e, n + 1, F.length(e)))

    def masked(c: Column) -> Column:
        between, found = F.split(c, EMAIL, -1), F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0))
        return F.when(c.contains("@"), F.array_join(F.zip_with(between, F.transform(found, mask), lambda x, e: F.concat(x, F.coalesce(e, F.lit("")))), "")).otherwise(c)

    # Named several times, the text would be worked out as often; as a lambda's argument it is once.
    return F.transform(F.array(c), masked)[0]


def mask_personal(c: Column) -> Column:
    """Phone, then national id, then e-mail."""
    return mask_email(mask_national_id(mask_phone(c)))


def has_word(c: Column) -> Column:
    """Whether a letter, number or underscore stands in the text."""
    return c.rlike(r"[\p{L}\p{N}_]")


def margin_form(c: Column) -> Column:
    """What repeated page margins have in common: lower case, no white space, every number ``#``."""
    bare = F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", "")
    return F.regexp_replace(bare, r"(?U)\d+", "#")


def dedup_form(c: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", "")


def mask_key(c: Column) -> Column:
    """A secret for logs: first four and last two characters of more than six."""
    return F.when(F.length(c) > 6, F.concat(F.substring(c, 1, 4), F.lit("***"), F.substring(c, -2, 2))).otherwise("***")


def preview(c: Column, n: int = 80) -> Column:
    """The first characters, on one line."""
    return F.regexp_replace(F.substring(c, 1, n), "\n", " ")


def settings(c: Column) -> Column:
    """The ``KEY=VALUE`` lines of a text as a map: comments go, quotes around a value too, and the first of equal keys counts."""
    held = F.filter(F.transform(lines(c), strip), lambda x: ~x.startswith("#") & x.contains("="))
    pairs = F.transform(held, lambda x: F.struct(strip(F.substring_index(x, "=", 1)).alias("k"), strip(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    bare = F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), F.regexp_replace(p["v"], "^(?s)([\"'])(.*)\\1$", "$2").alias("v")))
    first = F.filter(bare, lambda p, i: ~F.array_contains(F.transform(F.slice(bare, 1, i), lambda q: q["k"]), p["k"]))
    return F.map_from_entries(first)
