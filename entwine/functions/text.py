"""Normalising and tokenising business text, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _latin() -> tuple[str, str]:
    """Accented letters of the Latin blocks whose compatibility form is one ASCII letter and marks, and that letter."""
    src, dst = [], []
    for code in range(0xC0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii():
            src.append(chr(code))
            dst.append(plain)
    return "".join(src), "".join(dst)


LATIN = _latin()


def fold(c: Column) -> Column:
    """Removes accents of Latin letters in the JVM."""
    return F.translate(F.regexp_replace(c, r"[̀-ͯ]", ""), *LATIN)


@F.pandas_udf(StringType())
def fold_full(s: pd.Series) -> pd.Series:
    """Compatibility decomposition of any script without combining marks; the general form of fold."""

    def one(x):
        return x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return s.map(one, na_action="ignore")


def normalize(c: Column, accents: bool = False) -> Column:
    """Lower case, only letters, digits and underscores, single spaces. accents keeps accented letters."""
    f = c if accents else fold(c)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(f), r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


# Words that stand for others.
SUFFIXES = {"limited": "ltd", "incorporated": "inc", "corporation": "corp", "company": "co", "private": "pvt"}
ABBREVIATIONS = {
    "street": "st", "road": "rd", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "lane": "ln", "apartment": "apt",
    "suite": "ste", "highway": "hwy", "nagar": "ngr", "marg": "mrg", "allee": "all", "rue": "r", "place": "pl",
}
# Words that are no blocking keys.
NAME_STOP = (
    "ltd", "pvt", "inc", "llc", "corp", "co", "limited", "private", "corporation",
    "company", "services", "solutions", "technologies", "technology", "enterprises",
    "associates", "group", "partners", "international", "global", "trading", "brothers",
    "ventures", "industries", "consultancy", "consultants", "care", "and", "the", "of",
    "in", "for", "center", "centre", "hub", "studio", "sarl", "sas", "llp", "pllc",
)
ADDR_STOP = (
    "street", "road", "avenue", "boulevard", "drive", "lane", "apartment", "suite",
    "highway", "nagar", "marg", "allee", "rue", "place", "st", "rd", "ave", "blvd",
    "dr", "ln", "apt", "ste", "hwy", "ngr", "mrg", "all", "r", "pl", "floor", "unit",
    "block", "near", "opp", "opposite", "behind", "dist", "district", "city", "state",
    "india", "usa", "france", "north", "south", "east", "west",
)


def _replaced(c: Column, table: dict[str, str]) -> Column:
    for word, short in table.items():
        c = F.regexp_replace(c, rf"\b{word}\b", short)
    return c


def short_suffixes(normalized: Column) -> Column:
    return _replaced(normalized, SUFFIXES)


def short_address(normalized: Column) -> Column:
    return _replaced(normalized, ABBREVIATIONS)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def numeric_tokens(raw: Column) -> Column:
    """Distinct lower-cased tokens of the raw text that hold a digit, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(raw), r"\s+"), lambda t: t.rlike(r"\p{Nd}"))))


def non_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


# The byte-oriented variant.


def ascii_clean(c: Column) -> Column:
    """Only ASCII letters and digits, in lower case; everything else is one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\x00-\x7F]", " ")), "[^a-z0-9]+", " "))


def ascii_tokens(clean: Column, stop: tuple[str, ...] = NAME_STOP) -> Column:
    """Tokens of two letters or more that are no stop words; repeated ones stay."""
    return F.filter(F.split(clean, " "), lambda t: (F.char_length(t) >= 2) & ~t.isin(*stop))


def digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1))
