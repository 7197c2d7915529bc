"""Text, hash and unit expressions. All are built-in expressions but `strip_accents`."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EntityPattern

# What counts as a number, a footnote mark, and a unit in a header.
NUMERIC = r"^-?\d+(\.\d+)?%?$"
FOOTNOTE = r"(\*+|†+|‡+|\([a-zA-Z]\))\s*$"
UNIT = r"\(([^)]+)\)|(%)"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_numeric(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(NUMERIC), F.lit(False))


def footnote(text: Column) -> Column:
    """The footnote mark at a text's end, or null."""
    mark = F.regexp_extract(text, FOOTNOTE, 1)
    return F.when(mark != "", mark)


def strip_footnote(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, FOOTNOTE, ""))


def to_decimal(text: Column) -> Column:
    """decimal(38,18), or null for what is no plain number."""
    return text.try_cast("decimal(38,18)")


def canonical_map(m: Column) -> Column:
    """A map as JSON with its keys in order; null as the empty map."""
    entries = F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))
    return F.to_json(F.map_from_entries(entries))


def short_hash(text: Column, length: int, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def parse_page_range(pages: str) -> tuple[int, int]:
    """"lo-hi" or a single page, inclusive."""
    lo, _, hi = pages.partition("-")
    return int(lo), int(hi or lo)


def in_pages(page: Column, pages: str | None) -> Column:
    return F.lit(True) if not pages else page.between(*parse_page_range(pages))


def unit_of(chain: Column, expect: Column, from_header: Column) -> tuple[Column, Column]:
    """A column's unit and where it comes from: the first header that names one in brackets or as %, else the expected one."""
    named = F.transform(chain, lambda h: F.nullif(F.coalesce(F.nullif(F.regexp_extract(h, UNIT, 1), F.lit("")), F.regexp_extract(h, UNIT, 2)), F.lit("")))
    header = F.when(from_header, F.get(F.filter(named, lambda u: u.isNotNull()), F.lit(0)))
    unit = F.coalesce(F.trim(header), expect)
    source = F.when(header.isNotNull(), "column_header").when(expect.isNotNull(), "rulebook_default")
    return unit, source


def stat_of(chain: Column, from_header: Column) -> Column:
    last = F.lower(F.trim(F.try_element_at(chain, F.lit(-1))))
    return F.when(from_header & last.isin("min", "max"), last).otherwise("point")


def resolve_entity(raw: Column, pattern: EntityPattern) -> Column:
    """The normalised id of the first entity in a text, or null. What a group becomes is told by the pattern: each {name}
    of its template is a group, upper-cased or not, under the first alias whose mark it holds."""
    found = "(?i)" + pattern.regex

    def group(name: str) -> Column:
        part = F.trim(F.coalesce(F.regexp_extract(raw, found, pattern.groups.index(name) + 1), F.lit("")))
        part = F.upper(part) if name in pattern.upper else part
        marks = [F.when(part.contains(mark), alias) for mark, alias in pattern.aliases.get(name, {}).items()]
        return F.coalesce(*marks, part)

    pieces = [group(p[1:-1]) if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", pattern.template) if p]
    return F.when(raw.rlike(found), F.trim(F.concat(*pieces)))


def tokens(text: Column) -> Column:
    """Lower-cased letter and digit runs."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def strip_accents(text: Column) -> Column:
    """Letters without their marks, by Arrow batches: there is no built-in for it."""

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))

    return plain(text)


def fill(template: str, values: dict[str, Column]) -> Column:
    """A message template with {name} places; unknown and null values become empty."""
    parts = [F.coalesce(values[p[1:-1]].cast("string"), F.lit("")) if p[1:-1] in values and p.startswith("{") else F.lit("" if p.startswith("{") else p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts) if parts else F.lit("")
