"""Scalar functions over paths, source text, HTML and JSON, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that could be credentials: hexadecimal ones, and six digits or more.
LONG_NUMBER = r"\b(?:[0-9]{6,}|0x[a-fA-F0-9]+)\b"


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def line_number(text: Column, found: str) -> Column:
    """The 1-based line of the first place of found; null if there is none."""
    at = F.instr(text, found)
    return F.when(at > 0, line_count(F.substr(text, F.lit(1), at)))


def masked(text: Column, sign: str = "#") -> Column:
    return F.regexp_replace(text, LONG_NUMBER, sign)


def column_number(reference: Column) -> Column:
    """A cell reference's column, base 26; null if it is none."""
    letters = F.regexp_extract(F.upper(reference), r"^[$]?([A-Z]+)[$]?[1-9][0-9]*$", 1)
    chars = F.filter(F.split(letters, ""), lambda c: c != "")
    value = F.aggregate(F.transform(chars, lambda c: F.ascii(c) - 64), F.lit(0), lambda acc, c: acc * 26 + c)
    return F.when(letters != "", value)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def ancestors(path: Column) -> Column:
    """All proper directory prefixes of a path, the root as the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def json_keys(text: Column) -> Column:
    return F.json_object_keys(text)


def html_tags(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def script_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
