"""String and encoding functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; a character outside the basic plane counts twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def normalize_whitespace_line(line: Column) -> Column:
    """Tabs of the indent are two spaces, inner runs one space, trailing white space goes."""
    indent = F.replace(F.regexp_extract(line, r"^([ \t]*)", 1), F.lit("\t"), F.lit("  "))
    rest = F.regexp_replace(F.rtrim(F.regexp_replace(line, r"^[ \t]*", "")), r"\s+", " ")
    return F.rtrim(F.concat(indent, rest))


def pointer_escape(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescape(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return (F.length(F.substring(text, 1, offset)) - F.length(F.replace(F.substring(text, 1, offset), F.lit("\n"), F.lit(""))) + 1).cast("long")


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based offset."""
    before = F.substring(text, 1, offset)
    return (F.length(F.substring_index(before, "\n", -1)) + 1).cast("long")


def occurrences(text: Column, needle: str | Column) -> Column:
    """Non-overlapping occurrences."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.when(F.length(n) > 0, ((F.length(text) - F.length(F.replace(text, n, F.lit("")))) / F.length(n)).cast("long")).otherwise(F.lit(0).cast("long"))


def short_id(text: Column, digits: int) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(digits))


def xml_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def unit_escape(text: Column) -> Column:
    """Escapes for a double-quoted value in a service unit file."""
    for char, entity in (("\\", "\\\\"), ('"', '\\"'), ("%", "%%")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def filename_safe(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replaces ``{name}`` placeholders."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def canonical_histogram(entries: Column) -> Column:
    """``key=count`` pairs of an array of structs (key, n), joined in order of keys."""
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat_ws("=", e.key, e.n.cast("string"))), ",")
