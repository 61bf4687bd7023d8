"""Hashing, bounded slices and capability classification of files and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths

MAX_LINES, MAX_BYTES, SNIFFED = 1000, 1 << 20, 8192


def hashed(df: DataFrame, content: str, *keys: str) -> DataFrame:
    """Keys, ``sha256`` and ``size`` in bytes of a binary or string column."""
    data = F.coalesce(F.col(content), F.lit("").cast(df.schema[content].dataType)).cast("binary")
    return df.select(*keys, F.sha2(data, 256).alias("sha256"), F.octet_length(data).cast("long").alias("size"))


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8192."""
    return F.contains(F.substring(content.cast("binary"), 1, SNIFFED), F.lit(b"\0"))


def line_count(text: Column) -> Column:
    """Lines, a last one without terminator included."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (ends + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def line_slice(text: Column, start: int, end: int, max_bytes: int = MAX_BYTES) -> Column:
    """Lines [start, end) with their terminators, cut to ``max_bytes`` bytes.

    Fields: content, returned_start, returned_end, truncated, has_more.
    """
    if not 0 <= start <= end or end - start > MAX_LINES:
        raise ValueError(f"line ranges are ascending and capped at {MAX_LINES} lines")
    if not 0 < max_bytes <= MAX_BYTES:
        raise ValueError(f"slices are capped at {MAX_BYTES} bytes")
    n = line_count(text)
    last = F.least(n, F.lit(end))
    # At most `end` lines are split off; what follows them stays one string.
    parts = F.split(text, "\n", end + 1)
    body = F.array_join(F.slice(parts, start + 1, F.greatest(F.lit(0), F.least(F.lit(end), F.size(parts)) - start)), "\n")
    closed = (last < n) | F.endswith(text, F.lit("\n"))
    full = F.when(last <= start, F.lit("")).otherwise(F.concat(F.when(last < n, body).otherwise(F.regexp_replace(body, r"\n\z", "")), F.when(closed, F.lit("\n")).otherwise(F.lit(""))))
    truncated = F.octet_length(full) > max_bytes
    cut = F.when(truncated, F.make_valid_utf8(F.substring(full.cast("binary"), 1, max_bytes).cast("string"))).otherwise(full)
    return F.struct(cut.alias("content"), F.lit(start).cast("long").alias("returned_start"), F.when(last <= start, F.lit(start)).otherwise(last).cast("long").alias("returned_end"), truncated.alias("truncated"), (truncated | (last < n)).alias("has_more"))


def capabilities(path: Column, binary: Column, parse_errors: Column) -> Column:
    """Kind, language, parse status and intrinsic methods; ``parse_errors`` is null where there is no parser."""
    ext, lang = paths.extension(path), paths.language(path)
    document = ext.isin(*paths.DOCUMENTS)
    known = F.coalesce(~binary & lang.isNotNull() & parse_errors.isNotNull(), F.lit(False))
    status = F.when(~known, F.lit("unsupported")).when(parse_errors == 0, F.lit("parseable")).otherwise(F.lit("invalid"))
    tree = known & (parse_errors == 0)
    tree_patch = tree & (lang != "markdown") & (~document | ext.isin(".json", ".jsonc"))
    pick = lambda *options: F.array_compact(F.array(*(F.when(c, F.lit(v)) for c, v in options)))
    kind = F.when(binary, F.lit("binary")).when(document, F.lit("document")).when(lang.isNotNull(), F.lit("source")).otherwise(F.lit("text"))
    return F.struct(kind.alias("kind"), lang.alias("language"), status.alias("parse_status"), pick((tree, "ast"), (~binary, "text")).alias("read"), pick((tree_patch, "ast"), (~binary, "block")).alias("patch"), pick((tree, "ast")).alias("search"))


def ordered_intersection(left: Column, right: Column) -> Column:
    """Elements of ``left`` that ``right`` has, in the order of ``left``, repeats kept."""
    return F.filter(left, lambda x: F.array_contains(right, x))


def read_mode(requested: Column, effective: Column) -> Column:
    """Mode and error code: ``auto`` takes the tree where it can."""
    mode = F.when(requested == "auto", F.when(F.array_contains(effective, "ast"), F.lit("ast")).otherwise(F.lit("text"))).otherwise(requested)
    return F.struct(mode.alias("mode"), F.when(~F.array_contains(effective, mode), F.lit("read_mode_unavailable")).alias("error"))
