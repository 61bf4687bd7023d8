"""Structured documents: parsing by format, pointers, locations of values."""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.lazy import pandas_udf

MAX_RESULT, MAX_SOURCE = 256 << 10, 1 << 20


class _MISSING:  # noqa: N801
    """Marks a value that is not there; null is a value."""



class SelectorError(ValueError):
    """A pointer that is neither empty nor starts with a slash."""


def strip_jsonc(text: str) -> str:
    """JSON text without comments and trailing commas."""
    plain = re.sub(r"(\"(?:[^\"\\]|\\.)*\")|//[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(r"(\"(?:[^\"\\]|\\.)*\")|,(?=\s*[}\]])", lambda m: m[1] or "", plain, flags=re.S)


def parse(text: str, extension: str) -> object:
    """The value of a document; raises ``ValueError`` where it is none."""
    if extension == ".json":
        return json.loads(text)
    if extension == ".jsonc":
        return json.loads(strip_jsonc(text))
    if extension == ".toml":
        return tomllib.loads(text)
    if extension in (".yaml", ".yml"):
        import yaml

        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from e
    raise ValueError("document_format_unsupported")


def select(document: object, pointer: str) -> object:
    """The value at a JSON pointer, or a marker if it is missing.

    An index is read as a number is: empty is 0, leading zeros count, and anything that
    is not a whole number from 0 on is missing.
    """
    if pointer == "":
        return document
    if not pointer.startswith("/"):
        raise SelectorError(pointer)
    at = document
    for token in pointer[1:].split("/"):
        token = token.replace("~1", "/").replace("~0", "~")
        if isinstance(at, list):
            try:
                index = float(token.strip() or 0)
            except ValueError:
                return _MISSING
            if not 0 <= index < len(at) or index != int(index):
                return _MISSING
            at = at[int(index)]
        elif isinstance(at, dict):
            if token not in at:
                return _MISSING
            at = at[token]
        else:
            return _MISSING
    return at


RESULT = "value string, present boolean, error string"


@pandas_udf(RESULT)
def query_udf(text: pd.Series, extension: pd.Series, pointer: pd.Series) -> pd.DataFrame:
    """Value as JSON text, whether it is there (null is), and an error code."""
    rows = []
    for t, e, p in zip(text, extension, pointer, strict=True):
        try:
            if len((t or "").encode()) > MAX_SOURCE:
                rows.append((None, False, "document_source_too_large"))
                continue
            got = select(parse(t or "", e), p)
            value = None if got is _MISSING else json.dumps(got, ensure_ascii=False, separators=(",", ":"), default=str)
            large = value is not None and len(value.encode()) > MAX_RESULT
            rows.append((None, False, "document_result_too_large") if large else (value, got is not _MISSING, None))
        except SelectorError:
            rows.append((None, False, "invalid_document_selector"))
        except (ValueError, RecursionError, MemoryError) as err:  # nested deeper than the parsers go, too
            rows.append((None, False, str(err) if str(err) == "document_format_unsupported" else "document_invalid"))
    return pd.DataFrame(rows, columns=["value", "present", "error"])


def fixed_pointer(document: Column, pointer: str) -> Column:
    """The text at a pointer of object keys known when the plan is made; built in, so it stays in the JVM."""
    keys = [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]
    return F.get_json_object(document, "$" + "".join(f"['{k}']" for k in keys))


def null_state(document: Column, key: str) -> Column:
    """``missing``, ``null`` or ``value`` of a top-level key."""
    v = F.try_parse_json(document)
    got = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(got.isNull(), F.lit("missing")).when(F.is_variant_null(got), F.lit("null")).otherwise(F.lit("value"))


def canonical_json(text: str) -> str:
    """Keys sorted on every level, no spaces."""
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pandas_udf("string")
def canonical_udf(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical_json(t)
        except (ValueError, RecursionError, MemoryError):
            return None

    return text.map(one)
