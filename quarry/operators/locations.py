"""Where each value of a JSON text stands: pointers with start and end, from a structural index of a whole batch.

For all texts of a batch together, array operations find the quotes that are not escaped, by their running parity what
lies in strings, and so the brackets, colons and commas that are structure. Only these are walked, text by text, with the
open containers as a stack. Spark has checked before that a text is JSON.

Defined results: offsets count characters (code points) from 0, the end is past the value's last; the whole text's value has the pointer
``''``; of a key that repeats in an object each value is given; null and text that is no JSON has no values.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND = pa.list_(pa.struct([("pointer", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
SPACE = b" \t\r\n"


def structure(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of structural signs in the bytes of texts that begin at ``starts`` (ascending, the first 0)."""
    n = len(data)
    slash = data == 92
    # A sign is escaped if the backslashes right before it are odd in number.
    last_other = np.maximum.accumulate(np.where(slash, -1, np.arange(n)))
    run = np.arange(n) - last_other
    escaped = np.zeros(n, bool)
    escaped[1:] = run[:-1] % 2 == 1
    quotes = np.cumsum((data == 34) & ~escaped)
    before = np.concatenate([[0], quotes])[starts]
    inside = (quotes - np.repeat(before, np.diff(np.append(starts, n)))) % 2 == 1
    return np.flatnonzero(~inside & np.isin(data, np.frombuffer(b"{}[]:,", np.uint8)))


def walk(text: bytes, places: list[int]) -> list[tuple[str, int, int]]:
    """``pointer, start, end`` (bytes) of every value, from the places of a text's structural signs."""

    def span(start: int, end: int) -> tuple[int, int] | None:
        part = text[start:end]
        left = len(part) - len(part.lstrip(SPACE))
        return (start + left, start + len(part.rstrip(SPACE))) if left < len(part) else None

    out: list[tuple[str, int, int]] = []
    names: list[str | int] = []  # the place in each open container: a key or an index
    begins: list[int] = []  # where the value now read begins, in each
    opened: list[int] = []
    begin = 0
    pointer = lambda: "".join(f"/{str(x).replace('~', '~0').replace('/', '~1')}" for x in names)

    def ended(at: int) -> None:
        if opened and (found := span(begins[-1], at)):
            out.append((pointer(), *found))

    for at in places:
        sign = text[at : at + 1]
        if sign in b"{[":
            opened.append(at)
            names.append(0 if sign == b"[" else "")
            begins.append(at + 1)
            begin = at + 1
        elif sign == b":":
            names[-1] = json.loads(text[begin:at])
            begins[-1] = at + 1
        else:
            ended(at)
            if sign == b",":
                if isinstance(names[-1], int):
                    names[-1] += 1
                begins[-1] = begin = at + 1
            else:
                for stack in (opened, names, begins):
                    stack.pop()
    if found := span(0, len(text)):
        out.append(("", *found))
    return out


def located(rows: DataFrame, text: str, into: str = "values") -> DataFrame:
    """``rows`` with an array ``into`` of ``pointer, start, end`` of every value of the JSON in ``text``."""

    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("_json").to_pylist()]
            length = np.array([len(t) for t in texts], np.int64)
            starts = np.cumsum(length) - length
            data = np.frombuffer(b"".join(texts), np.uint8)
            signs = structure(data, starts) if len(data) else np.zeros(0, np.int64)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            cut = np.searchsorted(signs, np.append(starts, len(data)))
            made = []
            for i, t in enumerate(texts):
                s, base = int(starts[i]), int(chars[starts[i]]) if len(data) else 0
                made.append([{"pointer": p, "start": int(chars[s + a]) - base, "end": int(chars[s + b]) - base} for p, a, b in walk(t, (signs[cut[i] : cut[i + 1]] - s).tolist())])
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(made, FOUND)], [*columns, into])

    known = rows.withColumn("_json", F.when(F.try_parse_json(text).isNotNull(), F.col(text)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return known.mapInArrow(run, f"{schema}, `{into}` array<struct<pointer:string,start:int,end:int>>")
