"""Document fingerprints by locally consistent parsing.

Level 0 is a text's code points. On each level, runs of one symbol become one
symbol; deterministic coin tossing (lowest bit in which a symbol differs from its
left neighbour, repeated until the alphabet has six labels) labels what is left, and
a block starts where a label is a local maximum. A block's name is a hash of the
names in it, and the names are the next level's text. Labels depend on a bounded
neighbourhood, so equal substrings get equal names inside, at any offset.

A fingerprint keeps, for each of ``GROUPS`` groups of levels, the smallest
``KEPT[g]`` hashes of the names there, a bottom-k sketch. Its likeness to another is
the mean, over the groups, of the sketches' estimates of the Jaccard similarity.

Defined results: a null text is an empty one; empty texts have the fingerprint
``"-"`` and likeness 1 to each other and 0 to other texts; equal texts have equal
fingerprints; rows without an id sort first, rows with one id by text; a table of
one row is its own next document. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, slices, whole_text

#: First level of each group of levels, and sketch size of each; the last group takes all higher levels.
GROUPS, KEPT = (2, 3, 4), (32, 24, 24)
#: Code points parsed together; bounds memory except for a longer single text.
CHUNK = 1 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = x + _M1
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def _coin(values: int) -> np.ndarray:
    """Label of every pair (left, own) of labels below ``values``: twice the lowest differing bit, plus that bit of own."""
    a = np.arange(values, dtype=np.int64)
    differ = a[:, None] ^ a[None, :]
    low = np.zeros_like(differ)
    rest = differ != 0
    low[rest] = np.log2(differ[rest] & -differ[rest]).astype(np.int64)
    return (2 * low + ((a[None, :] >> low) & 1)).astype(np.uint8)


_ROUND2, _ROUND3, _ROUND4 = _coin(128).reshape(-1), _coin(16).reshape(-1), _coin(8).reshape(-1)
_POWERS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Six-valued labels; ``first`` marks the first symbol of each text, which has no left neighbour."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = ~x[first]
    differ = x ^ left
    low = differ & (~differ + np.uint64(1))
    bit = (low.astype(np.float64).view(np.int64) >> 52) - 1023
    bit[low == 0] = 0
    label = (2 * bit + ((x >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.int64)).astype(np.uint8)
    for table, width in ((_ROUND2, 7), (_ROUND3, 4), (_ROUND4, 3)):
        left8 = np.empty_like(label)
        left8[1:] = label[:-1]
        left8[first] = label[first] ^ 1
        label = table[(left8.astype(np.int32) << width) | label]
    return label


def next_level(names: np.ndarray, doc: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the blocks of each text, and the text each belongs to."""
    n = len(names)
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    if not new.all():
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, n)).astype(np.uint64)
        names, doc = names[at], doc[at]
        long = run > 1
        names[long] = mix(names[long] ^ (run[long] * _M2))
        n = len(names)
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = doc[1:] != doc[:-1]
    label = _labels(names, first)
    start = first.copy()
    if n > 3:
        start[2:-1] |= (label[2:-1] > label[1:-2]) & (label[2:-1] >= label[3:]) & ~first[1:-2] & ~first[3:]
    at = np.flatnonzero(start)
    offset = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    block = np.add.reduceat(mix(names) * _POWERS[offset & 63], at)
    return mix(block ^ np.uint64(level)), doc[at]


def sketches(texts: list[str]) -> list[list[np.ndarray]]:
    """For each text and group, the sorted smallest distinct 32-bit hashes of its names."""
    out: list[list[np.ndarray]] = [[np.empty(0, np.uint32)] * len(GROUPS) for _ in texts]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not lengths.sum():
        return out
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    level, found = 0, [[] for _ in GROUPS]
    while len(names):
        level += 1
        names, doc = next_level(names, doc, level)
        if level >= GROUPS[0]:
            group = min(level - GROUPS[0], len(GROUPS) - 1)
            found[group].append((doc.astype(np.uint64) << np.uint64(32)) | (names >> np.uint64(32)))
            # A text of one name is done.
            alone = np.bincount(doc, minlength=len(texts))[doc] == 1
            names, doc = names[~alone], doc[~alone]
    for group, parts in enumerate(found):
        if not parts:
            continue
        keys = np.unique(np.concatenate(parts))
        own = (keys >> np.uint64(32)).astype(np.int64)
        at = np.searchsorted(own, np.arange(len(texts) + 1))
        hashes = keys.astype(np.uint32)
        for i in range(len(texts)):
            out[i][group] = hashes[at[i] : min(at[i + 1], at[i] + KEPT[group])]
    return out


def as_string(sketch: list[np.ndarray]) -> str:
    return ".".join(x.astype(">u4").tobytes().hex() for x in sketch) if any(len(x) for x in sketch) else "-"


def from_string(fingerprint: str) -> list[np.ndarray]:
    if fingerprint == "-":
        return [np.empty(0, np.uint32)] * len(GROUPS)
    return [np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in fingerprint.split(".")]


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """0 to 1; the mean of the groups' bottom-k estimates, over the groups that either has."""
    got = []
    for x, y, k in zip(a, b, KEPT, strict=True):
        if len(x) or len(y):
            union = np.union1d(x, y)[:k]
            both = np.intersect1d(x, y, assume_unique=True)
            got.append(int(np.searchsorted(both, union[-1], "right")) / len(union))
    return float(sum(got) / len(got)) if got else 1.0


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CHUNK):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(as_string, sketches(b.column(1).to_pylist())), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), whole_text(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points from the start of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, text: str = "text", rows: int = 2048) -> DataFrame:
    """Rows in ascending order within buckets, each bucket also holding the row that follows its last.

    Buckets are ranges of ids with about ``rows`` rows each. The bounds come from the
    ids alone; the first id of each bucket goes to the bucket before as well, and the
    first bucket's to the last. Texts are shuffled once. ``place`` sorts the copies
    after all else; they carry ``copied``.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"))
    n = ids.count()
    buckets = max(1, min(-(-n // rows), 1 << 20))
    cuts = ids.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], max(10_000, 4 * buckets)).alias("at")).first().at if buckets > 1 else []
    bounds = np.unique(np.array(cuts, np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def bucket_of(x):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.searchsorted(shared.value, x.to_numpy(), "left").astype(np.int32))

    # The first id of each bucket: at most one row a bucket.
    heads = dict(ids.select("id", bucket_of("id").alias("bucket")).groupBy("bucket").agg(F.min("id").alias("id")).collect())
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)} if order else {}
    known = np.array(sorted(before), np.int64)
    previous = np.array([before[x] for x in known], np.int32)
    also = docs.sparkSession.sparkContext.broadcast((known, previous))

    @F.pandas_udf("array<int>")
    def buckets_of(x):  # noqa: ANN001, ANN202
        import pandas as pd

        ids, (known, previous) = x.to_numpy(), also.value
        own = np.searchsorted(shared.value, ids, "left").astype(np.int32)
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        head = known[at] == ids
        return pd.Series([[o, -1 - p] if h else [o] for o, p, h in zip(own.tolist(), previous[at].tolist(), head.tolist(), strict=True)])

    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select(F.col("doc_id").cast("long"), whole_text(text).alias("text"), F.explode(buckets_of(id_)).alias("b"))
    keyed = keyed.select("doc_id", "text", F.when(F.col("b") < 0, -1 - F.col("b")).otherwise(F.col("b")).alias("bucket"), (F.col("b") < 0).alias("copied"))
    return keyed.repartition(max(1, min(len(order), 100_000)), "bucket").sortWithinPartitions("bucket", "copied", F.col("doc_id").asc_nulls_first(), "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, text: str = "text", rows: int = 2048) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see ``edit``."""

    def block(rows_: list[tuple]) -> pa.RecordBatch:
        ids, texts, following = zip(*rows_, strict=True)
        edited = [edit(t, f) for t, f in zip(texts, following, strict=True)]
        # Most rows' next document is the next row, so that only the others' are parsed on their own.
        other = [i for i in range(len(texts)) if i + 1 == len(texts) or following[i] is not texts[i + 1]]
        all_ = sketches([*texts, *edited, *(following[i] for i in other)])
        n = len(texts)
        own, ed = all_[:n], all_[n : 2 * n]
        nxt = [*own[1:], None]
        for i, s in zip(other, all_[2 * n :], strict=True):
            nxt[i] = s
        cols = [ids, list(map(len, texts)), [hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited], list(map(as_string, own)), list(map(as_string, ed)), [likeness(a, b) for a, b in zip(own, ed, strict=True)], [likeness(a, b) for a, b in zip(own, nxt, strict=True)]]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None  # last: the row that waits for its next
        for b in batches:
            for id_, t, bucket, copied in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last and last[2] == bucket:
                    held.append((last[0], last[1], t))
                    size += len(last[1])
                    last = None
                    if size > CHUNK // 2:
                        yield block(held)
                        held, size = [], 0
                if not copied:
                    last = (id_, t, bucket)
        if held:
            yield block(held)

    return in_order(docs, text, rows).mapInArrow(run, RESULT)
