"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its lower-cased words without outer punctuation, and each word's
first four and five characters, so that inflected forms of a root share a term. Terms
are hashed; a text is the set of its term hashes. The machine adds to the linear
weights the inner products of learned term vectors, so a pair such as an insult with
a group mention can weigh more than its two terms.

Fitting takes at most ``sample`` labelled rows, chosen by a hash of their ids, and
keeps up to ``features`` terms: those with a standardised difference between the classes
of ``least_z``, and those of pairs, among the ``paired`` most frequent terms, whose texts
differ by ``least_pair_z`` from what the two terms' own shares say, as a term can matter
in a pair without a difference of its own. All are parameters. Scoring reads every whole text.

Defined results: a null or empty text has no terms and gets the score of the bias;
labels that are null are left out, repeated labels of one id count once (the largest),
and of documents with that id the smallest text is learned from;
without labels of both classes every score is the share of label 1 (0 if none).
Columns of ``docs`` that a filter keeps are passed on unchanged, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, slices, whole_text

BUCKETS = 1 << 22
OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’¿¡…–—"
PREFIXES = (4, 5)


def word_terms(word: str) -> list[int]:
    """Hashes of one word's terms, below ``BUCKETS``."""
    word = word.strip(OUTER)
    if not word:
        return []
    out = [zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS]
    out += [zlib.crc32(f"{k}:{word[:k]}".encode("utf-8", "surrogatepass")) % BUCKETS for k in PREFIXES if len(word) > k]
    return out


def text_terms(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term) pairs in order; with ``wanted`` (sorted), terms are positions in it and others go."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    coded = words.flatten().dictionary_encode()
    terms = [word_terms(w) for w in coded.dictionary.to_pylist()]
    length = np.fromiter(map(len, terms), np.int64, len(terms))
    flat = np.fromiter((x for t in terms for x in t), np.int64, int(length.sum()))
    if wanted is not None:
        at = np.minimum(np.searchsorted(wanted, flat), max(0, len(wanted) - 1))
        keep = wanted[at] == flat if len(wanted) else np.zeros(len(flat), bool)
        owner = np.repeat(np.arange(len(terms)), length)[keep]
        flat, length = at[keep], np.bincount(owner, minlength=len(terms))
    start = np.concatenate([[0], np.cumsum(length)])
    code = coded.indices.to_numpy(zero_copy_only=False)
    hit = length[code] > 0
    code, row = code[hit], row[hit]
    pairs = np.unique((row << 32) | code)  # each word of a row once
    row, code = pairs >> 32, pairs & 0xFFFFFFFF
    n = length[code]
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    pairs = np.unique((np.repeat(row, n) << 32) | flat[np.repeat(start[code], n) + offset])
    return pairs >> 32, pairs & 0xFFFFFFFF


@dataclass
class Machine:
    """Bias, linear weights and term vectors of the kept terms (sorted hashes)."""

    terms: np.ndarray
    bias: float
    linear: np.ndarray
    vectors: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, term = text_terms(texts, self.terms)
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(row, term, len(texts)), -35, 35)))

    def margin(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(row, self.linear[term], n)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[term, f]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out


def pair_z(labels: np.ndarray, row: np.ndarray, term: np.ndarray, df: np.ndarray, hit: np.ndarray, paired: int) -> np.ndarray:
    """Per term, the largest deviation over its pairs among the ``paired`` most frequent terms: label 1
    in texts with both, against the sum of both terms' log odds, in standard deviations."""
    n, out = len(labels), np.zeros(len(df))
    often = np.argsort(-df, kind="stable")[:paired]
    often = often[df[often] >= 3]
    place = np.full(len(df), -1)
    place[often] = np.arange(len(often))
    t = place[term]
    x = np.zeros((n, len(often)), np.float32)
    x[row[t >= 0], t[t >= 0]] = 1
    # Both counts are whole numbers below 2^24, so float32 is exact.
    positive = x[labels > 0]
    share = (labels.sum() + 0.5) / (n + 1)
    odds = lambda p: np.log(p / (1 - p))
    own = odds((hit[often] + share) / (df[often] + 1)) - odds(share)
    for i in range(0, len(often), 256):  # bounds what is held beside ``x``
        both, hits = x[:, i : i + 256].T @ x, positive[:, i : i + 256].T @ positive
        p = 1 / (1 + np.exp(-np.clip(own[i : i + 256, None] + own[None] + odds(share), -35, 35)))
        z = np.abs(hits - both * p) / np.sqrt(both * p * (1 - p) + 1)
        z[np.arange(len(z)), i + np.arange(len(z))] = 0
        out[often[i : i + 256]] = z.max(axis=1, initial=0)
    return out


def fit(labels: np.ndarray, row: np.ndarray, term: np.ndarray, features: int = 4096, rank: int = 8, epochs: int = 40, rate: float = 0.2, decay: float = 1e-5, least_z: float = 5.0, seed: int = 7, paired: int = 2048, least_pair_z: float = 6.0) -> Machine:
    """Fits by AdaGrad on logistic loss. ``row, term``: distinct pairs, rows ascending."""
    n, positive = len(labels), int(labels.sum())
    if positive in (0, n):
        share = positive / n if n else 0.0
        bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return Machine(np.empty(0, np.int64), bias, np.empty(0), np.empty((0, rank)))
    known, at = np.unique(term, return_inverse=True)
    df = np.bincount(at, minlength=len(known))
    hit = np.bincount(at, labels[row], len(known))
    p1, p0 = hit / positive, (df - hit) / (n - positive)
    p = df / n
    z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / positive + 1 / (n - positive)) + 1e-12)
    of_pairs = pair_z(labels, row, at, df, hit, paired)
    of_pairs[of_pairs < least_pair_z] = 0
    z[(df < 3) | (z < least_z)] = 0  # a difference that a million chance terms would hardly show
    z = np.maximum(z, of_pairs)
    top = np.sort(np.argsort(-z, kind="stable")[:features])
    top = top[z[top] > 0]
    place = np.full(len(known), -1)
    place[top] = np.arange(len(top))
    keep = place[at] >= 0
    row, term = row[keep], place[at][keep]
    start = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    m = Machine(known[top], float(np.log(positive / (n - positive))), np.zeros(len(top)), rng.normal(0, 0.01, (len(top), rank)))
    g_bias, g_linear, g_vectors = 1e-8, np.full(len(top), 1e-8), np.full((len(top), rank), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 256):
            rows = order[i : i + 256]
            lens = start[rows + 1] - start[rows]
            r = np.repeat(np.arange(len(rows)), lens)
            t = term[np.repeat(start[rows] - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))]
            error = 1 / (1 + np.exp(-np.clip(m.margin(r, t, len(rows)), -35, 35))) - labels[rows]
            used = np.unique(t)
            g = float(error.mean())
            g_bias += g * g
            m.bias -= rate * g / np.sqrt(g_bias)
            e = error[r] / len(rows)
            g = np.bincount(t, e, len(top))[used] + decay * m.linear[used]
            g_linear[used] += g * g
            m.linear[used] -= rate * g / np.sqrt(g_linear[used])
            for f in range(rank):
                v = m.vectors[t, f]
                s = np.bincount(r, v, len(rows))[r]
                g = np.bincount(t, e * (s - v), len(top))[used] + decay * m.vectors[used, f]
                g_vectors[used, f] += g * g
                m.vectors[used, f] -= rate / 4 * g / np.sqrt(g_vectors[used, f])
    return m


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, mod 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % 5


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 5_000, features: int = 4096, text: str = "text") -> Machine:
    """Fits on at most ``sample`` labelled rows outside fold 0."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold() != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of two numbers: broadcast. Of documents that repeat an id the smallest text counts, so `sample` bounds these too.
    rows = docs.select(F.col("doc_id").cast("long"), whole_text(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text")).select("y", "text")

    @lean
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, term = text_terms(b.column(1))
            offsets = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(term.astype(np.int32)))], ["y", "terms"])

    got = rows.mapInArrow(terms, "y int, terms array<int>").toArrow()
    lists = got.column("terms").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    row = np.repeat(np.arange(len(lists), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    y = got.column("y").to_numpy().astype(np.float64)
    term = lists.flatten().to_numpy().astype(np.int64)
    # The rows' order depends on the cluster; the fit must not.
    key = np.array([zlib.crc32(term[a:b].tobytes()) for a, b in zip(*(lambda s: (s[:-1], s[1:]))(np.searchsorted(row, np.arange(len(lists) + 1))), strict=True)], np.int64)
    order = np.lexsort((y, key))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.argsort(rank[row], kind="stable")
    return fit(y[order], rank[row][by], term[by], features)


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def scores(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = shared.value.scores(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), whole_text(text).alias("text")).mapInArrow(run, SCORES)


def without_toxic(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.concatenate([shared.value.scores(b.column(at)) for b in slices(iter([batch]), batch.schema.names[at])] or [np.empty(0)]) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
