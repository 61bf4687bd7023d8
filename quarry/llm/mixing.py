"""Mixing documents to target domain weights by soft membership.

A softmax classifier, fitted on a bounded sample of the labelled table, gives every
document a posterior over the domains. Document rates are then fitted by projected
gradient least squares: with n tokens and posterior p of each document, the expected
tokens of the domains are sum(rate * n * p), and the rates, none below ``floor``, are
moved until these match the targets. The gradient is taken in the metric of the Gram
matrix sum(n^2 p p') of the documents whose rates are above the floor, in which its
Lipschitz constant over these is 1, so the step is 1; where such a step does not lessen
the error, the one in the metric of all documents is taken, which always does.

A step depends on the data only through one number per domain, so a document's rate is
a fold over the list of past steps: no rates are stored or sent, and each round is one
aggregate over a narrow table.

Defined results: a null or empty text has no tokens and keeps its starting rate; an
empty table has no rates; without labelled rows the posterior is uniform; a domain that
no label has gets no posterior mass, and its target is left unmet; rows that repeat an
id get equal numbers of copies; columns of ``docs`` are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quarry.llm.common import lean, slices, stored, whole_text
from quarry.llm.toxicity import text_terms

#: Domain of a labelled row, and the share of tokens that each domain is to have.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' END"
WEIGHTS = {"high": 0.90, "low": 0.09, "toxic": 0.01}
ROUNDS, CLOSE = 40, 1e-7


def shape(texts: pa.Array) -> np.ndarray:
    """Dense features of each text: sizes and shares of kinds of characters and words."""
    out = []
    for t in texts.to_pylist():
        words = t.split()
        n, w = max(1, len(t)), max(1, len(words))
        out.append((np.log1p(len(t)), np.log1p(len(words)), len(t) / w / 10, len(set(words)) / w, sum(map(t.count, "!?#$%&*|")) / n, sum(map(t.count, "0123456789")) / n, t.count("\n") / w, float(t.isupper()), sum(map(t.count, ".,")) / w))
    return np.array(out, np.float64).reshape(len(texts), 9)


@dataclass
class Softmax:
    """Weights of the kept terms (sorted hashes) and of the standardised dense features."""

    terms: np.ndarray
    sparse: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        row, term = text_terms(texts, self.terms)
        return self.of(row, term, (shape(texts) - self.mean) / self.scale)

    def of(self, row: np.ndarray, term: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = self.bias + dense @ self.dense
        for d in range(len(self.bias)):
            z[:, d] += np.bincount(row, self.sparse[term, d], len(dense))
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def fit(y: np.ndarray, row: np.ndarray, term: np.ndarray, dense: np.ndarray, domains: int, features: int = 1024, least_z: float = 5.0, epochs: int = 30, rate: float = 0.1, decay: float = 1e-4, seed: int = 11) -> Softmax:
    """AdaGrad on the cross entropy. ``row, term``: distinct pairs, rows ascending."""
    n = len(y)
    mean, scale = (dense.mean(axis=0), dense.std(axis=0) + 1e-9) if n else (np.zeros(dense.shape[1]), np.ones(dense.shape[1]))
    known, at = np.unique(term, return_inverse=True)
    df = np.bincount(at, minlength=len(known))
    z = np.zeros(len(known))
    for d in range(domains):
        own = y == d
        k = int(own.sum())
        if 0 < k < n:
            hit = np.bincount(at, own[row], len(known))
            p = df / n
            z = np.maximum(z, np.abs(hit / k - (df - hit) / (n - k)) / np.sqrt(p * (1 - p) * (1 / k + 1 / (n - k)) + 1e-12))
    z[(df < 3) | (z < least_z)] = 0
    top = np.sort(np.argsort(-z, kind="stable")[:features])
    top = top[z[top] > 0]
    place = np.full(len(known), -1)
    place[top] = np.arange(len(top))
    keep = place[at] >= 0 if len(at) else np.zeros(0, bool)
    row, term = row[keep], place[at][keep] if len(at) else at
    share = np.bincount(y, minlength=domains) / max(1, n)
    bias = np.log(np.maximum(share, 1e-9)) if n else np.zeros(domains)
    m = Softmax(known[top], np.zeros((len(top), domains)), np.zeros((dense.shape[1], domains)), bias, mean, scale)
    if not n:
        return m
    x = (dense - mean) / scale
    start = np.searchsorted(row, np.arange(n + 1))
    g_s, g_d, g_b = np.full_like(m.sparse, 1e-8), np.full_like(m.dense, 1e-8), np.full_like(m.bias, 1e-8)
    target = np.eye(domains)[y]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 256):
            rows = order[i : i + 256]
            lens = start[rows + 1] - start[rows]
            r = np.repeat(np.arange(len(rows)), lens)
            t = term[np.repeat(start[rows] - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))]
            error = (m.of(r, t, x[rows]) - target[rows]) / len(rows)
            for parameter, gained, g in ((m.bias, g_b, error.sum(axis=0)), (m.dense, g_d, x[rows].T @ error + decay * m.dense), (m.sparse, g_s, np.stack([np.bincount(t, error[r, d], len(top)) for d in range(domains)], axis=1) + decay * m.sparse)):
                gained += g * g
                parameter -= rate * g / np.sqrt(gained)
    return m


def train(docs: DataFrame, labels: DataFrame, domains: list[str], domain: str = DOMAIN, sample: int = 4000, text: str = "text") -> Softmax:
    """Fits on at most ``sample`` labelled rows, chosen by a hash of their ids."""
    chosen = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(domain).alias("d")).where(F.col("d").isin(domains)).groupBy("doc_id").agg(F.min("d").alias("d")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Of documents that repeat an id the smallest text counts, so `sample` bounds what reaches the driver.
    rows = docs.select(F.col("doc_id").cast("long"), whole_text(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("d").alias("d"), F.min("text").alias("text")).select("d", "text")

    @lean
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, term = text_terms(b.column(1))
            offsets = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(term.astype(np.int32))), pa.array(shape(b.column(1)).tolist(), pa.list_(pa.float64()))], ["d", "terms", "dense"])

    got = rows.mapInArrow(features, "d string, terms array<int>, dense array<double>").toArrow()
    y, dense = got.column("d").to_pylist(), np.array(got.column("dense").to_pylist(), np.float64).reshape(len(got), 9)
    lists = [x.values.to_numpy().astype(np.int64) for x in got.column("terms")]
    # The rows' order depends on the cluster; the fit must not.
    order = sorted(range(len(y)), key=lambda i: (dense[i].tolist(), y[i]))
    row = np.repeat(np.arange(len(order)), [len(lists[i]) for i in order]).astype(np.int64)
    term = np.concatenate([lists[i] for i in order]) if order else np.empty(0, np.int64)
    return fit(np.array([domains.index(y[i]) for i in order], np.int64), row, term, dense[order], len(domains))


def _tokens(texts: pa.Array) -> pa.Array:
    """Number of words of each text."""
    trimmed = pc.utf8_trim_whitespace(texts)
    return pc.if_else(pc.equal(trimmed, ""), 0, pc.list_value_length(pc.utf8_split_whitespace(trimmed))).cast(pa.int64())


def _with_posteriors(rows: DataFrame, at: int, model: Softmax, n: str, p: str) -> DataFrame:
    """``rows`` with words and posteriors of the text column at place ``at``, a null one as empty."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*rows.schema.fields, StructField(n, LongType()), StructField(p, ArrayType(DoubleType()))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            texts = pc.fill_null(b.column(at), "")
            found = pa.array(shared.value.posteriors(texts).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, _tokens(texts), found], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def posteriors(docs: DataFrame, model: Softmax, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, p``; tokens are words."""
    return _with_posteriors(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")), 1, model, "n_tokens", "p").drop("text")


@dataclass
class Rates:
    """Starting rate, floor and the list of steps; a rate is their fold."""

    start: float
    floor: float
    steps: list[list[float]]
    targets: list[float]

    def column(self, n: str = "n_tokens", p: str = "p") -> Column:
        rate = F.lit(float(self.start))
        if not self.steps:
            return rate
        past = F.array(*(F.array(*map(F.lit, s)) for s in self.steps))
        move = lambda w, g: F.greatest(F.lit(float(self.floor)), w + F.col(n) * F.aggregate(F.zip_with(F.col(p), g, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y))
        return F.aggregate(past, rate, move)

    def of(self, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        w = np.full(len(n), float(self.start))
        for g in self.steps:
            w = np.maximum(self.floor, w + n * (p @ np.array(g)))
        return w


def fit_rates(members: DataFrame, domains: int, weights: list[float], floor: float = 0.0, budget: float | None = None, rounds: int = ROUNDS) -> Rates:
    """Fits rates on a stored table of ``n_tokens, p``.

    ``budget``: tokens to have in all. By default as many as there are or, with a floor,
    as many as are needed for no domain to be above its share.
    """
    at = lambda d: F.col("p")[d]
    n = F.col("n_tokens").cast("double")
    pairs = [(d, e) for d in range(domains) for e in range(d, domains)]

    def state(rates: Rates | None) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain, and the Gram matrix of the documents above the floor."""
        w = rates.column() if rates else F.lit(1.0)
        rows = members.select(w.alias("w"), "n_tokens", "p")
        above = F.when(F.col("w") > (floor if rates else -1.0), 1.0).otherwise(0.0)
        row = rows.agg(*(F.sum(F.col("w") * n * at(d)) for d in range(domains)), *(F.sum(above * n * n * at(d) * at(e)) for d, e in pairs)).first()
        gram = np.zeros((domains, domains))
        for (d, e), g in zip(pairs, row[domains:], strict=True):
            gram[d, e] = gram[e, d] = g or 0.0
        return np.array([x or 0.0 for x in row[:domains]]), gram

    share = np.array(weights, np.float64) / sum(weights)
    now, gram = state(None)
    if not now.sum():
        return Rates(1.0, floor, [], [0.0] * domains)
    if budget is None:
        budget = float(now.sum()) if not floor else floor * max(float(now[d] / share[d]) for d in range(domains) if share[d] > 0)
    targets = budget * share
    rates = Rates(max(floor, budget / float(now.sum())), floor, [], targets.tolist())
    metric = np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
    best, safe = np.inf, None
    for i in range(rounds):
        got, active = state(rates)
        missing = targets - got
        if np.abs(missing).max() <= CLOSE * budget:
            break
        error = float(missing @ metric @ missing)
        if i + 1 == rounds:  # targets that the posteriors can't meet are come near to
            if error > best:
                rates.steps.pop()
            break
        if error >= best and safe is not None:
            rates.steps[-1], safe = safe, None  # the plain step always lessens the error
            continue
        best, safe = error, (metric @ missing).tolist()
        rates.steps.append((np.linalg.pinv(active, rcond=1e-10, hermitian=True) @ missing).tolist() if active.any() else safe)
    return rates


def copies(rate: Column, doc_id: str | Column = "doc_id", seed: int = 17) -> Column:
    """Whole copies: the rate rounded up or down by a hash of the id, so that its expectation is the rate."""
    chance = F.pmod(F.xxhash64(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, domain: str = DOMAIN, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, p_<domain>..., rate, copies`` of every row."""
    domains = sorted(weights)
    members = stored(posteriors(docs, train(docs, labels, domains, domain, text=text), text))
    rates = fit_rates(members, len(domains), [weights[d] for d in domains])
    rated = members.withColumn("rate", rates.column())
    return rated.select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)), "rate", copies(F.col("rate")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], domain: str = DOMAIN, floor: float = 1.0, text: str = "text") -> DataFrame:
    """``docs`` with each row as often as its rate says; the same columns.

    With the floor of 1 no document goes: domains below their share are repeated. The
    rows are written once with their posteriors, which the rates are fitted on and
    computed from, and are not shuffled.
    """
    domains, n, p = sorted(weights), "__mix_tokens", "__mix_p"
    model = train(docs, labels, domains, domain, text=text)
    members = stored(_with_posteriors(docs, docs.columns.index(text), model, n, p))
    rates = fit_rates(members.select(F.col(n).alias("n_tokens"), F.col(p).alias("p")), len(domains), [weights[d] for d in domains], floor)
    times = copies(rates.column(n, p), F.col("doc_id").cast("long"))
    again = F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("__mix_copy")
    return members.select(*docs.columns, again).drop("__mix_copy")
