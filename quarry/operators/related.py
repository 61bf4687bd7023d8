"""Related chunks of a file and line: chunks with line spans, word vectors, and an inverted-file vector index.

A text is cut to chunks of ``lines`` lines; a chunk's vector is its words' counts (square roots), hashed to ``DIM`` signed places,
at length 1. The index keeps, for each vector, the nearest of some centroids (its list) and its residual in 8 bits a
component; lists are folders, so a search reads only those that it probes. Centroids come from ``sample`` vectors, those whose
keys hash lowest, by Lloyd's rounds in numpy; every vector is indexed. How many lists a search probes is measured: the fewest by which ``TUNED`` vectors of
the sample find the share ``recall`` of their exact neighbours.

A search takes up to ``QUERIES`` vectors at once, ``search_all`` any number in such blocks. Each task scores the coded vectors of the probed lists and passes on its
``rerank * k`` best for each query, whose whole vectors then give exact cosines. With ``exact``, all lists are read and whole
vectors scored, which is the fallback with a certain result. However the rows of lists are dealt over tasks, a hot list
included, a task passes on a bounded number for each query.

Defined results: vectors of length 0 or null are in no list and find nothing; a line beyond a file's end or in a file that
is not there finds nothing; equal scores are ordered by key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.shared import stored

DIM, QUERIES, LIST_ROWS, MOST_LISTS, TUNED = 128, 1024, 256, 1024, 64
#: Rows of a list in one file, about.
FILE_ROWS = 1 << 15
Batches = Iterator[pa.RecordBatch]


def chunks(docs: DataFrame, key: str, text: str, lines: int = 20) -> DataFrame:
    """``file, start, end, text``: spans of ``lines`` lines, numbered from 1, to the end of each text."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    end = lambda at: F.least(at + lines - 1, F.size("_lines")).alias("end")
    # Cut before they are rows, so that no row holds a whole text beside its chunk.
    cut = F.transform(F.sequence(F.lit(1), F.size("_lines"), F.lit(lines)), lambda at: F.struct(at.alias("start"), end(at), F.array_join(F.slice("_lines", at, lines), "\n").alias("text")))
    return docs.select(F.col(key).alias("file"), split.alias("_lines")).select("file", F.inline(cut))


def word_vectors(texts: pa.Array) -> np.ndarray:
    """A row of length 1 for each text (0 if it has no word)."""
    words = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN_]+")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    hashes = np.fromiter((zlib.crc32(w.encode()) for w in known), np.int64, len(known))
    code = coded.indices.to_numpy(zero_copy_only=False)
    real = np.array([bool(w) for w in known], bool)[code] if len(known) else np.zeros(0, bool)
    pairs, tf = np.unique((row[real] << 32) | code[real], return_counts=True)
    row, code = pairs >> 32, pairs & 0xFFFFFFFF
    out = np.zeros((len(texts), DIM), np.float32)
    np.add.at(out, (row, hashes[code] % DIM), np.where(hashes[code] >> 31 & 1, 1, -1) * np.sqrt(tf))
    return unit(out)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def embedded(chunked: DataFrame) -> DataFrame:
    """``file, start, end, vector`` of chunks."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            vectors = word_vectors(batch.column("text"))
            yield pa.record_batch([*(batch.column(c) for c in ("file", "start", "end")), as_lists(vectors)], ["file", "start", "end", "vector"])

    kind = chunked.schema["file"].dataType.simpleString()
    return chunked.select("file", "start", "end", "text").mapInArrow(run, f"file {kind}, start int, end int, vector array<float>")


def as_lists(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] if rows.ndim == 2 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.astype(np.float32).ravel()))


def as_rows(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long lists, none null."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def normed(vectors: DataFrame, keys: tuple[str, ...], vector: str) -> DataFrame:
    """The keys and ``vector``, at length 1, of vectors of length above 0 that hold no null."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            width = pc.fill_null(pc.list_value_length(batch.column(vector)), 0).to_numpy()
            real = width > 0
            values = batch.column(vector).flatten()
            if values.null_count:
                real[np.repeat(np.arange(len(width)), width)[values.is_null().to_numpy(zero_copy_only=False)]] = False
            if not real.any():
                continue
            batch = batch.filter(pa.array(real))
            rows = batch.column(vector).flatten().cast(pa.float64()).to_numpy().reshape(batch.num_rows, -1)
            length = np.zeros(len(rows))
            for x in rows.T:  # in order, so that a sum does not hang on a machine's vector width
                length += x * x
            length = np.sqrt(length)
            real = ~(length <= 0)
            batch = batch.filter(pa.array(real))
            yield pa.record_batch([*(batch.column(c) for c in keys), as_lists(rows[real] / length[real, None])], [*keys, "vector"])

    named = ", ".join(f"{k} {vectors.schema[k].dataType.simpleString()}" for k in keys)
    return vectors.select(*keys, vector).mapInArrow(run, f"{named}, vector array<float>")


def centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Lloyd's rounds over unit vectors; a centroid that loses all its members takes the vector that is farthest from its own."""
    rng = np.random.default_rng(seed)
    at = sample[rng.permutation(len(sample))[:count]]
    for _ in range(rounds):
        near = sample @ at.T
        own, far = near.argmax(axis=1), near.max(axis=1).argsort(kind="stable")
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(at)) == 0)
        sums[empty] = sample[far[: len(empty)]]
        at = unit(sums)
    return at


@dataclass(frozen=True)
class VectorIndex:
    """An index of vectors below ``path``: ``rows`` by list, and the centroids; ``keys`` are the columns that name a vector."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: str
    centroids: np.ndarray
    probes: int = 1

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/lists")


def build(vectors: DataFrame, path: str, keys: tuple[str, ...], vector: str = "vector", sample: int = 8192, recall: float = 0.95) -> VectorIndex:
    """Indexes every vector of length above 0; lists of about ``LIST_ROWS``, at most ``MOST_LISTS``."""
    spark = vectors.sparkSession
    # Read for the sample, the count and the lists, so made once.
    real = stored(normed(vectors, keys, vector))
    taken = unit(as_rows(real.withColumn("_by", F.xxhash64(*keys)).orderBy("_by", *keys).limit(sample).select("vector").toArrow().column(0).combine_chunks()))
    held = real.count()
    count = int(min(MOST_LISTS, max(1, held // LIST_ROWS), max(1, len(taken))))
    middle = centroids(taken, count) if len(taken) else np.zeros((0, 0), np.float32)
    # A large list is spread over files and tasks, in as many parts as its share of the sample calls for.
    share = np.bincount((taken @ middle.T).argmax(axis=1), minlength=len(middle)) / len(taken) if len(taken) else np.zeros(0)
    parts = np.maximum(1, np.ceil(share * held / FILE_ROWS)).astype(np.int64)
    shared = spark.sparkContext.broadcast((middle, parts))  # at most MOST_LISTS vectors

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = as_rows(batch.column("vector"))
            middle, parts = shared.value
            own = (rows @ middle.T).argmax(axis=1) if len(rows) else np.zeros(0, np.int64)
            rest = rows - middle[own] if len(rows) else rows
            scale = np.abs(rest).max(axis=1, initial=1e-12) / 127
            codes = np.round(rest / scale[:, None]).astype(np.int8)
            columns = [batch.column(c) for c in keys] + [batch.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale.astype(np.float32)), pa.array(own.astype(np.int32))]
            yield pa.record_batch([*columns, pa.array(parts[own] if len(own) else own)], [*keys, "vector", "code", "scale", "list", "_parts"])

    named = ", ".join(f"{k} {vectors.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{named}, vector array<float>, code binary, scale float, list int"
    dealt = real.mapInArrow(run, f"{schema}, _parts long").withColumn("_part", F.pmod(F.xxhash64(*keys), F.col("_parts"))).repartition("list", "_part")
    dealt.drop("_part", "_parts").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    index = VectorIndex(spark, path, keys, schema, middle)
    if not len(taken):
        return index
    asked = taken[:TUNED]
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "query long, vector array<float>")
    rank = np.argsort(np.argsort(-(asked @ middle.T), axis=1, kind="stable"), axis=1)
    near = search(index, queries, 10, exact=True)  # 10 rows a query
    found = index.rows().select(*keys, "list").join(F.broadcast(near), list(keys)).select("query", "list").toArrow()
    needed = np.sort(rank[found.column("query").to_numpy(), found.column("list").to_numpy()])
    return replace(index, probes=int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1)


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int = 8, exact: bool = False) -> DataFrame:
    """``query``, the keys and ``score`` (cosine) of each query's ``k`` nearest. ``queries``: query, vector; at most ``QUERIES`` of length above 0.

    ``probes``: lists read for each query, of which the index knows a number.
    """
    got = queries.where("vector IS NOT NULL").select(F.col("query").cast("long").alias("query"), F.transform("vector", lambda x: x.cast("float")).alias("vector")).limit(QUERIES + 1).toArrow()
    if got.num_rows > QUERIES:
        raise ValueError(f"more than {QUERIES} queries at once")
    wanted = unit(as_rows(got.column("vector").combine_chunks())) if got.num_rows else np.zeros((0, DIM), np.float32)
    ids = got.column("query").to_numpy()
    real = np.abs(wanted).sum(axis=1) > 0 if got.num_rows else np.zeros(0, bool)
    wanted, ids = wanted[real], ids[real]
    held = len(ids) and len(index.centroids)
    near = np.argsort(-(wanted @ index.centroids.T), axis=1, kind="stable")[:, : probes or index.probes] if held else np.zeros((len(ids), 0), np.int64)
    probed = np.zeros((len(ids), max(1, len(index.centroids))), bool)
    np.put_along_axis(probed, near, True, axis=1)
    most = k if exact else k * rerank
    shared = index.spark.sparkContext.broadcast((wanted, ids, probed, index.centroids))  # QUERIES vectors at most
    keys = list(index.keys)
    rows = index.rows() if exact else index.rows().where(F.col("list").isin([int(x) for x in np.unique(near)]))

    def run(batches: Batches) -> Batches:
        vectors, names, asked, middle = shared.value
        best: list[pa.Table] = []

        def trimmed(parts: list[pa.Table]) -> list[pa.Table]:
            whole = pa.concat_tables(parts).sort_by([("query", "ascending"), ("near", "descending"), *((c, "ascending") for c in keys)])
            query = whole.column("query").to_numpy()
            first = np.searchsorted(query, query, side="left")
            return [whole.take(np.flatnonzero(np.arange(len(query)) - first < most))]

        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            if exact:
                scores = as_rows(batch.column("vector")) @ vectors.T
            else:
                own = batch.column("list").to_numpy()
                codes = np.stack([np.frombuffer(c, np.int8) for c in batch.column("code").to_pylist()]).astype(np.float32)
                scores = (middle[own] + codes * batch.column("scale").to_numpy()[:, None]) @ vectors.T
                scores[~asked.T[own]] = -np.inf
            top = np.argpartition(-scores, min(most, len(scores)) - 1, axis=0)[:most] if most < len(scores) else np.arange(len(scores))[:, None].repeat(len(names), 1)
            low = np.take_along_axis(scores, top, 0).min(axis=0)
            at, query = np.nonzero((scores >= low) & np.isfinite(scores))
            taken = batch.take(pa.array(at))
            best.append(pa.table([pa.array(names[query]), pa.array(scores[at, query].astype(np.float64)), *(taken.column(c) for c in [*keys, "vector"])], ["query", "near", *keys, "vector"]))
            if sum(t.num_rows for t in best) > 4 * most * len(names):
                best = trimmed(best)
        if best:
            for t in trimmed(best):
                yield from t.combine_chunks().to_batches()

    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = [*keys, "vector", "list"] if exact else [*keys, "vector", "code", "scale", "list"]
    found = rows.select(*columns).mapInArrow(run, "query long, near double, " + ", ".join(f"{c} {fields[c]}" for c in [*keys, "vector"]))
    ordered = ", ".join(keys)
    if not exact:
        found = found.selectExpr("*", f"row_number() OVER (PARTITION BY query ORDER BY near DESC, {ordered}) AS _n").where(F.col("_n") <= most).drop("_n")
    asked = index.spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, wanted, strict=True)], "query long, _asked array<double>")
    dot = F.aggregate(F.zip_with("vector", "_asked", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scored = found.join(F.broadcast(asked), "query").select("query", *keys, (dot / length).alias("score"))
    return scored.selectExpr("*", f"row_number() OVER (PARTITION BY query ORDER BY score DESC, {ordered}) AS _n").where(F.col("_n") <= k).drop("_n")


def search_all(index: VectorIndex, queries: DataFrame, k: int = 10, exact: bool = False) -> DataFrame:
    """``search`` for any number of queries (query, vector): by hash in blocks of about half of ``QUERIES``, one after the other, each block's result stored.

    The driver and a task hold one block; what the index reads grows with the number of blocks.
    """
    asked = stored(queries.where("vector IS NOT NULL").select("query", "vector").distinct())
    blocks = 1
    while True:  # a block that is too large by chance, which is rare, halves all
        block = F.pmod(F.xxhash64("query", "vector"), F.lit(blocks))
        most = asked.groupBy(block).count().agg(F.max("count")).first()[0] or 0
        if most <= QUERIES or blocks > 1 << 30:
            break
        blocks *= max(2, -(-most // QUERIES))
    parts = [stored(search(index, asked.where(block == i), k, exact=exact)) for i in range(blocks)] if blocks > 1 else [search(index, asked, k, exact=exact)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def find_related(index: VectorIndex, file: object, line: int, k: int = 10, exact: bool = False) -> DataFrame:
    """``file, start, end, score`` of the ``k`` chunks nearest to the one that holds ``line`` (from 1) of ``file``, itself left out."""
    own = (F.col("file") == F.lit(file)) & (F.col("start") <= line) & (F.col("end") >= line)
    found = search(index, index.rows().where(own).select(F.lit(0).alias("query"), "vector").limit(1), k + 1, exact=exact)
    return found.where(~own).orderBy(F.desc("score"), "file", "start").limit(k).select("file", "start", "end", "score")
