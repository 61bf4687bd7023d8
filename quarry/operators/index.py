"""A stored inverted index: postings by term bucket in blocks with maxima, refreshed by digests, searched by bucket.

Tables below one path, each with a folder for every segment:

* ``postings``: ``term, place, block, n, most, shortest, entries``, partitioned by ``segment`` and ``bucket`` (hash of
  the term). A block holds up to ``BLOCK`` documents, the best of its place first, with the largest count and
  the smallest document length among them, which bound what any of them can score under every average length;
* ``docs``: ``key, digest, language, n_terms``; ``gone``: keys that a refresh dropped, with the segment they were in;
* ``df``: each term's change of document count; ``stats``: the change of documents and words.

A refresh writes one segment with the documents whose digest is new and tombstones for those that went or changed; statistics
are sums over segments, so what did not change is not read as text again. A segment counts once its
row in ``commits`` is written, which happens last, so a refresh that fails leaves the index as it was.

A search reads the buckets of its terms. The headers of blocks come first; of two bounds, what a block can score at most with
the other terms' best, and the k-th best of scores that single postings reach alone, the blocks in which no document
can be among the k best are not read further. Frequent terms are spread over ``PLACES`` tasks.

Defined results: a null text is empty; keys are unique; a query without a known term finds nothing; a segment may be empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.search import K1, WORD, B, postings
from quarry.operators.shared import stored
from quarry.sources.files import refreshed_index

BUCKETS, PLACES, BLOCK = 64, 8, 128
POSTINGS = "term string, place int, block long, n long, most long, shortest int, entries array<struct<key:{key},tf:bigint,n:int>>, segment int, bucket int"
Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Index:
    """An index below ``path``; ``key_type`` is the Spark type of its keys."""

    spark: SparkSession
    path: str
    key_type: str = "bigint"

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("segment").isin(self.segments()))

    def segments(self) -> list[int]:
        """Numbers of the committed segments: one for each refresh."""
        return sorted(r.segment for r in self.spark.read.schema("segment int").parquet(f"{self.path}/commits").collect())

    def postings(self) -> DataFrame:
        return self._read("postings", POSTINGS.format(key=self.key_type))

    def gone(self) -> DataFrame:
        return self._read("gone", f"key {self.key_type}, was int, segment int")

    def live(self) -> DataFrame:
        """``key, digest, language, n_terms, segment`` of the documents that can be found."""
        docs = self._read("docs", f"key {self.key_type}, digest string, language string, n_terms int, segment int")
        return docs.join(self.gone().select("key", F.col("was").alias("segment")), ["key", "segment"], "left_anti")

    def statistics(self) -> DataFrame:
        """One row: ``docs, words, mean, segments, tombstones``, from the segments' changes alone."""
        stats = self._read("stats", "docs long, words long, tombstones long, segment int")
        return stats.agg(
            F.sum("docs").alias("docs"), F.sum("words").alias("words"), F.try_divide(F.sum("words"), F.sum("docs")).alias("mean"), F.count("*").alias("segments"), F.sum("tombstones").alias("tombstones")
        )

    def document_counts(self) -> DataFrame:
        """``term, df`` of the terms that occur."""
        return self._read("df", "term string, change long, segment int").groupBy("term").agg(F.sum("change").alias("df")).where("df > 0")


def _digested(docs: DataFrame, key: str, text: str, language: str | None) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    spoken = F.col(language) if language else F.lit(None).cast("string")
    return docs.select(F.col(key).alias("key"), body.alias("text"), spoken.alias("language"), F.sha2(F.concat(F.coalesce(spoken, F.lit("")), F.lit("\n"), body), 256).alias("digest"))


def _counted(batches: Batches) -> Batches:
    """Batches of key, digest, language and lower-cased text with the number of words for the text."""
    for b in batches:
        yield pa.record_batch([*b.columns[:3], pc.count_substring_regex(b.column(3), WORD).cast(pa.int32())], ["key", "digest", "language", "n_terms"])


def _blocks(batches: Batches) -> Batches:
    """Rows of bucket, place, term, key, tf and n, in order of the first three, as blocks; what waits is less than a block."""
    rest, block = None, 0

    def made(rows: pa.Table, first: np.ndarray, end: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        whole = rows.slice(0, int(end[-1])).combine_chunks()
        key, tf, n = (whole.column(c).chunk(0) for c in ("key", "tf", "n"))
        entries = pa.ListArray.from_arrays(pa.array(np.append(first, end[-1]).astype(np.int32)), pa.StructArray.from_arrays([key, tf, n], ["key", "tf", "n"]))
        at = pa.array(first)
        lead = {c: whole.column(c).chunk(0).take(at) for c in ("term", "place", "bucket")}
        most, shortest = np.maximum.reduceat(tf.to_numpy(), first), np.minimum.reduceat(n.to_numpy(), first)
        columns = {"term": lead["term"], "place": lead["place"], "block": pa.array(number), "n": pa.array(end - first), "most": pa.array(most), "shortest": pa.array(shortest), "entries": entries, "bucket": lead["bucket"]}
        return pa.record_batch(list(columns.values()), list(columns))

    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        rows = rows.combine_chunks()
        bucket, place = (rows.column(c).to_numpy() for c in ("bucket", "place"))
        term = rows.column("term").chunk(0).dictionary_encode().indices.to_numpy()
        new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (place[1:] != place[:-1]) | (term[1:] != term[:-1])])
        start = np.flatnonzero(new)
        at = np.arange(len(new)) - np.repeat(start, np.diff(np.append(start, len(new))))
        at[: start[1] if len(start) > 1 else len(at)] += block * BLOCK  # the first rows go on where the last batch ended
        first = np.flatnonzero(at % BLOCK == 0)
        end, number = np.append(first[1:], len(at)), at[first] // BLOCK
        if len(first) > 1:
            yield made(rows, first[:-1], end[:-1], number[:-1])
        rest, block = rows.slice(int(first[-1])), int(number[-1])
    if rest is not None:
        yield made(rest, np.zeros(1, np.int64), np.array([rest.num_rows]), np.array([block]))


def _write_segment(index: Index, segment: int, new: DataFrame, dropped: DataFrame) -> None:
    """``new``: key, text, language, digest. ``dropped``: key, was, n_terms."""
    root = lambda name: f"{index.path}/{name}/segment={segment}"
    spark = index.spark
    place = lambda df, name: df.write.mode("overwrite").parquet(root(name))
    place(dropped.select("key", "was"), "gone")
    place(new.select("key", "digest", "language", F.lower("text").alias("text")).mapInArrow(_counted, f"key {index.key_type}, digest string, language string, n_terms int"), "docs")
    dealt = postings(new.select("key", "text"), "key", "text").select(F.pmod(F.hash("term"), F.lit(BUCKETS)).alias("bucket"), F.pmod(F.hash("key"), F.lit(PLACES)).alias("place"), "term", "key", "tf", F.col("n_terms").alias("n")).repartition("bucket", "place")
    part = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("n") / 256))  # only orders the blocks
    # Most comparisons of the sort end at the first number.
    order = F.shiftleft((F.col("bucket") * PLACES + F.col("place")).cast("long"), 54).bitwiseOR(F.xxhash64("term").bitwiseAND((1 << 54) - 1))
    ranked = dealt.select("*", order.alias("order"), part.alias("part")).sortWithinPartitions("order", "term", F.desc("part"), "key").drop("order", "part")
    blocks = ranked.mapInArrow(_blocks, POSTINGS.format(key=index.key_type).replace("segment int, ", ""))
    blocks.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(root("postings"))
    schema = POSTINGS.format(key=index.key_type).replace(", segment int", "")
    added = spark.read.schema(schema).parquet(root("postings")).groupBy("term").agg(F.sum("n").alias("change"))
    gone = spark.read.schema(f"key {index.key_type}, was int").parquet(root("gone"))
    if segment:
        entries = index.postings().select("term", F.col("segment").alias("was"), F.explode("entries").alias("e")).select("term", "was", F.col("e.key").alias("key"))
        lost = entries.join(gone, ["key", "was"], "left_semi").groupBy("term").agg((-F.count("*")).alias("change"))
        added = added.unionByName(lost).groupBy("term").agg(F.sum("change").alias("change")).where("change <> 0")
    place(added, "df")
    plus = spark.read.schema("n_terms int").parquet(root("docs")).agg(F.count("*").alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("words"))
    minus = dropped.agg(F.count("*").alias("tombstones"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("lost"))
    place(plus.join(minus, F.lit(True)).select((F.col("docs") - F.col("tombstones")).alias("docs"), (F.col("words") - F.col("lost")).alias("words"), "tombstones"), "stats")
    spark.range(1).select(F.lit(segment).alias("segment")).write.mode("append").parquet(f"{index.path}/commits")


def build(docs: DataFrame, path: str, key: str, text: str, language: str | None = None) -> Index:
    """A new index of ``docs``."""
    index = Index(docs.sparkSession, path, docs.schema[key].dataType.simpleString())
    new = _digested(docs, key, text, language)
    _write_segment(index, 0, new, new.select("key", F.lit(0).alias("was"), F.lit(0).alias("n_terms")).where("false"))
    return index


def refresh(index: Index, docs: DataFrame, key: str, text: str, language: str | None = None) -> int:
    """Brings an index up to ``docs`` and gives the new segment's number; documents with the digest they had are not touched."""
    live = index.live()
    new, dropped = refreshed_index(live, _digested(docs, key, text, language), "key", "digest")
    new = stored(new)  # found by a join over all documents, and read for their words and their terms
    segment = max(index.segments()) + 1
    _write_segment(index, segment, new, live.join(dropped, "key", "left_semi").select("key", F.col("segment").alias("was"), "n_terms"))
    return segment


def _bm25(tf: Column, n: Column) -> Column:
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / F.col("mean")))


def search(index: Index, query: str, k: int = 10, languages: list[str] | None = None) -> DataFrame:
    """``key, score`` of the ``k`` best documents by BM25, ties by key; only documents of ``languages`` where given."""
    spark = index.spark
    terms = sorted(set(re.findall(WORD, query.lower())))
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    buckets = [r[0] for r in asked.select(F.pmod(F.hash("term"), F.lit(BUCKETS))).distinct().collect()]  # of the query's terms only
    # Both are a row for each of the query's terms at most.
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    weights = F.broadcast(index.document_counts().where(F.col("term").isin(terms)).join(F.broadcast(index.statistics()), F.lit(True)).select("term", idf, "mean"))
    held = index.postings().where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).join(weights, "term")
    single = "segment", "bucket", "place", "block", "term"
    heads = held.select(*single, _bm25(F.col("most"), F.col("shortest")).alias("bound"))
    best = heads.groupBy("term").agg(F.max("bound").alias("best"))
    total = best.agg(F.sum("best").alias("all"))
    entry = lambda df: df.select(*single, F.col("e.key").alias("key"), _bm25(F.col("e.tf"), F.col("e.n")).alias("part"))
    alive = lambda df: _alive(index, df, languages)
    # The first block of each place and term; a document's best posting there is a score that it reaches.
    first = alive(entry(held.where("block = 0").select("*", F.explode("entries").alias("e"))))
    floor = first.groupBy("key").agg(F.max("part").alias("part")).orderBy(F.desc("part")).limit(k).agg(F.min("part").alias("floor"), F.count("*").alias("found"))
    limits = F.broadcast(floor.join(F.broadcast(total), F.lit(True)).select(F.when(F.col("found") >= k, F.col("floor")).otherwise(0.0).alias("floor"), "all"))
    reaching = held.join(F.broadcast(best), "term").join(limits, F.lit(True)).where((_bm25(F.col("most"), F.col("shortest")) + F.col("all") - F.col("best")) * (1 + 1e-9) >= F.col("floor"))
    scores = alive(entry(reaching.select("*", F.explode("entries").alias("e")))).groupBy("key").agg(F.sum("part").alias("score"))
    return scores.orderBy(F.desc("score"), "key").limit(k)


def _alive(index: Index, found: DataFrame, languages: list[str] | None) -> DataFrame:
    out = found.join(index.gone().select("key", F.col("was").alias("segment")), ["key", "segment"], "left_anti")
    if languages is None:
        return out
    return out.join(index.live().where(F.col("language").isin(languages)).select("key", "segment"), ["key", "segment"], "left_semi")
