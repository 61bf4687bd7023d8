"""Exact top-k lexical search by three rounds of uniform thresholds (TPUT) over posting lists dealt by term.

The lists of the items' terms are stored once, dealt by term (a list over several places) and sorted by what an
occurrence is worth. Then, for all items together:

1. the heads: the best postings of each place of each list. The k-th best sum of an item's heads is a lower bound of its
   k-th best score, from which the threshold is taken; a better one, for weighing candidates, is the k-th best score of the
   ``LOOKED_UP * k`` documents with the best sums;
2. the uniform threshold: from each of an item's m lists, every posting worth at least the bound's m-th part. A
   document that none of them holds has a sum below the bound. A document stays a candidate if the sum of what was fetched, and the
   most that its unseen lists can add, reach the better bound, and the k-th best of those sums;
3. the look-ups: candidates' exact scores over all of the item's lists.

Lists, sums and candidates are only ever joined and grouped by Spark; the driver holds two counts and a bit map of fixed size,
which says what terms may be asked for (an exact join follows). Text is read once. Joins with the items' side are broadcast
only where it is stored and counted to be small; else Spark sorts and splits skewed lists.

Defined results: a null text has no terms; an item without terms, or without a document that scores above 0,
has no rows; rows that repeat a document's or item's id are documents and items of their own, equal scores of one id
in any order, as they are equal; a null id is passed on, last among equal scores; an empty table on either side
gives an empty table. Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Batches, bit_map, in_bit_map, lean, slices, stored

#: Every byte that is not of a term becomes a space, and A-Z become a-z; bytes above 127 are of terms.
TRANSLATION = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Documents that are looked up for the better bound, as multiples of k.
LOOKED_UP = 10
#: Rows of a table that is broadcast: a few MB.
SMALL = 100_000
#: Places of one list in the stored table.
PLACES = 32
FIELDS = [("row", pa.int64()), ("id", pa.int64()), ("term", pa.string()), ("hash", pa.int64()), ("tf", pa.int64()), ("n", pa.int64())]
DDL = "row long, id long, term string, hash long, tf long, n long"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row and term of every occurrence in a string array, in order."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if texts.buffers()[2] else b""
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32).tobytes()), pa.py_buffer(data.translate(TRANSLATION)))
    words = pc.ascii_split_whitespace(plain)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    flat = words.flatten()
    real = pc.not_equal(flat, "")
    return row[real.to_numpy(zero_copy_only=False)], flat.filter(real).dictionary_encode()


def occurrences(rows: DataFrame, id_column: str, bits: np.ndarray | None = None) -> DataFrame:
    """``row, id, term, hash, tf, n`` of each term of a row; a row with a term has one without a term besides.

    With ``bits``, terms whose hash has no bit are left out, but count in ``n``. ``row`` is unique, and stable once stored.
    """
    # 8 MB, however many terms, and far less if they are few. Executors write a broadcast to disk more than once.
    shared = rows.sparkSession.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1)) if bits is not None else None

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        start = (context.partitionId() if context else 0) << 40
        asked = np.frombuffer(zlib.decompress(shared.value), np.uint64) if shared is not None else None
        for piece in slices(batches, 1):
            row, coded = terms_of(piece.column(1).cast(pa.string()))
            n = np.bincount(row, minlength=piece.num_rows)
            known = coded.dictionary.to_pylist()
            hashes = np.fromiter((zlib.crc32(t.encode()) for t in known), np.int64, len(known))
            code = coded.indices.to_numpy(zero_copy_only=False)
            if asked is not None and len(known):
                kept = in_bit_map(asked, hashes)[code]
                row, code = row[kept], code[kept]
            pairs, tf = np.unique((row << 32) | code, return_counts=True)
            code = pairs & 0xFFFFFFFF
            whole = np.flatnonzero(n)
            at = np.concatenate([pairs >> 32, whole])
            term = pa.concat_arrays([coded.dictionary.take(pa.array(code)).cast(pa.string()), pa.nulls(len(whole), pa.string())])
            hashed = pa.concat_arrays([pa.array(hashes[code], pa.int64()), pa.nulls(len(whole), pa.int64())])
            counts = np.concatenate([tf, np.zeros(len(whole), np.int64)])
            out = [pa.array(start + at), piece.column(0).take(pa.array(at)), term, hashed, pa.array(counts), pa.array(n[at])]
            for i in range(0, max(1, len(at)), 1 << 16):
                yield pa.record_batch([c.slice(i, 1 << 16) for c in out], schema=pa.schema(FIELDS))
            start += piece.num_rows

    return rows.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), DDL)


def _small(df: DataFrame) -> DataFrame:
    """A stored table, broadcast when joined if it is counted to have at most ``SMALL`` narrow rows, which Spark can't tell from many small files."""
    kept = stored(df)
    return F.broadcast(kept) if kept.count() <= SMALL else kept


def _kth(sums: DataFrame, k: int, name: str) -> DataFrame:
    """The k-th largest positive ``total`` of each item; items with fewer have none."""
    ranked = sums.where("total > 0").selectExpr("item", "total", "row_number() OVER (PARTITION BY item ORDER BY total DESC, row) AS _place")
    return ranked.where(f"_place <= {k}").where(f"_place = {k}").select("item", F.col("total").alias(name))


def posting_lists(raw: DataFrame, weights: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``term, row, doc_id, worth, head`` of the terms in ``weights``, dealt by term in ``PLACES`` places; the best of a place have ``head`` 1, 2, ..."""
    m = f"(75 + (25 * n * {n_docs}L) DIV {max(1, n_terms)}L)"
    worth = F.expr(f"(1000000000L * tf) DIV (1000L * tf + 12L * {m})").alias("worth")
    lists = raw.where("term IS NOT NULL").join(weights, "term").select("term", "row", F.col("id").alias("doc_id"), worth)
    placed = lists.withColumn("place", F.pmod(F.hash("row"), F.lit(PLACES)))
    return stored(placed.selectExpr("term", "row", "doc_id", "worth", "row_number() OVER (PARTITION BY term, place ORDER BY worth DESC, row) AS head"))


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``k`` best documents."""
    asked = stored(occurrences(items, "item_id")).where("term IS NOT NULL").select(F.col("row").alias("item"), F.col("id").alias("item_id"), "term", "hash", F.col("tf").alias("reps"))
    raw = stored(occurrences(docs, "doc_id", bit_map(asked.select("hash").distinct(), "hash")))
    totals = raw.where("term IS NULL").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(totals[0]), int(totals[1])
    df = raw.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    weight: Column = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).alias("w")
    weights = _small(df.join(asked.select("term").distinct(), "term").select("term", weight).where("w > 0"))
    lists = posting_lists(raw, weights, n_docs, n_terms)

    # 1: the heads. ``one`` is what a unit of worth counts for an item.
    wanted = _small(
        asked.join(weights, "term").selectExpr("item", "item_id", "term", "reps * w AS one").join(lists.groupBy("term").agg(F.max("worth").alias("top")), "term")
    )
    score = F.sum(F.expr("one * worth")).alias("total")
    deep = -(-5 * k // PLACES)
    heads = lists.where(f"head <= {deep}").join(wanted, "term").groupBy("item", "row").agg(score, F.sum(F.expr("CASE WHEN head = 1 THEN one * worth ELSE 0L END")).alias("first"))
    leading = _small(heads.selectExpr("item", "row", "total", "first", "row_number() OVER (PARTITION BY item ORDER BY total DESC, row) AS _place").where(f"_place <= {LOOKED_UP * k}"))
    bound = _kth(leading.selectExpr("item", "row", "first AS total"), k, "bound")
    looked_up = lists.select("row", "term", "worth").join(leading.drop("total", "first", "_place"), "row").join(wanted.drop("item_id", "top"), ["item", "term"])
    floor = _kth(looked_up.groupBy("item", "row").agg(score), k, "floor")

    # 2: the uniform threshold. ``least`` is the least worth to be fetched; what is not fetched adds at most ``more``.
    m = wanted.groupBy("item").agg(F.count("*").alias("m"))
    least = F.expr("greatest(1L, CAST((bound + m * one - 1) DIV (m * one) AS LONG))")
    cuts = wanted.join(m, "item").join(bound, "item", "left").join(floor, "item", "left").na.fill(0, ["bound", "floor"]).withColumn("least", least)
    cuts = _small(cuts.selectExpr("item", "item_id", "term", "one", "least", "one * least(top, least - 1) AS more", "floor"))
    limits = _small(cuts.groupBy("item").agg(F.sum("more").alias("rest"), F.min("floor").alias("floor")))
    # A posting moves once, to its document's task; there it meets the items, and sums of one document and item need no further shuffle.
    lowest = _small(cuts.groupBy("term").agg(F.min("least").alias("lowest")))
    worthy = lists.join(lowest, "term").where("worth >= lowest").drop("lowest").repartition("row")
    fetched = worthy.join(cuts, "term").where("worth >= least")
    sums = fetched.groupBy("item", "row").agg(F.max("doc_id").alias("doc_id"), F.sum(F.expr("one * worth")).alias("total"), F.sum(F.expr("one * worth - more")).alias("above"))
    reaching = stored(sums.join(limits, "item").where("above + rest >= greatest(floor, 1L)").selectExpr("item", "row", "doc_id", "total", "above + rest AS most"))
    candidates = reaching.join(_small(_kth(reaching, k, "better")), "item", "left").where("most >= coalesce(better, 1L)").select("item", "row", "doc_id")

    # 3: the look-ups.
    # Candidates meet their documents' postings by document, so that what is moved is one row for each candidate, not one for each of its terms.
    held = candidates.join(lists.select("row", "term", "worth"), "row")
    exact = held.join(cuts, ["item", "term"])
    scores = exact.groupBy("item", "row").agg(F.max("item_id").alias("item_id"), F.max("doc_id").alias("doc_id"), F.sum(F.expr("one * worth")).alias("score")).where("score > 0")
    ranked = scores.selectExpr("item_id", "row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row) AS rank", "doc_id", "score")
    return ranked.where(f"rank <= {k}")


#: Every document's whole score, then the ranks.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
asked AS (
  SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
totals AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS N, sum(len(terms)) AS L FROM words),
tfs AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM words) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * N + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term, N),
worths AS (
  SELECT d, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(terms) * N) // L::BIGINT)) AS worth FROM tfs JOIN words USING (d), totals),
scores AS (
  SELECT i, item_id, d, sum(reps * w * worth)::BIGINT AS score FROM (SELECT i, item_id, term, count(*) AS reps FROM asked GROUP BY ALL)
  JOIN weights USING (term) JOIN worths USING (term) GROUP BY ALL HAVING sum(reps * w * worth) > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, d)::INT AS rank, doc_id, score FROM scores JOIN words USING (d))
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
