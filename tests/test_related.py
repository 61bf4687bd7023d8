"""Chunks and the vector index against brute force; recall of the coded search."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import related
from quarry.operators.shared import fresh_path


def test_chunks_are_line_spans(spark):
    docs = spark.createDataFrame([("a", "\n".join(map(str, range(1, 46)))), ("b", ""), ("c", None), ("d", "x\n")], "path string, body string")
    got = {(r.file, r.start): (r.end, r.text) for r in related.chunks(docs, "path", "body", 20).collect()}
    assert got["a", 1][0] == 20 and got["a", 21][0] == 40 and got["a", 41] == (45, "41\n42\n43\n44\n45")
    assert got["b", 1] == got["c", 1] == (1, "") and got["d", 1] == (2, "x\n") and len(got) == 6


def brute(rows, wanted, k):
    rows, wanted = {i: np.array(v, float) for i, v in rows.items() if v is not None and np.any(v)}, np.array(wanted, float)
    scores = sorted((-round(float(v @ wanted / np.linalg.norm(v) / np.linalg.norm(wanted)), 6), i) for i, v in rows.items())
    return [i for _, i in scores[:k]]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")


def test_recall_and_exact_fallback(spark, vectors, monkeypatch):
    monkeypatch.setattr(related, "LIST_ROWS", 64)  # 31 lists of 2000 vectors
    index = related.build(vectors, fresh_path(spark), ("vec_id",), "embedding")
    assert index.rows().count() == 2000 and 20 < len(index.centroids) <= 31 and 1 < index.probes < 31
    queries = vectors.where("vec_id % 100 = 0").selectExpr("vec_id AS query", "embedding AS vector")
    rows = {r.vec_id: r.embedding for r in vectors.collect()}
    want = {i: brute(rows, rows[i], 10) for i in rows if i % 100 == 0}
    for exact in (False, True):
        got = {}
        for r in related.search(index, queries, 10, exact=exact).collect():
            got.setdefault(r.query, []).append(r.vec_id)
        recall = np.mean([len(set(got[i]) & set(w)) / 10 for i, w in want.items()])
        assert recall == 1 if exact else recall >= 0.9, recall
    plan = related.search(index, queries.limit(1), 10, probes=2)._jdf.queryExecution().toString()
    assert "list#" in plan.split("PartitionFilters")[1].split("]")[0]


def test_related_chunks_of_a_line(spark):
    draw = np.random.default_rng(1)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(6)]
    docs = [(f"f{n}", "\n".join(" ".join(draw.choice(topics[(n + c) % 6], 8)) for c in range(3) for _ in range(5))) for n in range(60)]
    chunked = related.chunks(spark.createDataFrame(docs, "path string, body string").repartition(3), "path", "body", 5)
    index = related.build(related.embedded(chunked), fresh_path(spark), ("file", "start", "end"))
    rows = {(r.file, r.start, r.end): list(map(float, v)) for r, v in [(r, related.word_vectors(pa.array([r.text]))[0]) for r in chunked.collect()]}
    for file, line, start in (("f0", 1, 1), ("f7", 10, 6), ("f59", 15, 11)):
        own = (file, start, start + 4)
        want = [i for i in brute(rows, rows[own], 11) if i != own][:10]
        got = [(r.file, r.start, r.end) for r in related.find_related(index, file, line, exact=True).collect()]
        assert got == want and {(int(f[1:]) + s // 5) % 6 for f, s, _ in got} == {(int(file[1:]) + start // 5) % 6}
        near = [(r.file, r.start, r.end) for r in related.find_related(index, file, line).collect()]
        assert len(set(near) & set(want)) >= 9
    assert related.find_related(index, "f0", 99).collect() == [] == related.find_related(index, "none", 1).collect()


def test_nothing_and_zero_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], "id long, vector array<float>")
    index = related.build(df, fresh_path(spark), ("id",))
    assert [r.id for r in related.search(index, df.selectExpr("id AS query", "vector"), 5).collect()] == [3]
    empty = related.build(df.where("false"), fresh_path(spark), ("id",))
    assert related.search(empty, df.selectExpr("id AS query", "vector"), 5).collect() == []
    with pytest.raises(ValueError):
        related.search(index, spark.range(2000).selectExpr("id AS query", "array(1.0, 2.0) AS vector"))


def test_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(related, "QUERIES", 60)
    monkeypatch.setattr(related, "TUNED", 8)
    draw = np.random.default_rng(4)
    rows = {i: draw.normal(size=8).tolist() for i in range(90)}
    df = spark.createDataFrame(list(rows.items()), "id long, vector array<float>")
    index = related.build(df, fresh_path(spark), ("id",))
    asked = df.selectExpr("id AS query", "vector")
    got = {}
    for r in related.search_all(index, asked, 5, exact=True).orderBy("query", "score", ascending=[True, False]).collect():
        got.setdefault(r.query, []).append(r.id)
    assert got == {i: brute(rows, rows[i], 5) for i in rows}
    assert related.search_all(index, asked, 5).count() == 450


def test_a_list_is_one_file_and_a_large_one_several(spark, monkeypatch):
    monkeypatch.setattr(related, "LIST_ROWS", 64)
    monkeypatch.setattr(related, "FILE_ROWS", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join these few rows
    draw = np.random.default_rng(5)
    rows = {i: ([1.0, 0.0, 0.0, 0.0] if i < 600 else draw.normal(size=4).tolist()) for i in range(1000)}
    index = related.build(spark.createDataFrame(list(rows.items()), "id long, vector array<double>"), fresh_path(spark), ("id",))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {r.list: (r.files, r.n) for r in index.rows().selectExpr("list", "input_file_name() AS f").groupBy("list").agg(F.countDistinct("f").alias("files"), F.count("*").alias("n")).collect()}
    assert sum(n for _, n in files.values()) == 1000
    assert all(f <= -(-n // 100) for f, n in files.values()) and max(n for _, n in files.values()) >= 600 and max(f for f, _ in files.values()) >= 3, files
    got = related.search(index, spark.createDataFrame([(0, rows[700])], "query long, vector array<double>"), 5, exact=True)
    assert [r.id for r in got.orderBy(F.desc("score"), "id").collect()] == brute(rows, rows[700], 5)


def test_vectors_are_normed_as_they_are(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, []), (6, [1e-30, 0.0]), (7, [nan, 1.0])], "id long, vector array<double>").coalesce(1)
    got = {r.id: r.vector for r in related.normed(df, ("id",), "vector").collect()}
    assert got[1] == [np.float32(0.6), np.float32(0.8)] and got[6] == [1.0, 0.0] and set(got) == {1, 6, 7} and np.isnan(got[7]).all()
    whole = spark.createDataFrame([(1, [3, 4])], "id long, vector array<int>")
    assert related.normed(whole, ("id",), "vector").first().vector == [np.float32(0.6), np.float32(0.8)]


def test_a_chunk_is_cut_before_it_is_a_row(spark):
    plan = related.chunks(spark.createDataFrame([("a", "x")], "path string, body string"), "path", "body")._jdf.queryExecution().optimizedPlan().toString()
    made = plan[: plan.index("Generate")]
    assert "array_join" not in made and "slice" not in made, plan
