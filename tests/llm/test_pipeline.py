"""The pipeline's stages, each on its own input."""

import hashlib

import corpus_pipeline as cp
from pyspark.sql import functions as F

from quarry.llm import jaccard_join, toxicity
from quarry.llm.common import stored, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cols = docs.columns
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "mixing", "bpe"]
    clean = stored(cp.drop_toxic(spark, docs, sf_dir))
    scores = toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    assert clean.columns == cols and {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores.where("predicted = 0").collect()}
    lines = stored(cp.drop_lines(spark, clean, sf_dir))
    before = {r.doc_id: r.text for r in clean.collect()}
    kept = [x for r in lines.collect() for x in r.text.split("\n") if len(x) >= 24]
    assert len(kept) == len(set(kept)) and all(len(r.text) <= len(before[r.doc_id]) for r in lines.collect())
    single = stored(cp.drop_near_copies(spark, lines, sf_dir))
    parts = jaccard_join.near_components(lines).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in parts})
    mixed = stored(cp.mix(spark, single, sf_dir))
    assert mixed.columns == cols and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in single.collect()}
    out = cp.encode(spark, mixed, sf_dir).collect()
    texts = {r.doc_id: r.text for r in single.collect()}
    assert len(out) == mixed.count() and all(r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)


def test_run(spark, sf_dir):
    assert cp.run(spark, sf_dir).count() > 0 and cp.ORACLE_SQL is None


AWKWARD = [(None, "no id here at all, only some text", "en", "s", 1), (7, None, "en", "s", 1), (8, "", "en", "s", 1), (9, " \n\t ", "en", "s", 1), (10, "word " * 30_000, "en", "s", 1), (11, "é😀 x", "en", "s", 1), (11, "é😀 x", "en", "s", 1), (12, "short", None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_awkward_rows(spark, sf_dir):
    """Nulls, empty and long texts, repeats, clashing columns and empty tables: every stage keeps its columns and clean rows."""
    df = spark.createDataFrame(AWKWARD, SCHEMA).repartition(3).selectExpr("*", "1 AS score", "2 AS h1", "3 AS root", "4 AS route", "5 AS rate", "6 AS p", "'x' AS ids", "7 AS n_tokens")
    docs = df
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        assert docs.columns == df.columns, name
        kept = {r.doc_id for r in docs.collect()}
        assert kept >= {None, 7, 8, 9, 10, 12}, name
    assert cp.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
    nothing = df.where("false")
    for name, stage in cp.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0, name


def test_near_lines_and_toxic_documents_go(spark, sf_dir):
    """Line dedup drops a line with a replaced word, keeps others, and drops documents that consist of such lines."""
    words = [f"word{i}" for i in range(40)]
    near = [*words[:20], "changed", *words[21:]]
    rows = [(1, "first line of its own\n" + " ".join(words)), (2, " ".join(near)), (3, "a third text that nothing else has\n" + " ".join(near))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.text for r in cp.drop_lines(spark, df, sf_dir).collect()}
    assert got == {1: rows[0][1], 3: "a third text that nothing else has"}
    large = "/root/testdata/sf0.1"  # with enough labels to learn from
    docs, labels = table(spark, large, "documents"), table(spark, large, "labels")
    stored(cp.drop_toxic(spark, docs, large)).createOrReplaceTempView("left_over")
    left = {r.toxic: r.n for r in spark.table("left_over").join(labels, "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    had = {r.toxic: r.n for r in docs.join(labels, "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert left.get(1, 0) <= 0.1 * had[1] and left[0] >= 0.99 * had[0]


def test_run_equals_its_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    assert sorted((r.doc_id, r.ids_sha256) for r in cp.run(spark, sf_dir).collect()) == sorted((r.doc_id, r.ids_sha256) for r in docs.collect())
