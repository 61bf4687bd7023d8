"""The stored index: refreshed equal to rebuilt, equal to scores from texts, and reading only what a query needs."""

import math
import random
import re
from collections import Counter

import pytest

from quarry.operators import index, search
from quarry.operators.shared import fresh_path

WORDS = [f"w{i}" for i in range(40)] + ["the"] * 40


def texts(seed, n):
    draw = random.Random(seed)
    return {i: " ".join(draw.choices(WORDS, k=draw.randint(0, 80))) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en" if i % 3 else "de") for i, t in docs.items()], "id long, text string, lang string").repartition(3)


def slow(docs, query, k, only=lambda i: True):
    bags = {i: Counter(re.findall("[a-z0-9_]+", (t or "").lower())) for i, t in docs.items()}
    mean = sum(map(Counter.total, bags.values())) / len(bags)
    out = []
    for i, b in bags.items():
        s = 0.0
        for t in set(re.findall("[a-z0-9_]+", query.lower())):
            df = sum(t in x for x in bags.values())
            if b[t]:
                s += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * b.total() / mean))
        if s and only(i):
            out.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def found(ix, query, k, languages=None):
    return [(r.key, round(r.score, 9)) for r in index.search(ix, query, k, languages).collect()]


def test_refreshes_equal_rebuilds(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 4)
    now = texts(1, 300)
    ix = index.build(frame(spark, now), fresh_path(spark), "id", "text", "lang")
    for step in range(3):
        changed = texts(10 + step, 300)
        now = {i: changed[i % 300] if i % 10 == step else t for i, t in now.items() if i % 10 != 5 + step} | {1000 * (step + 1) + i: changed[i] for i in range(20)}
        segment = index.refresh(ix, frame(spark, now), "id", "text", "lang")
        assert segment == step + 1
        again = index.build(frame(spark, now), fresh_path(spark), "id", "text", "lang")
        assert sorted(ix.document_counts().collect()) == sorted(again.document_counts().collect())
        assert tuple(ix.statistics().first())[:3] == tuple(again.statistics().first())[:3]
        assert {r.key for r in ix.live().collect()} == set(now)
    for query in ("w1", "the w2 w3", "the", "w5 w6 w7 the", "nothing", ""):
        assert found(ix, query, 10) == found(again, query, 10) == slow(now, query, 10), query
        assert found(ix, query, 5, ["de"]) == slow(now, query, 5, lambda i: i % 3 == 0)
    # What did not change is in its first segment still.
    assert ix.live().where("segment = 0").count() > 100 and index.refresh(ix, frame(spark, now), "id", "text", "lang") == 4
    assert ix._read("docs", "key bigint, segment int").where("segment = 4").count() == 0 == ix.gone().where("segment = 4").count()


def test_equal_to_scores_from_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ix = index.build(docs, fresh_path(spark), "doc_id", "text")
    query = "the license agreement of this"
    want = search.bm25(docs, "doc_id", "text", query).orderBy("score", ascending=False).limit(10).collect()
    assert [round(s, 9) for _, s in found(ix, query, 10)] == [round(r.score, 9) for r in want]


def test_reads_only_the_buckets_and_segments_asked_for(spark):
    ix = index.build(frame(spark, texts(3, 100)), fresh_path(spark), "id", "text")
    plan = index.search(ix, "w1 w2")._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "/postings" in line]
    assert scans and all(re.search(r"PartitionFilters: \[.*bucket#\d+ IN \(", line) for line in scans)
    assert any("struct<term:string" in line and "entries" not in line.split("ReadSchema")[1] for line in scans)  # headers without entries


def test_an_uncommitted_segment_is_not_seen(spark, monkeypatch):
    now = texts(4, 50)
    ix = index.build(frame(spark, now), fresh_path(spark), "id", "text")
    before = found(ix, "w1 the", 5)
    real = index.postings
    monkeypatch.setattr(index, "postings", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.refresh(ix, frame(spark, texts(5, 50)), "id", "text")
    monkeypatch.setattr(index, "postings", real)
    assert found(ix, "w1 the", 5) == before and ix.segments() == [0]
    index.refresh(ix, frame(spark, texts(5, 50)), "id", "text")
    assert found(ix, "w1 the", 5) == slow(texts(5, 50), "w1 the", 5)


def test_nulls_and_nothing(spark):
    ix = index.build(frame(spark, {1: None, 2: "", 3: "a b", 4: "b"}), fresh_path(spark), "id", "text")
    assert [k for k, _ in found(ix, "a b", 3)] == [3, 4] and ix.statistics().first().docs == 4
    index.refresh(ix, frame(spark, {7: "x"}).where("false"), "id", "text")
    assert found(ix, "a b", 3) == [] and ix.statistics().first().docs == 0


def test_blocks_are_whole_across_batches(spark, tmp_path, monkeypatch):
    texts = [(i, " ".join(["all"] * (1 + i % 5) + [f"w{i % 3}"] * (i % 2) + ["rest_9", "Ünï-x"] * (i % 4))) for i in range(3000)] + [(9000, None), (9001, "ALL K İx")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    monkeypatch.setattr(search, "TEXTS", 7)
    spark.conf.set(key, "50")  # less than a block
    try:
        built = index.build(docs, str(tmp_path / "index"), "id", "text")
    finally:
        spark.conf.set(key, was)
    rows = built.postings().collect()
    want = {}
    for i, t in docs.selectExpr("id", "lower(coalesce(text, ''))").collect():
        words = re.findall(r"[a-z0-9_]+", t)
        for w in words:
            want[w, i] = (words.count(w), len(words))
    assert {(r.term, e.key): (e.tf, e.n) for r in rows for e in r.entries} == want
    assert sum(len(r.entries) for r in rows) == len(want)
    lists = {}
    for r in rows:
        assert r.n == len(r.entries) and r.most == max(e.tf for e in r.entries) and r.shortest == min(e.n for e in r.entries)
        lists.setdefault((r.term, r.place), {})[r.block] = r.entries
    assert max(map(len, lists.values())) > 2
    for blocks in lists.values():
        assert sorted(blocks) == list(range(len(blocks))) and all(len(blocks[b]) == index.BLOCK for b in range(len(blocks) - 1))
        part = [e.tf / (e.tf + 1.2 * (0.25 + 0.75 * e.n / 256)) for b in sorted(blocks) for e in blocks[b]]
        assert part == sorted(part, reverse=True)
    assert {(r.key, r.n_terms) for r in built.live().collect()} == {(i, next((n for (_, k), (_, n) in want.items() if k == i), 0)) for i, _ in texts}
