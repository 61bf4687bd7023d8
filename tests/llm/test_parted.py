"""Large candidate groups are parted without losing a link; what a job wrote and shuffled goes in time."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import common, jaccard_join, line_dedup
from quarry.session import TIDY


def linked(a, b):
    return 100 * len(a & b) >= 75 * len(a | b)


@pytest.mark.parametrize("common_from", [3, 24])
def test_single_shared_shingles_do_not_hold_a_group_together(spark, monkeypatch, common_from):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard_join, "COMMON", common_from)
    draw = random.Random(5)
    passages = [[f"p{i}w{j}" for j in range(draw.randrange(5, 14))] for i in range(60)]
    texts = []
    for n in range(150):  # passages chain these documents, few of which link
        own = [f"d{n}w{j}" for j in range(draw.randrange(8, 50))]
        texts.append(" ".join(passages[n % 60] + own[: len(own) // 2] + passages[(n + 1) % 60] + own[len(own) // 2 :]))
    for n in range(0, 150, 3):  # some have near copies, at every side of the bound, and copies of copies
        words = texts[n].split()
        for k in range(3):
            words = words[draw.randrange(3) :][: len(words) - draw.randrange(8)] + [f"x{n}k{k}y{i}" for i in range(draw.randrange(4))]
            texts.append(" ".join(words))
    texts += [" ".join(passages[0] + passages[1] + [f"s{i % 20}"]) for i in range(40)]  # of common shingles for the most part
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if linked(sets[a], sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_components(docs).collect()}
    assert got == dict(enumerate(root)) and 100 < len(set(root)) < len(texts) - 100
    head = jaccard_join.heads(docs)
    sizes = head.groupBy("s1", "s2").agg(F.first("n").alias("n")).select(F.expr(f"s1 & {jaccard_join.NODE}").alias("node"), "n")
    whole = sizes.crossJoin(sizes.agg(F.min("node").alias("root"))).select("node", "root")  # as if all had grown together
    parts = {r.node: r.root for r in jaccard_join.parted(docs, whole, sizes).collect()}
    of = {r.doc_id: parts.get(r.s1 & jaccard_join.NODE, -r.doc_id - 1) for r in head.collect()}
    for a in range(len(texts)):
        assert of[a] == of[root[a]] or sets[a] == sets[root[a]]
    if common_from == 24:  # with 3, the passages are common and chain what they are much of
        assert max(Counter(parts.values()).values()) < len(parts) / 4


def test_near_copies_are_not_counted_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    texts = []
    for n in range(120):  # each pair of words of the two places once: ten or twelve copies share each edit
        words = [f"w{i}" for i in range(200)]
        words[20], words[100] = f"a{n % 12}", f"b{n // 12}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    edges, own = [], jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda e: (edges.append(e), own(e))[1])
    sizes = jaccard_join.heads(docs).select(F.expr(f"s1 & {jaccard_join.NODE}").alias("node"), "n")
    whole = sizes.crossJoin(sizes.agg(F.min("node").alias("root"))).select("node", "root")
    parts = jaccard_join.parted(docs, whole, sizes).collect()
    assert len(parts) == 120 and len({r.root for r in parts}) == 1
    assert edges[-1].count() <= 120  # 1,200 pairs before: one for every two copies with an edit in common


def test_shingles_of_the_same_sets_are_paired_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    texts = [" ".join([f"p{n % 4}w{i}" for i in range(60)] + [f"d{n}w{i}" for i in range(40)]) for n in range(12)]  # passages of 56 shingles, each in three
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made, own = [], type(docs).mapInArrow

    def map_in_arrow(self, run, schema, *more):
        out = own(self, run, schema, *more)
        made.extend([out] if "least" in schema else [])
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", map_in_arrow)
    sizes = jaccard_join.heads(docs).select(F.expr(f"s1 & {jaccard_join.NODE}").alias("node"), "n")
    whole = sizes.crossJoin(sizes.agg(F.min("node").alias("root"))).select("node", "root")
    assert jaccard_join.parted(docs, whole, sizes).count() < 12
    rows = made[-1].collect()
    assert len({(r.u, r.v) for r in rows}) == 12 and len(rows) <= 24 < sum(r.n for r in rows)  # a row for each shingle before


def test_scratch_of_inner_steps_is_gone(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    for run, most in ((jaccard_join.near_components, 2), (lambda d: line_dedup.dedup_lines(d, **line_dedup.WHOLE), 1)):
        since = common.scratch_made()
        assert run(docs).count() > 0
        assert common.scratch_made() - since <= most
    assert spark.conf.get(TIDY) == "true"
