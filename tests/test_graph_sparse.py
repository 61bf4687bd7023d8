"""Components and paths of sparse graphs against brute force; rounds grow with the logarithm of a chain."""

import itertools
import random

import pytest

from quarry.operators import graph


def frame(spark, edges):
    return spark.createDataFrame(list(edges), "src long, dst long")


def reached(edges, start):
    out, new = set(), {b for a, b in edges if a == start}
    while new:
        out |= new
        new = {b for a, b in edges if a in new} - out
    return out


def slow_cycles(edges, min_size=2):
    nodes = set(itertools.chain(*edges))
    to = {n: reached(edges, n) for n in nodes}
    parts = {n: {m for m in to[n] if n in to[m]} for n in nodes}
    return {(min(p), n) for n, p in parts.items() if len(p) >= min_size or (p and (n, n) in edges)}


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    edges = {(draw.randrange(40), draw.randrange(40)) for _ in range([25, 45, 60, 90][seed])}
    edges |= {(100 + i, 101 + i) for i in range(12)} | {(112, 100)}  # a ring
    edges |= {(200, 201), (201, 200), (300, 301), (301, 302), (302, 300), (302, 310), (310, 311), (311, 302), (1, 400), (400, 401), (401, 2)}
    assert {(r.component, r.node) for r in graph.cycles(frame(spark, edges)).collect()} == slow_cycles(edges)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 100_000, []
    chain = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
    back = frame(spark, [(30_000, 20_000), (90_000, 89_000)])
    real = graph.jumped

    def counted(c):
        kept = graph.stored
        graph.stored = lambda df: rounds.append(1) or kept(df)
        try:
            return real(c)
        finally:
            graph.stored = kept

    monkeypatch.setattr(graph, "jumped", counted)
    got = graph.cycles(chain.unionByName(back)).groupBy("component").count().collect()
    assert sorted(map(tuple, got)) == [(20_000, 10_001), (89_000, 1_001)]
    assert len(rounds) < 30


def test_doubling_shuffles_once_a_round_and_lets_go_of_what_is_done(spark, monkeypatch):
    edges = {(10 * c + i, 10 * c + i + 1) for c in range(100, 200) for i in range(c % 9)} | {(i, i + 1) for i in range(40)} | {(40, 0)}
    chain = spark.createDataFrame([(b, a, c) for a, b in edges for b2, c in edges if b == b2], "node long, back long, ahead long")
    plans, rows, own = [], [], graph.stored

    def stored(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = own(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "stored", stored)
    got = {r.node: (r.back, r.ahead, r.low, r.open) for r in graph.jumped(chain).collect()}
    ahead, back = dict(edges), {b: a for a, b in edges}
    assert set(got) == set(ahead) & set(back)
    for node, (b, a, low, open_) in got.items():
        assert open_ == (node <= 40)
        assert low == 0 if open_ else b == node // 10 * 10 and a == b + b // 10 % 9
    assert all(p.count("Exchange") <= 1 and "Join" not in p for p in plans)
    assert rows[-1] == 41 < rows[0]  # the ring alone


def slow_path(edges, a, b, hops):
    paths, seen = [[a]], set()
    for _ in range(hops):
        best = {}
        for p in paths:
            for x, y in edges:
                if x == p[-1] and y not in seen:
                    best[y] = min(best.get(y, p + [y]), p + [y])
        if b in best:
            return best[b]
        seen |= set(best)
        paths = list(best.values())
    return None


@pytest.mark.parametrize("seed", range(3))
def test_paths_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    edges = {(i, i + draw.randint(1, 3)) for i in range(40) for _ in range(2)} | {(draw.randrange(40), draw.randrange(40)) for _ in range(4)}
    for a, b in [(0, 30), (0, 41), (5, 5), (0, 1)]:
        want = slow_path(edges, a, b, 12)
        got = graph.shortest_path(frame(spark, edges), spark.createDataFrame([(a, b)], "start long, goal long"), 12).orderBy("position").collect()
        assert ([r.node for r in got] if got[0].found else None) == want, (a, b)
