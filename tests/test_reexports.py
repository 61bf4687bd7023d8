"""Surfaces through chains of re-exports against a slow closure."""

import random

import pytest

from quarry.operators import reexports
from quarry.plans import catalogue


def slow(defined, exports, depth):
    own = defined | {(m, n) for m, n, _, _ in exports if n}
    best = {(m, n, m, n): 0 for m, n in defined}
    for hop in range(1, depth + 1):
        new = {}
        for m, n, om, on in [k for k, h in best.items() if h == hop - 1]:
            for to, name, source, source_name in exports:
                if source == m and (source_name == n or (source_name is None and (to, n) not in own)):
                    key = (to, name or n, om, on)
                    if key not in best:
                        new[key] = hop
        best |= new
    many = {}
    for m, n, *_ in best:
        many[m, n] = many.get((m, n), 0) + 1
    return {(*k, h, many[k[:2]] > 1) for k, h in best.items()}


@pytest.mark.parametrize("seed", range(3))
def test_surface_equals_slow_closure(spark, seed):
    draw = random.Random(seed)
    defined = {(f"m{draw.randrange(12)}", draw.choice("abcd")) for _ in range(12)}
    exports = {(f"m{draw.randrange(12)}", None, f"m{draw.randrange(12)}", None) for _ in range(12)} | {(f"m{draw.randrange(12)}", draw.choice("abcde"), f"m{draw.randrange(12)}", draw.choice("abcd")) for _ in range(8)}
    exports |= {("r1", None, "r2", None), ("r2", None, "r3", None), ("r3", None, "r1", None)}  # a ring
    defined |= {("r1", "x"), ("r2", "y"), ("r3", "x")}
    d = spark.createDataFrame([*defined, ("m1", None), (None, "a"), *list(defined)[:2]], "module string, name string")
    e = spark.createDataFrame([*exports, (None, "a", "m1", "a"), ("m1", "a", None, "a"), ("m1", "half", "m2", None)], "module string, name string, source string, source_name string")
    for depth in (16, 1):
        got = {(r.module, r.name, r.origin, r.origin_name, r.hops, r.ambiguous) for r in reexports.surface(d, e, depth).collect()}
        assert got == slow(defined, exports, depth)


def test_long_chain_and_nothing(spark):
    d = spark.createDataFrame([(0, "a")], "module long, name string")
    e = spark.createDataFrame([(i + 1, f"n{i + 1}", i, f"n{i}" if i else "a") for i in range(20)], "module long, name string, source long, source_name string")
    assert sorted((r.module, r.name, r.hops) for r in reexports.surface(d, e).collect())[-1] == (16, "n16", 16)
    assert reexports.surface(d.where("false"), e).collect() == []


def test_rounds_broadcast_nothing(spark, monkeypatch):
    joins, own = [], reexports.stored

    def stored(df):
        joins.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df)

    monkeypatch.setattr(reexports, "stored", stored)
    d = spark.range(40).selectExpr("id AS module", "'a' AS name")
    e = spark.range(1, 40).selectExpr("id AS module", "CAST(NULL AS STRING) AS name", "id DIV 2 AS source", "CAST(NULL AS STRING) AS source_name")
    found = reexports.surface(d, e)
    assert found.count() == 40
    joins.append(found._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in joins if "BroadcastHashJoin" in p or "BroadcastExchange" in p]
    assert "SortMergeJoin" in joins[-1]


def test_chains_without_a_bound(spark, monkeypatch):
    monkeypatch.setattr(reexports, "ROUNDS", 4)
    defined = {("m0", "a"), ("r1", "a"), ("r2", "b")}
    exports = {(f"m{i + 1}", None, f"m{i}", None) if i % 3 else (f"m{i + 1}", "a", f"m{i}", "a") for i in range(18)}
    exports |= {("r1", None, "r2", None), ("r2", None, "r1", None), ("m0", None, "r1", None)}
    d = spark.createDataFrame(list(defined), "module string, name string")
    e = spark.createDataFrame(list(exports), "module string, name string, source string, source_name string")
    got = {(r.module, r.name, r.origin, r.origin_name, r.hops, r.ambiguous) for r in reexports.surface(d, e, None).collect()}
    assert got == slow(defined, exports, 99)
    assert max(r[4] for r in got) == 18


def test_query_follows_chains_of_any_length(spark, tmp_path):
    keys = [3 << i for i in range(21)]  # each takes on all names of its half
    spark.createDataFrame([(k, f"b{i}") for i, k in enumerate(keys)], "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = [(r.module, r.name, r.origin, r.hops) for r in catalogue.QUERIES["surface_reexports"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((k, f"b{j}", keys[j], i - j) for i, k in enumerate(keys) for j in range(i + 1))
