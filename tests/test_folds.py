"""Folds over keys of any length against plain loops."""

import random
import time

from quarry.streaming import expiry, folds


def test_fold_equals_loop(spark):
    draw = random.Random(1)
    rows = [(draw.choice([None, "a", "b", "c"]), i, draw.choice([None, 1, 5, 30])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, at long, n long").repartition(7)
    got = {r.at: (r.used_bytes, r.used_items, r.accepted) for r in expiry.quota(df, "k", "n", "at", max_bytes=90, max_items=20).collect()}
    used: dict = {}
    for k, at, n in rows:
        b, i = used.get(k, (0, 0))
        fits = n is not None and b + n <= 90 and i < 20
        used[k] = (b + n, i + 1) if fits else (b, i)
        assert got[at] == (*used[k], fits)
    assert expiry.quota(df.where("false"), "k", "n", "at").collect() == []
    seen = folds.sorted_fold(df, ["k"], ["at"], ["n"], lambda: 0, lambda s, n: (s + 1, (s,)), "place int")
    assert seen.columns == ["k", "at", "n", "place"] and seen.where("place = 0").count() == 4


def test_a_session_of_a_million_items(spark):
    df = spark.range(1_000_000).selectExpr("'s' AS session", "id AS at", "id % 7 AS size")
    began = time.perf_counter()
    last = expiry.quota(df, "session", "size", "at", max_bytes=1 << 40, max_items=900_000).orderBy("at", ascending=False).first()
    assert (last.used_items, last.accepted) == (900_000, False) and last.used_bytes == sum(i % 7 for i in range(900_000))
    assert time.perf_counter() - began < 30
