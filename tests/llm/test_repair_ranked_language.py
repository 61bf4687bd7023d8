"""Conversation repair, ranked search and language ID against brute force, SQL, gradients by differences and held-out rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare

from quarry.llm import language, queries, ranked, repair
from quarry.llm.common import table

TURNS = "conv_id long, turn long, role string, text string"

# -- 11 repair -----------------------------------------------------------------------------


def slow_repair(rows):
    """Every script with at most two inserts at a place: the cheapest (cost, audit)."""
    best = None
    options = [(["D"] if r.kind == repair.GOES else ["K", "R", "D"]) for r in rows]
    for edits in itertools.product(*options):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * n + e for n, e in zip(inserts, (*edits, ""), strict=True))
            roles, cost, i = "", 0, 0
            for e in audit:
                cost += {"K": 0, "R": 3, "D": 4, "I": 3}[e]
                if e == "I":
                    roles += "?"
                    continue
                if e != "D":
                    roles += rows[i].initial if e == "K" else "?"
                    cost += 3 * (rows[i].kind == repair.CUT)
                i += 1
            fits = any(len(roles) == len(w) and all(a in ("?", b) for a, b in zip(roles, w, strict=True)) and (w[:1] != "s" or roles[0] == "s") for w in ["", *("ua" * n for n in range(1, 8)), *("s" + "ua" * n for n in range(1, 8))])
            if fits and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_search_equals_all_scripts():
    draw = random.Random(3)
    for _ in range(120):
        rows = [repair.Row(draw.choice("suuaax"), draw.choice([0, 0, 0, 1, 2]), "r", "t") for _ in range(draw.randint(0, 4))]
        assert min(repair.search(rows).values()) == slow_repair(rows), rows


def test_chain_equals_one_search():
    draw = random.Random(4)
    for _ in range(200):
        rows = [repair.Row(draw.choice("suuuaaax"), draw.choice([0, 0, 0, 0, 1, 2]), "r", "t") for _ in range(draw.randint(1, 14))]
        cuts = sorted(draw.sample(range(len(rows) + 1), min(len(rows), 3)))
        pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        ways = [[{"entry": e, "exit": x, "cost": c, "audit": a} for e in repair.NEXT for x, (c, a) in repair.search(p, e, tuple(repair.NEXT), True).items()] for p in pieces]
        cost, path = repair.chain(ways)
        assert (cost, "".join(edits for _, edits in path)) == min(repair.search(rows).values())


def slow_result(turns, broken=True):
    """One conversation's result row by row, with ``search`` for the edits."""
    rows = []
    for conversation, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        by = zlib.crc32(f"{' ' if conversation is None else conversation}:{' ' if turn is None else turn}".encode()) % 20 if broken else 9
        if by == 1:
            text = ""
        if by == 2:
            text = re.sub("[.!?]", "", text)
        rows += [(turn, "user" if by == 4 else role, text)] * (by != 0) * (1 + (by == 3))
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, kinds, counts = set(), [], Counter()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated"
        seen.add((role, text))
        counts[fault] += 1
        kinds.append(repair.Row(role[:1], 1 if fault in ("blank", "duplicate") else 2 * (fault == "truncated"), role, text))
    known = {t for t, _, _ in rows if t is not None}
    cost, audit = min(repair.search(kinds).values())
    text = "\n".join(repair.repaired(kinds, audit)[0])
    illegal = sum(a.initial + b.initial not in repair.LEGAL for a, b in zip(kinds, kinds[1:], strict=False))
    return (max(known) - min(known) + 1 - len(known) if known else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def results(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_repair_oracle(spark, sf_dir):
    compare(spark, "op11_repair", queries.QUERIES["op11_repair"], queries.ORACLES["op11_repair"], sf_dir)


@pytest.mark.parametrize("segment", [1, 3, 1024])
def test_repair_awkward_and_long(spark, segment):
    draw = random.Random(5)
    turns = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "", "no end"), (1, 2, "user", "x" * 300_000 + "!"), (2, 5, "tool", "a."), (2, 5, "tool", "a."), (2, 5, "ask", "b."), (3, 1, "user", " \t\n")]
    turns += [(7, t // 2, draw.choice(["user", "assistant", "system", "us"]), draw.choice(["Yes.", "No", "", f"turn {t}.", f"cut {t}"])) for t in range(400)]
    df = spark.createDataFrame(turns, TURNS).repartition(5).selectExpr("*", "1 AS copies", "2 AS part", "'x' AS audit")
    groups = {c: [t for t in turns if t[0] == c] for c in {t[0] for t in turns}}
    assert results(repair.repairs(repair.damaged(df), segment)) == {c: slow_result(g) for c, g in groups.items()}
    assert results(repair.repairs(repair.undamaged(df), segment)) == {c: slow_result(g, broken=False) for c, g in groups.items()}


def test_repair_of_nothing(spark):
    assert repair.repairs(repair.damaged(spark.createDataFrame([], TURNS))).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"4:{t}".encode()) % 20 == 0)
    got = repair.repairs(repair.damaged(spark.createDataFrame([(4, gone, "user", "Hi.")], TURNS))).first()
    assert tuple(got) == (4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# -- 12 ranked search ----------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in TERM.findall(text or "")]


def slow_ranks(docs, items, k):
    counted = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 75 + (25 * n * n_docs) // max(1, n_terms)
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def test_ranked_oracle(spark, sf_dir):
    compare(spark, "op12_ranked", queries.QUERIES["op12_ranked"], queries.ORACLES["op12_ranked"], sf_dir)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_ranked_equals_brute_force(spark, k):
    draw = random.Random(k)
    vocabulary = ["the"] * 30 + ["of"] * 15 + [f"w{i}" for i in range(60)] + ["É", "naïve", "日本", "A1", "x y"]
    docs = [(i // 2 if i % 9 == 0 else i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 60))), "en", "s", 1) for i in range(150)]
    docs += [(None, "the w1 w2"), (500, None), (501, ""), (502, "... --- !"), (503, "w3 " * 50_000), (504, "The the THE"), (504, "The the THE")]
    docs = [(*d, "en", "s", 1)[:5] for d in docs]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 12)))) for i in range(25)] + [(3, "the"), (None, "w1 w1 w3"), (90, None), (91, "unknown words"), (92, "日本 É é x y a1")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).selectExpr("*", "1 AS term", "2 AS row", "3 AS worth")
    got = ranked.top_documents(df, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS w"), k)
    assert Counter(map(tuple, got.collect())) == slow_ranks([d[:2] for d in docs], items, k)


def test_ranked_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.top_documents(none, some).collect() == [] == ranked.top_documents(some.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id")).collect()


def test_terms_equal_pattern():
    texts = ["A-b C", None, "", "é\x85x \x7f{1}", "日本 text", "a b"]
    row, coded = ranked.terms_of(pa.array(texts, pa.string()).slice(0))
    assert list(zip(row.tolist(), coded.cast(pa.string()).to_pylist(), strict=True)) == [(i, w) for i, t in enumerate(texts) for w in words(t)]
    row, coded = ranked.terms_of(pa.array(texts, pa.string()).slice(3, 2))
    assert coded.cast(pa.string()).to_pylist() == words(texts[3]) + words(texts[4])


# -- 13 language ---------------------------------------------------------------------------


def test_gradients_equal_differences():
    draw = np.random.default_rng(2)
    net = language.Network.fresh(["a", "b", "c"], 3, 1)
    for name in ("inputs", "recurrent", "outputs", "biases"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    codes = draw.integers(0, 256, (9, 4)).astype(np.intp)
    codes[6:, 1] = language.PAD
    codes[1:, 2] = language.PAD
    labels = np.array([0, 2, 1, 1])
    kept = language.np.float32
    try:
        language.np.float32 = np.float64  # the arrays of a step take the weights' type
        _, grads = language.gradients(net, codes, labels)
        for weight, grad in zip([net.inputs, net.recurrent, net.outputs, net.biases], grads, strict=True):
            for at in [tuple(draw.integers(0, n) for n in weight.shape) for _ in range(40)] + [(0, 1, int(codes[0, 0]))] * (weight.ndim == 3 and weight.shape[2] == 257):
                if weight.shape[-1] == 257 and at[2] == language.PAD:
                    continue
                was, losses = weight[at], []
                for step in (1e-5, -1e-5):
                    weight[at] = was + step
                    losses.append(language.gradients(net, codes, labels)[0])
                weight[at] = was
                assert grad[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=2e-6)
    finally:
        language.np.float32 = kept


def slow_probabilities(net, text):
    """Positions' probabilities of one text, window by window, one byte at a time."""
    h, out = net.recurrent.shape[2], []
    sigmoid = lambda x: 1 / (1 + np.exp(-x.astype(np.float64)))
    for i in range(0, len(text), language.WINDOW):
        window = text[i : i + language.WINDOW]
        both = []
        for d in range(2):
            state, states = np.zeros(h), []
            for b in window if d == 0 else window[::-1]:
                x, u = net.inputs[d, :, b], net.recurrent[d] @ state
                update, reset = sigmoid(x[:h] + u[:h]), sigmoid(x[h : 2 * h] + u[h : 2 * h])
                state = update * state + (1 - update) * np.tanh(x[2 * h :] + reset * u[2 * h :])
                states.append(state)
            both.append(states if d == 0 else states[::-1])
        for a, b in zip(*both, strict=True):
            e = np.exp(net.outputs @ np.concatenate([a, b]) + net.biases)
            out.append(e / e.sum())
    return np.array(out)


def test_pooled_equals_byte_by_byte():
    draw = random.Random(1)
    net = language.Network.fresh(["a", "b", "c"], 4, 3)
    texts = [bytes(draw.randrange(256) for _ in range(n)) for n in (1, 127, 128, 129, 700, 0)]
    got = net.pooled(texts)
    for t, g in zip(texts, got, strict=True):
        assert np.allclose(g, slow_probabilities(net, t).mean(axis=0) if t else 0, atol=1e-4)


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = queries.QUERIES["op13_language"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_language_awkward(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, ["abc abd bca " * 20, "xyz zzy yxx " * 20][k % 2], ["one", "two"][k % 2]) for k, i in enumerate(ids)]
    rows += [(None, "abc abd", "one"), (201, None, "one"), (202, "", "two"), (203, "12 34 !?", None), (204, "xyz zzy " * 40_000, None), (204, "xyz zzy " * 40_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).selectExpr("*", "1 AS score", "'q' AS lang_pred", "2 AS letter")
    net = language.train(docs, steps=60)
    got = [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in language.predict(docs, net).collect()]
    said = {i: (p, s) for i, _, p, s in got}
    assert len(got) == len(rows) and said[201] == said[202] == said[203] == ("und", 0.0)
    assert said[204][0] == "two" and said[None][0] == "one" and len({x for x in got if x[0] == 204}) == 1
    assert np.mean([said[i][0] == lang for i, _, lang in rows[: len(ids)]]) == 1
    assert next(h for i, h, _, _ in got if i is None)
    nothing = docs.where("false")
    assert language.predict(nothing, language.train(nothing)).collect() == []
    assert {r.lang_pred for r in language.predict(docs, language.train(nothing)).collect()} == {"und"}
    alone = language.train(docs.where("lang = 'one'"))
    assert alone.languages == ["one"] and {r.lang_pred for r in language.predict(docs, alone).collect()} == {"one", "und"}
