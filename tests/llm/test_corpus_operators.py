"""The corpus operators against brute force, round trips and held-out rows, and on awkward inputs."""

import base64
import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe, chat, components, fingerprints, html_extract, jaccard_join, line_dedup, media, mixing, queries, toxicity, warc
from quarry.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [(None, "no id here at all, only some text", "en", "s", 1), (7, None, "en", "s", 1), (8, "", "en", "s", 1), (9, " \n\t ", "en", "s", 1), (10, "word " * 30_000, "en", "s", 1), (11, "é😀 x", "en", "s", 1), (11, "é😀 x", "en", "s", 1), (12, "short", None, None, None)]


def awkward(spark, rows=AWKWARD):
    """Null ids and texts, empty, blank and long texts, repeats, and columns whose names operators use."""
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.selectExpr("*", "1 AS score", "2 AS h1", "3 AS root", "4 AS bucket", "5 AS rate", "6 AS p", "'x' AS ids")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- 1 fingerprints ------------------------------------------------------------------------


def test_fingerprints_query(spark, sf_dir):
    docs = [(r.doc_id, r.text or "") for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in queries.op1_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (i, t), (_, nxt) in zip(docs, docs[1:] + docs[:1], strict=True):
        edited = fingerprints.edit(t, nxt)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        own, ed, after = fingerprints.sketches([t]) + fingerprints.sketches([edited]) + fingerprints.sketches([nxt])
        assert got[i].fingerprint == fingerprints.as_string(own)
        assert got[i].near_edited == pytest.approx(fingerprints.likeness(own, ed)) and got[i].near_next == pytest.approx(fingerprints.likeness(own, after))
    long = [got[i] for i, t in docs if len(t) > 500]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97


M = (1 << 64) - 1


def slow_mix(x):
    x = (x + 0x9E3779B97F4A7C15) & M
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M
    return x ^ x >> 31


def slow_coin(left, own, bits):
    """Twice the lowest bit in which own differs from left, plus that bit of own."""
    differ = [i for i in range(bits) if (left >> i ^ own >> i) & 1]
    i = differ[0] if differ else 0
    return 2 * i + (own >> i & 1)


def slow_sketch(text):
    """A text's smallest name hashes by group, one symbol at a time."""
    names, found, level = [ord(c) for c in text], [set() for _ in fingerprints.GROUPS], 0
    while names:
        level += 1
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [x if n == 1 else slow_mix(x ^ n * 0xBF58476D1CE4E5B9 & M) for x, n in runs]
        label = [slow_coin(names[i - 1] if i else x ^ M, x, 64) for i, x in enumerate(names)]
        for bits in (7, 4, 3):
            label = [slow_coin(label[i - 1] if i else x ^ 1, x, bits) for i, x in enumerate(label)]
        n = len(names)
        starts = [i for i in range(n) if not i or (2 <= i < n - 1 and label[i] > label[i - 1] and label[i] >= label[i + 1])]
        blocks = [names[a:b] for a, b in zip(starts, [*starts[1:], n])]
        names = [slow_mix(sum(slow_mix(x) * (slow_mix(1 + k % 64) | 1) for k, x in enumerate(b)) & M ^ level) for b in blocks]
        if level >= fingerprints.GROUPS[0]:
            found[min(level - fingerprints.GROUPS[0], len(found) - 1)] |= {x >> 32 for x in names}
            if len(names) == 1:
                break
    return [sorted(f)[:k] for f, k in zip(found, fingerprints.KEPT)]


def test_sketches_equal_slow_parser(spark, sf_dir):
    rng = random.Random(8)
    texts = [r.text or "" for r in table(spark, sf_dir, "documents").orderBy("doc_id").limit(25).collect()]
    texts = [t[:4000] for t in texts] + ["", "a", "aa", "ab", "aaaa", "é😀 x", "ab" * 40] + ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    for t, s in zip(texts, fingerprints.sketches(texts)):
        assert [x.tolist() for x in s] == slow_sketch(t), t[:40]


def test_interior_names_do_not_depend_on_offset():
    rng = random.Random(2)
    text = "".join(rng.choice(string.ascii_lowercase + " ") for _ in range(4000))
    a, b = fingerprints.sketches([text, "some prefix " + text])
    assert fingerprints.likeness(a, b) > 0.9
    assert fingerprints.likeness(a, fingerprints.sketches([text[::-1]])[0]) < 0.1
    assert fingerprints.likeness(*fingerprints.sketches(["", ""])) == 1 and fingerprints.likeness(*fingerprints.sketches(["", "a"])) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n", max_size=60), min_size=1, max_size=6))
def test_texts_are_parsed_alone(texts):
    together = fingerprints.sketches(texts)
    for t, s in zip(texts, together, strict=True):
        alone = fingerprints.sketches([t])[0]
        assert fingerprints.as_string(alone) == fingerprints.as_string(s)
        assert fingerprints.from_string(fingerprints.as_string(s))[0].tolist() == s[0].tolist()


def test_fingerprints_awkward(spark):
    got = fingerprints.edited_fingerprints(awkward(spark), rows=2).collect()
    assert len(got) == len(AWKWARD) and {r.fingerprint for r in got if r.n_chars == 0} == {"-"}
    assert len({r.fingerprint for r in got if r.doc_id == 11}) == 1
    assert fingerprints.edited_fingerprints(empty(spark)).count() == 0
    assert fingerprints.fingerprints(awkward(spark)).count() == len(AWKWARD)


# -- 2 byte-level BPE ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    path, pattern = bpe.public_vocabulary()
    return bpe.Codec(bpe.ranks_from_lines(bpe.vocabulary(path).decode().splitlines()), pattern)


@pytest.fixture(scope="module")
def reference_encoder():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list(" \n\t'slre_!9  \x1c\x85漢é🙂½٣")), st.characters(codec="utf-8")), max_size=40))
def test_bpe_equals_library(codec, reference_encoder, text):
    ids = codec.encode(text)
    assert ids == reference_encoder.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_long_piece(codec, reference_encoder):
    text = "ab" * 40_000 + "xyz" * 5000
    assert codec.encode(text) == reference_encoder.encode_ordinary(text)


def test_array_trees_equal_single_trees(codec):
    rng = random.Random(4)
    pieces = [bytes(rng.randrange(256) for _ in range(rng.randint(1, 64))) for _ in range(400)]
    assert bpe.merge_many(pieces, codec.ranks, codec.pairs) == [bpe.merge_piece(p, codec.ranks) for p in pieces]


def test_bpe_query_and_awkward(spark, sf_dir, reference_encoder):
    got = {r.doc_id: r for r in queries.op2_bpe(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        ids = reference_encoder.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    where = bpe.public_vocabulary()
    assert bpe.round_trip(awkward(spark), *where).count() == len(AWKWARD) and bpe.round_trip(empty(spark), *where).count() == 0
    back = {r.doc_id: bytes(r.content).decode() for r in bpe.decode(bpe.encode(awkward(spark), *where), *where).collect()}
    assert back[10] == "word " * 30_000 and back[7] == ""


# -- 3 WARC --------------------------------------------------------------------------------


def expected_records(pages, least=1000):
    best = {}
    for i, h in pages:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            best[b] = max(best.get(b, i), i)
    for i, h in pages:
        b = (h or "").encode()
        to = best.get(b) if len(b) >= least else None
        yield (i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None or to == i else "revisit", None if to is None or to == i else to)


def test_warc_query(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in table(spark, sf_dir, "pages").collect()]
    got = sorted(tuple(r)[:5] for r in queries.op3_warc(spark, sf_dir).collect())
    assert got == sorted(expected_records(pages))


def test_warc_revisits_and_awkward(spark, tmp_path):
    big, other = "<p>" + "x" * 1200, "<i>\r\n\r\nWARC/1.1\r\n" + "y" * 1100 + "é"
    pages = [(i, big) for i in range(40)] + [(100 + i, other) for i in range(3)] + [(200, "small"), (201, "small"), (202, None), (203, ""), (None, big), (204, "z" * 999), (205, "z" * 999)]
    df = spark.createDataFrame([(i, "http://a/\r\nb" if i == 1 else None, h, 1, 2) for i, h in pages], "page_id long, url string, html string, digest int, value int")
    got = sorted((tuple(r)[:5] for r in warc.archived(df).collect()), key=str)
    assert got == sorted(expected_records(pages), key=str)
    warc.write_archives(df, str(tmp_path / "w"))
    full = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w"), payload=True).collect()}
    assert bytes(full[102].payload).decode() == other and full[100].payload is None and full[1].url == "http://a/b"
    assert warc.archived(df.where("false")).count() == 0


def test_warc_oracle_and_classes(spark, sf_dir, tmp_path):
    from oracle import compare

    compare(spark, "op3_warc", queries.op3_warc, warc.ORACLE, sf_dir)
    pages = [(i, "u", "s" * n) for i, n in enumerate([5, 1 << 16, (1 << 16) + 1, 1 << 20, 3 << 20, 12 << 20])] + [(9, "u", "s" * (3 << 20))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {i: (len(h), "revisit" if i == 4 else "response") for i, _, h in pages}
    assert len(list((tmp_path / "w").iterdir())) == 3


def test_warc_parser_over_any_cuts():
    data = b"".join(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n%s\r\n\r\n" % (19 + len(p), p) for p in (b"a\r\n\r\nb", b"", b"x" * 50))
    for step in (1, 3, 7, 1000):
        assert [p for _, _, p in warc.parse(iter([data[i : i + step] for i in range(0, len(data), step)]))] == [b"a\r\n\r\nb", b"", b"x" * 50]
    with pytest.raises(ValueError, match="inside"):
        list(warc.parse(iter([data[:-10]])))


# -- 4 mixing ------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    sf_dir = "/root/testdata/sf0.1"
    m = queries.op4_mixing(spark, sf_dir).toPandas()
    assert len(m) == table(spark, sf_dir, "documents").count() and (m.rate >= 0).all()
    total = m.n_tokens.sum()
    for domain, share in mixing.WEIGHTS.items():
        assert (m.rate * m.n_tokens * m[f"p_{domain}"]).sum() / total == pytest.approx(share, abs=1e-4)
    assert ((m.copies - m.rate).abs() < 1).all()


def test_rates_equal_local_least_squares(spark):
    rng = np.random.default_rng(3)
    n, p = rng.integers(1, 900, 300), rng.dirichlet([0.3, 0.3, 0.3], 300)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>").cache()
    for weights, floor in (([0.8, 0.15, 0.05], 0.0), ([0.4, 0.3, 0.3], 1.0)):
        r = mixing.fit_rates(members, 3, weights, floor)
        w = r.of(n.astype(float), p)
        got = (w * n) @ p
        # With a floor the domain that sets the budget has no room, so soft members only come near.
        assert (w >= floor).all() and np.allclose(got, r.targets, rtol=0.05 if floor else 1e-4)
        columns = [x.w for x in members.select(r.column().alias("w")).collect()]
        assert np.allclose(sorted(columns), sorted(w))


def test_rates_reach_the_constrained_optimum(spark):
    """Residuals against those of a long plain projected gradient; targets that can't be met are only come nearer to."""
    rng = np.random.default_rng(9)
    n, p = rng.integers(1, 500, 200).astype(float), rng.dirichlet([2.0, 2.0, 2.0], 200)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>").cache()
    x = n[:, None] * p
    for weights, floor, met in (([0.5, 0.3, 0.2], 0.0, True), ([0.3, 0.3, 0.4], 0.5, True), ([0.95, 0.04, 0.01], 0.0, False)):
        rates = mixing.fit_rates(members, 3, weights, floor, budget=1.2 * n.sum())
        metric = np.linalg.pinv(x.T @ x)
        error = lambda w: (lambda r: float(r @ metric @ r))(np.array(rates.targets) - w @ x)  # noqa: B023, E731
        w = np.full(200, rates.start)
        for _ in range(20_000):
            w = np.maximum(floor, w + x @ (metric @ (np.array(rates.targets) - w @ x)))
        got, best, start = error(rates.of(n, p)), error(w), error(np.full(200, rates.start))
        assert got <= best + 1e-6 if met else best <= got < 0.3 * start


def test_mixing_bounds_repeated_ids(spark):
    rows = [(10, f"text number {i}", "en", "s", 1) for i in range(50)] + [(11, "other words", "en", "s", 1)]
    labels = spark.createDataFrame([(10, 1, 0), (11, 0, 1)], "doc_id long, quality int, toxic int")
    a, b = spark.createDataFrame(rows, DOCS).repartition(7), spark.createDataFrame(rows[::-1], DOCS).repartition(3)
    one, two = (mixing.train(d, labels, ["high", "low", "toxic"]) for d in (a, b))
    assert np.allclose(one.dense, two.dense) and np.allclose(one.mean, two.mean)
    assert toxicity.train(a, labels).bias == toxicity.train(b, labels).bias


def test_mixing_awkward(spark):
    labels = spark.createDataFrame([(10, 1, 0), (11, 0, 0), (12, None, 1), (None, 1, 1), (10, 0, 0)], "doc_id long, quality int, toxic int")
    rows = mixing.mixture(awkward(spark), labels).collect()
    assert len(rows) == len(AWKWARD) and all(r.n_tokens == 0 for r in rows if r.doc_id in (7, 8, 9))
    out = mixing.mixed(awkward(spark), labels, {"high": 0.5, "low": 0.5})
    assert out.columns == awkward(spark).columns and {r.doc_id for r in out.collect()} == {r[0] for r in AWKWARD}
    assert mixing.mixture(empty(spark), labels).count() == 0 and mixing.mixture(awkward(spark), labels.where("false")).count() == len(AWKWARD)


# -- 5 line dedup --------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(1, 4))
def test_banded_distance(a, b, k):
    assert line_dedup.within(a, b, k) == (distance(a, b) <= k)


def lines_oracle(rows, k, least):
    key = lambda i: line_dedup.NO_ID if i is None else i
    occ = sorted({(key(i), p, x) for i, t, *_ in rows for p, x in enumerate((t or "").split("\n")) if len(x) >= least})
    gone, seen = set(), []
    for o in occ:
        if any(abs(len(o[2]) - len(s)) <= k and distance(o[2], s) <= k for s in seen):
            gone.add(o)
        seen.append(o[2])
    out = Counter()
    for r in rows:
        if r[1] is None:
            out[r] += 1
            continue
        new = "\n".join(x for p, x in enumerate(r[1].split("\n")) if (key(r[0]), p, x) not in gone)
        if new == r[1] or new.strip():
            out[(r[0], new, *r[2:])] += 1
    return out, len(gone)


def edited(rng, line, most):
    x = list(line)
    for _ in range(rng.randint(0, most)):
        i = rng.randrange(len(x))
        rng.choice([lambda: x.insert(i, rng.choice("xyz")), lambda: x.pop(i), lambda: x.__setitem__(i, rng.choice("xyz"))])()
    return "".join(x)


@pytest.mark.parametrize("small", [False, True])
def test_line_dedup_equals_brute_force(spark, monkeypatch, small):
    if small:  # makes every key hot and every group blocked
        monkeypatch.setattr(line_dedup, "BLOCK", 3)
        monkeypatch.setattr(line_dedup, "HOT_LINES", 2)
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 50))) for _ in range(30)]
    rows = [(d, "\n".join(edited(rng, rng.choice(base), 4) for _ in range(rng.randint(0, 5))), "en", "s", 1) for d in range(70)] + AWKWARD + [(None, base[0] + "\n" + base[1], "en", "s", 1)]
    rows = [r for r in rows if r[0] != 10]
    want, gone = lines_oracle(rows, 2, 24)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert Counter(map(tuple, line_dedup.dedup_lines(df).collect())) == want and gone > 20
    report = line_dedup.line_report(df).collect()
    assert len(report) == len(rows)
    assert sum(r.n_copies + r.n_near for r in report) == gone_of(rows, 2, 24)
    by_id = {r[0]: r for r in rows if [x[0] for x in rows].count(r[0]) == 1}
    kept = {r[0]: r[1] for r in want if r[0] in by_id}
    for r in report:
        if r.doc_id in by_id:
            text = by_id[r.doc_id][1]
            assert r.n_lines == text.count("\n") + 1
            if r.doc_id in kept:
                assert r.kept_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest()
                assert r.n_lines - r.n_copies - r.n_near == kept[r.doc_id].count("\n") + 1 or not kept[r.doc_id]
    copies = {(o[0], o[1]) for o in lines_of(rows, 24) if any(p < o and p[2] == o[2] for p in lines_of(rows, 24))}
    assert {r.doc_id for r in report if r.n_copies} <= {i for i, _ in copies} | {None}


def lines_of(rows, least):
    return sorted({(line_dedup.NO_ID if i is None else i, p, x) for i, t, *_ in rows for p, x in enumerate((t or "").split("\n")) if len(x) >= least})


def gone_of(rows, k, least):
    """Dropped lines of all rows; rows that repeat an id and a line at its place each lose it."""
    key = lambda i: line_dedup.NO_ID if i is None else i
    gone, seen = set(), []
    for o in lines_of(rows, least):
        if any(abs(len(o[2]) - len(s)) <= k and distance(o[2], s) <= k for s in seen):
            gone.add(o)
        seen.append(o[2])
    return sum((key(i), p, x) in gone for i, t, *_ in rows for p, x in enumerate((t or "").split("\n")))


@pytest.mark.parametrize("small", [False, True])
def test_line_dedup_finds_word_edits_and_short_copies(spark, monkeypatch, small):
    """Long lines with some words replaced, added or left out, and copies of lines of any length, with the production parameters."""
    if small:
        monkeypatch.setattr(line_dedup, "BLOCK", 3)
        monkeypatch.setattr(line_dedup, "HOT_LINES", 2)
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (11, 12, 23, 25, 36, 47, 48, 49, 63, 65, 81, 129, 240, 401)]

    def changed(line, most):
        x = list(line)
        for _ in range(rng.randint(0, most)):
            i = rng.randrange(len(x))
            rng.choice([lambda: x.insert(i, rng.choice(vocabulary)), lambda: x.pop(i), lambda: x.__setitem__(i, rng.choice(vocabulary))])()
        return " ".join(x)

    rows = [(d, "\n".join([changed(base[d % 14], 1 + len(base[d % 14]) // 11), rng.choice(["", "  ", "ok", "}", "All rights reserved."]), edited(rng, " ".join(base[d % 7]), 3)]), "en", "s", 1) for d in range(98)]
    occ = sorted((i, p, x) for i, t, *_ in rows for p, x in enumerate(t.split("\n")) if x.strip())
    words = {x: tuple(x.split()) for *_, x in occ}
    want, seen, by_words = {r[0]: 0 for r in rows}, [], 0

    def near(a, b):
        k = min(len(words[a]), len(words[b])) // line_dedup.WHOLE["words"]
        by_char = min(len(a), len(b)) >= 12 and abs(len(a) - len(b)) <= 2 and line_dedup.within(a, b, 2)
        return a == b or by_char, k > 0 and abs(len(words[a]) - len(words[b])) <= k and distance(words[a], words[b]) <= k

    for i, _, x in occ:
        hits = [near(x, s) for s in seen]
        want[i] += any(any(h) for h in hits)
        by_words += any(h[1] for h in hits) and not any(h[0] for h in hits)
        if x not in seen:
            seen.append(x)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r.doc_id: r.n_copies + r.n_near for r in line_dedup.line_report(df, **line_dedup.WHOLE).collect()}
    assert got == want and by_words > 20


def test_line_dedup_copies_of_short_lines(spark):
    """Every copy of a line that is not blank goes, whatever its length; blank lines stay."""
    rows = [(d, "}\n\n  \nAll rights reserved.\nown line %s" % ("abcdefghijkl"[d] * (d + 1)), "en", "s", 1) for d in range(12)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, **line_dedup.WHOLE).collect()}
    assert got[0] == rows[0][1] and all("}" not in got[d] and "reserved" not in got[d] and got[d].startswith("\n  \nown line") for d in range(1, 12) if d in got)
    assert {r.doc_id: r.n_copies for r in line_dedup.line_report(df, **line_dedup.WHOLE).collect()} == {d: 2 if d else 0 for d in range(12)}
    assert line_dedup.line_report(awkward(spark), **line_dedup.WHOLE).count() == len(AWKWARD) and line_dedup.dedup_lines(empty(spark), **line_dedup.WHOLE).count() == 0


def test_line_dedup_awkward(spark):
    assert line_dedup.dedup_lines(awkward(spark)).columns == awkward(spark).columns
    assert line_dedup.dedup_lines(empty(spark)).count() == 0 and line_dedup.line_report(awkward(spark)).count() == len(AWKWARD)


# -- 6 toxicity ----------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op6_toxicity(spark, sf).toPandas().merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (held.predicted == held.toxic).mean() > 0.97 and held.score.between(0, 1).all()
    assert held[held.toxic == 0].predicted.mean() < 0.01


def test_machine_learns_a_pair():
    """Two terms that are harmless alone and toxic together; linear weights can't tell."""
    rng = np.random.default_rng(0)
    n = 3000
    a, b = rng.random(n) < 0.5, rng.random(n) < 0.5
    y = (a == b).astype(float)
    row = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    term = np.concatenate([np.full(a.sum(), 5), np.full(b.sum(), 9)])
    order = np.lexsort((term, row))
    m = toxicity.fit(y, row[order], term[order], epochs=60, least_z=0.0)
    assert (((1 / (1 + np.exp(-m.margin(*toxicity_pairs(row[order], term[order], m), n)))) >= 0.5) == y).mean() > 0.95


def test_machine_learns_a_pair_among_others():
    """The same with the production parameters, among terms that say nothing."""
    rng = np.random.default_rng(1)
    n = 4000
    has = rng.random((n, 30)) < 0.1
    has[:, 5], has[:, 9] = rng.random(n) < 0.5, rng.random(n) < 0.5
    y = (has[:, 5] == has[:, 9]).astype(float)
    row, term = (x.astype(np.int64) for x in np.nonzero(has))
    m = toxicity.fit(y, row, term)
    assert {5, 9} <= set(m.terms)
    known = np.isin(term, m.terms)
    assert ((m.margin(*toxicity_pairs(row[known], term[known], m), n) >= 0) == y).mean() > 0.95


def toxicity_pairs(row, term, m):
    return row, np.searchsorted(m.terms, term)


def test_margin_equals_pair_sums():
    rng = np.random.default_rng(5)
    m = toxicity.Machine(np.arange(12), 0.3, rng.normal(size=12), rng.normal(size=(12, 8)))
    sets = [sorted(rng.choice(12, k, replace=False).tolist()) for k in (0, 1, 2, 5, 12)]
    row, term = np.repeat(np.arange(5), [len(s) for s in sets]), np.array([t for s in sets for t in s])
    want = [m.bias + sum(m.linear[i] for i in s) + sum(float(m.vectors[i] @ m.vectors[j]) for i in s for j in s if i < j) for s in sets]
    assert np.allclose(m.margin(row, term, 5), want)


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(10, 1), (11, 0), (12, 0), (None, 1), (10, None)], "doc_id long, toxic int")
    m = toxicity.train(awkward(spark), labels)
    got = toxicity.scores(awkward(spark), m).collect()
    assert len(got) == len(AWKWARD) and len({r.score for r in got if r.doc_id in (7, 8, 9)}) == 1
    kept = toxicity.without_toxic(awkward(spark), m)
    assert kept.columns == awkward(spark).columns and kept.count() == sum(r.predicted == 0 for r in got)
    none = toxicity.train(awkward(spark), labels.where("false"))
    assert all(r.score < 0.5 for r in toxicity.scores(awkward(spark), none).collect()) and toxicity.scores(empty(spark), none).count() == 0


# -- 7 chat --------------------------------------------------------------------------------


def test_chat_oracle(spark, sf_dir):
    from oracle import compare

    compare(spark, "op7_chat_pairs", queries.op7_chat_pairs, chat.ORACLE, sf_dir)


def test_chat_keeps_every_conversation_and_turn(spark):
    df = spark.createDataFrame([(4, 0, "user", "no answer"), (6, 0, "user", "u"), (6, 1, "assistant", "x"), (6, 2, "user", "thanks")], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.format_pairs(chat.branched_pairs(df)).collect()}
    assert set(got) == {4, 6} and got[4].prompt + got[4].chosen == "<|user|>\nno answer<|end|>\n" and got[4].chosen_spans == ""
    assert (got[6].prompt + got[6].chosen).endswith("<|user|>\nthanks<|end|>\n")


def test_chat_pairs_by_hand(spark):
    t = lambda *x: [{"role": r, "text": v} for r, v in x]
    rows = [
        (1, t(("user", "hi"), ("assistant", "a")), t(("user", "hi"), ("assistant", "b"), ("user", "c"))),
        (2, t(("user", "x")), t(("user", "x"))),
        (3, [], t(("assistant", "é😀"))),
    ]
    df = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r.pair_id: r for r in chat.format_pairs(df).collect()}
    assert got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].chosen == "<|assistant|>\na<|end|>\n" and got[1].n_prompt_turns == 1
    start, end = map(int, got[1].rejected_spans.split("-"))
    assert got[1].rejected[start:end] == "b<|end|>\n"
    assert (got[2].chosen, got[2].rejected, got[2].n_prompt_turns) == ("", "", 1)
    start, end = map(int, got[3].rejected_spans.split("-"))
    assert got[3].prompt == "" and got[3].rejected[start:end] == "é😀<|end|>\n"


def test_chat_awkward(spark):
    rows = [(1, None, None, None), (1, 2, "assistant", None), (1, 2, "assistant", None), (0, 0, "user", "u"), (0, 1, "assistant", "x"), (4, 0, "user", "no answer"), (None, 0, "assistant", "z"), (8, 0, "user", "long " * 50_000), (9, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS other")
    got = {r.pair_id: r for r in chat.format_pairs(chat.branched_pairs(df)).collect()}
    assert set(got) == {0, 1, 4, 8, 9, None} and got[8].prompt.count("long ") == 50_000
    assert chat.format_pairs(chat.branched_pairs(df.where("false"))).count() == 0


# -- 8 media -------------------------------------------------------------------------------


def test_media_query(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, sf_dir, "documents").collect()}
    features = {}
    for r in queries.op8_media(spark, sf_dir).collect():
        raw = texts[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + 44 and features.setdefault(raw, r.feature) == r.feature


def naive_pairs(samples):
    """Time-coded peak pairs by the definition: a plain sum over samples for each frequency."""
    x = [b - 128.0 for b in samples] + [0.0] * (media.WINDOW - len(samples))
    hann = [0.5 - 0.5 * np.cos(2 * np.pi * i / (media.WINDOW - 1)) for i in range(media.WINDOW)]
    waves = np.exp(-2j * np.pi * np.outer(np.arange(1, media.WINDOW // 2 + 1), np.arange(media.WINDOW)) / media.WINDOW)
    found, width = [], media.WINDOW // 2 // media.BANDS
    for at in range(0, len(x) - media.WINDOW + 1, media.HOP):
        power = abs(waves @ (np.array(x[at : at + media.WINDOW]) * hann)) ** 2
        floor = max(media.OVER_MEAN**2 * power.mean(), 1e-6)
        tops = [(b * width + int(power[b * width : (b + 1) * width].argmax())) for b in range(media.BANDS)]
        found.append([(t + 1, power[t]) if power[t] > floor else (-1, 0.0) for t in tops])
    strongest = [max(f, key=lambda p: p[1])[0] for f in found]
    return [i << 32 | f << 16 | strongest[i + gap] << 4 | gap for i, frame in enumerate(found) for f, _ in frame if f >= 0 for gap in range(1, media.AHEAD + 1) if i + gap < len(found) and strongest[i + gap] >= 0]


def test_media_pairs_equal_naive_transform(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("length(text) < 6000")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = media.media_digests(docs).collect()
    assert len(rows) > 20
    for r in rows[:60]:
        want = naive_pairs(media.to_payload(texts[r.doc_id])[0])
        assert r.pairs == want and r.n_pairs == len(want)
        assert r.feature == f"{len(want)}:{hashlib.sha256(np.array(want, '<i8').tobytes()).hexdigest()}"


def test_media_columns_and_awkward(spark):
    m = media.to_media(awkward(spark))
    assert {r.doc_id: len(media.read_wav(bytes(r.media))) for r in m.collect()}[7] == 64
    assert media.media_features(m).count() == len(AWKWARD) and media.media_digests(empty(spark)).count() == 0
    t = np.arange(8000)
    tone = (128 + 60 * np.sin(2 * np.pi * 1000 * t / 8000)).astype(np.uint8).tobytes()
    at, _ = media.peaks(tone)
    assert (np.abs(at[5:-5].max(axis=1) - 32) <= 1).all()
    assert media.peak_pairs(bytes([128]) * 640).size == 0


# -- 9 html --------------------------------------------------------------------------------

PARAGRAPH = "A sentence with several words that goes on for a while, so that it counts as prose. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now, it is cheap and good</div>
<article><h1>Title &amp; more</h1><p><b>Bold&nbsp;start<br>next <p>{PARAGRAPH}</p><p>Short.</p><form><input><label>Mail</label></form>
<div class="comments"><p>{PARAGRAPH}</p></div></article><aside>side</aside><div id="cookie-notice">We use cookies</div><footer>&copy; me</footer></body></html>"""


def test_html_article():
    assert html_extract.main_text(PAGE) == "\n\n".join(["Title & more", "Bold start next", " ".join(PARAGRAPH.split()), "Short."])


def test_html_without_article():
    page = f'<body><div class="menu"><a>one</a> <a>two</a></div><div class="wrap"><div class="post"><p>{PARAGRAPH}</p><p>Mid.</p><p>{PARAGRAPH}</p></div></div><div class="sidebar"><p>{PARAGRAPH}</p></div></body>'
    assert html_extract.main_text(page).split("\n\n") == [" ".join(PARAGRAPH.split()), "Mid.", " ".join(PARAGRAPH.split())]


@pytest.mark.parametrize("block", ["pre", "blockquote", "div", "section"])
def test_html_keeps_what_stands_beside_a_long_block(block):
    page = f'<body><div class="menu"><a>one</a></div><div class="post"><h1>T</h1><p>Intro</p><{block}>{PARAGRAPH * 5}</{block}><p>End</p></div><div class="sidebar">s</div></body>'
    assert html_extract.main_text(page).split("\n\n") == ["T", "Intro", " ".join((PARAGRAPH * 5).split()), "End"]


def test_html_keeps_all_containers_and_articles():
    long, short = " ".join((PARAGRAPH * 8).split()), " ".join(PARAGRAPH.split())
    page = f'<body><div class="wrap"><div><p>{long}</p><p>{long}</p></div><div><p>{short}</p></div></div></body>'
    assert html_extract.main_text(page).split("\n\n") == [long, long, short]
    page = f'<body><p>out</p><article><p>{long}</p></article><article><p>Brief.</p></article><article class="ad"><p>{short}</p></article></body>'
    assert html_extract.main_text(page).split("\n\n") == [long, "Brief."]


@settings(max_examples=150, deadline=None)
@given(st.text("<>/apdiv &;=\"'!-x\n[]?#", max_size=80))
def test_html_never_fails(page):
    html_extract.main_text(page)


@pytest.mark.parametrize("page, text", [
    ("<![foo]>x", "x"), ("<![ foo<p>z", "z"), ("<![CDATA[x]]>y", "y"), ("<p>a <button>b</button> c</p>", "a c"), ('x<span class="ad">..</span>y', "xy"),
    ('<p>1 <span class="ad">x <span>y</span> z</span> 2</p>', "1 2"), ("a < b", "a < b"), ("<p>x<!-- y", "x"), ("x<p", "x"), ("&lt;p&gt; &amp; x&nbsp;y &#233;", "<p> & x y é"),
])
def test_html_small_pages(page, text):
    assert html_extract.main_text(page) == text


def test_html_marks_are_whole_words():
    prose = " ".join(PARAGRAPH.split())
    for head in ('<div class="post-body side-by-side">', '<article class="news promo-free comment-enabled">', '<div class="content has-sidebar">', '<form id="page"><main>', '<div class="sidebar-left"><article>'):
        assert html_extract.main_text(f"<body>{head}<p>{PARAGRAPH}</p>") == prose, head
    assert html_extract.main_text(f'<h1 id="side-effects">T</h1><p id="menu-item">{PARAGRAPH}</p>') == f"T\n\n{prose}"
    for mark in ("left-sidebar", "site-footer", "commentList", "cookie_banner", "ad-300x250", "share-buttons", "main-nav"):
        assert html_extract.main_text(f'<div class="post"><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div class="{mark}"><p>{PARAGRAPH}</p></div>') == f"{prose}\n\n{prose}", mark


BODY = "".join(f"<p>Paragraph {i} of a long enough article, with several words, so that its ratio is high.</p>" for i in range(6))
TEXT = html_extract.main_text(f"<html><body><div class=content>{BODY}</div></body></html>")


@pytest.mark.parametrize("before, after", [
    ("<div><h1>Title</h1><span>By somebody</span></div><div class=content>", "</div>"),
    ("<div class=top><a href=/>Home</a></div><div><h1>Title</h1></div><p>By somebody</p><div class=content>", "</div>"),
])
def test_html_takes_in_the_headline(before, after):
    got = html_extract.main_text(f"<html><body><nav>Menu</nav>{before}{BODY}{after}<footer>f</footer></body></html>")
    assert got == "Title\n\nBy somebody\n\n" + TEXT


@pytest.mark.parametrize("part", ["<section id='reader_comments_list'><p>I think so too, and I said it before.</p></section>", "<div class='site-notice'>We changed our terms of use lately.</div>", "<ul class='thread-replies-list'><li>Me too, of course.</li></ul>", "<div id='js-cookieConsentBox'>Accept all of them?</div>"])
@pytest.mark.parametrize("page", ["<article><h1>T</h1>{b}{p}</article>", "<div class='content-with-comments'>{p}{b}</div>", "<div id=main>{b}</div>{p}"])
def test_html_marks_by_any_word(part, page):
    got = html_extract.main_text("<html><body>" + page.format(b=BODY, p=part) + "</body></html>")
    assert got.removeprefix("T\n\n") == TEXT


def test_html_cluster_equals_loops():
    draw = random.Random(2)
    for _ in range(60):
        n = draw.randint(1, 25)
        size, tags, kept = [draw.choice([3, 10, 80, 400]) for _ in range(n)], [draw.randint(0, 6) for _ in range(n)], [draw.random() < 0.8 for _ in range(n)]
        ratio = [s / max(1, t) if k else 0.0 for s, t, k in zip(size, tags, kept, strict=True)]
        weight = lambda d: float(np.exp(-d * d / (2 * html_extract.SIGMA**2))) if abs(d) <= 3 else 0.0
        smoothed = [sum(weight(i - j) * ratio[j] for j in range(n)) / sum(weight(i - j) for j in range(n)) for i in range(n)]
        mean = sum(smoothed) / n
        limit = min((sum((x - mean) ** 2 for x in smoothed) / n) ** 0.5, max(smoothed))
        want = [k and x >= limit - 1e-9 for k, x in zip(kept, smoothed, strict=True)]
        got = html_extract.cluster(np.array(size, float), np.array(tags, float), np.array(kept)).tolist()
        assert got == (want if any(want) else kept)


def test_html_time_is_linear():
    import time

    for page in ("<div>" * 40_000 + "</section>" * 40_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<!--" * 50_000, "<a " * 60_000, '<a b="' * 40_000, '<span class="ad">' * 50_000, "<script></" * 40_000, "<article>" * 30_000 + "</div>" * 30_000, "<![" * 60_000 + ">"):
        began = time.perf_counter()
        html_extract.main_text(page)
        assert time.perf_counter() - began < 5, page[:20]


def test_html_query_and_awkward(spark, sf_dir):
    import html

    for r in queries.op9_html(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    df = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 1), (2, "u", "<p>plain words here", 1), (2, "u", "<p>plain words here", 1)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in html_extract.extract(df).collect()) == ["", "", "plain words here", "plain words here"]
    assert html_extract.extract(df.where("false")).count() == 0


# -- 10 jaccard join -----------------------------------------------------------------------


def components_oracle(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["É", "naïve", "ÀB", "İx"]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 12, 30, 60]))] for _ in range(30)]
    rows = []
    for d in range(260):
        w = list(rng.choice(base)) + (base[0] if rng.random() < 0.2 else [])
        for _ in range(rng.randint(0, len(w) // 12)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 1)] = [rng.choice(words)] if rng.random() < 0.7 else []
        text = rng.choice([" ", "  ", "\n", "\t "]).join(w)
        rows.append((d * 2 + 1, text.upper() if rng.random() < 0.1 else text))
    return rows + [(r[0], r[1]) for r in AWKWARD] + [(5, rows[2][1]), (7004, "x " * 9000), (7005, "x " * 9001), (None, rows[3][1])]


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_equals_brute_force(spark, monkeypatch, small):
    if small:  # hot shingles, long lists and blocked groups everywhere
        for name, value in (("HOT_DOCS", 3), ("SMALL", 3), ("BLOCK_SETS", 7)):
            monkeypatch.setattr(jaccard_join, name, value)
    rows = near_rows()
    got = jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == components_oracle(rows)


def test_jaccard_oracle(spark, sf_dir):
    from oracle import compare

    compare(spark, "op10_jaccard_join", queries.op10_jaccard_join, jaccard_join.ORACLE, sf_dir)


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from quarry.llm.common import scratch

    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.execution.arrow.maxBytesPerBatch": "1"}
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(far)


def test_jaccard_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert sorted((tuple(r) for r in queries.op10_jaccard_join(spark, sf_dir).collect()), key=str) == components_oracle(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(1, 14), min_size=1, max_size=12), min_size=2, max_size=14), st.booleans())
def test_skip_join_finds_all_links(sets, sided):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    sides = [i % 2 for i in range(len(sets))] if sided else None
    links = [(i, j) for i in range(len(sets)) for j in range(i) if (not sided or sides[i] != sides[j]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    got = jaccard_join.SkipJoin(arrays, sides).links()
    assert all((a, b) in links or (b, a) in links for a, b in got)

    def parts(edges):
        u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        return dict(zip(*(x.tolist() for x in components.roots(u, v)), strict=True)) if edges else {}

    assert parts(got) == parts(links)


def test_jaccard_awkward(spark):
    out = jaccard_join.one_of_each(awkward(spark))
    assert out.columns == awkward(spark).columns and out.where("doc_id = 9").count() == 1
    assert jaccard_join.near_components(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("name", ["star", "chain", "hubs", "empty"])
def test_components_over_many_partitions(spark, monkeypatch, name):
    """Without coalescing, so that edges of a node lie in many partitions, and with hot nodes dealt out by salt."""
    monkeypatch.setattr(components, "LEAST_HOT", 50)
    n = 100_000 if name == "star" else 3000
    edges = {"star": [(7, x) for x in range(n)], "chain": [(x, x + 1) for x in range(n)], "hubs": [(5, x) for x in range(10, n)] + [(3, n + x) for x in range(n)] + [(5, 4), (4, 3)], "empty": []}[name]
    settings_ = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in settings_}
    try:
        for k, v in settings_.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(edges, "u long, v long").repartition(11)
        got = components.components(df).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    low = 3 if name == "hubs" else 0
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert {r.node: r.root for r in got} == dict.fromkeys(nodes, low) and len(got) == len(nodes)


def test_shingles_of_slices():
    arr = pa.array(["zz zz", None, "a b c d e f", "É x"]).fill_null("")
    assert [len(s) for s in jaccard_join.shingle_sets(arr.slice(1))] == [0, 2, 1]
    assert jaccard_join.unpacked(jaccard_join.packed(np.array([1 << 40, (1 << 64) - 1], np.uint64))).tolist() == [1 << 40, (1 << 64) - (1 << 16)]
