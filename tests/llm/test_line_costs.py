"""Steps of line dedup that save work: they have to give the same as the plain way, and to leave work out."""

import random

from quarry.llm import line_dedup
from quarry.llm.line_dedup import INDEX, NO_ID, PROBE, WORDS


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_by_diagonals():
    draw = random.Random(7)
    for n in range(4000):
        a = [draw.choice("abc" if n & 1 else "abcdefghij") for _ in range(draw.randrange(18))]
        b = list(a) if n & 2 else [draw.choice("abc") for _ in range(draw.randrange(18))]
        for _ in range(draw.randrange(9)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randrange(2)] = draw.choice([[], ["a"], ["d"]])
        for k in (0, 1, 3, line_dedup.DIAGONAL, line_dedup.DIAGONAL + 3):
            assert line_dedup.within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def test_repeats_of_words_tell_lines_apart(monkeypatch):
    calls, own = [], line_dedup.within
    monkeypatch.setattr(line_dedup, "within", lambda a, b, k: (calls.append(k), own(a, b, k))[1])
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words * 2), " ".join(words + words[:20] * 2 + ["w0"]), " ".join(words + ["new", *words])]
    route = line_dedup.Route(2, 12)
    route.lines = {i: [(i, 0, i, i, x)] for i, x in enumerate(texts)}
    route.compare({i: (INDEX | PROBE | WORDS, 0) for i in range(3)}, False)
    assert route.near == {(2, 2)} and len(calls) == 1  # the second has the same words, 20 of them in other numbers


def test_first_occurrences_of_all_ids(spark):
    ids = {1: [5, 3, 1 << 40], 2: [1 << 40, 1 << 50], 3: [-5, NO_ID, 7], 4: [-(1 << 31), (1 << 31) - 1], 5: [-(1 << 31) - 1, -1], 6: [(1 << 63) - 1], 7: [0, 0]}
    rows = [(h, -h, i, p) for h, some in ids.items() for p, i in enumerate(some)]
    got = {r.h1: (r.id, r.place, r.n) for r in line_dedup._first(spark.createDataFrame(rows, "h1 long, h2 long, id long, place int")).collect()}
    assert got == {h: (*min((i, p) for p, i in enumerate(some)), len(some)) for h, some in ids.items()}


def test_entries_that_may_repeat_are_marked(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "\n".join(f"the same beginning of a line and then {j % 7} or {i % 3}" for j in range(9))) for i in range(40)], "doc_id long, text string").repartition(4)
    plain = line_dedup._met(docs, 2, 12, "text", 12, 1 << 10).where("key IS NOT NULL")
    assert plain.count() and plain.where("again").count() == 0
    want = {tuple(r) for r in line_dedup.met_entries(docs, 2, 12, words=12).collect()}
    monkeypatch.setattr(line_dedup, "BUCKET", 2)
    monkeypatch.setattr(line_dedup, "HOT_LINES", 2)
    met = line_dedup._met(docs, 2, 12, "text", 12, 4).where("key IS NOT NULL")
    assert met.where("again").count()
    rows = [tuple(r) for r in line_dedup._entries_of(met).collect()]
    assert len(rows) == len(set(rows)) and set(rows) >= want


def test_only_lines_that_are_asked_for_get_a_text(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {j} of document {i}, no other has it" for j in range(50))) for i in range(20)] + [(None, "a line without an id\nx")], "doc_id long, text string")
    asked = spark.createDataFrame([(3, 7), (19, 49), (NO_ID, 0)], "id long, place int")
    got = {r.line for r in line_dedup.line_texts(docs, asked, 12).collect()}
    assert got >= {"line 7 of document 3, no other has it", "line 49 of document 19, no other has it", "a line without an id"}
    assert len(got) <= 4  # of 1001; a bit of the map may stand for another place, too
