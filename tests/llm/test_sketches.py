"""Sketches of lines: no near pair is lost, and lines that only share a passage move no text."""

import random

import numpy as np
import pytest

from quarry.llm import line_dedup
from quarry.llm.line_dedup import WHOLE, Lines, passing, sketches


def sketched(lines):
    found, length = Lines(lines).words()
    raw = sketches(np.arange(len(lines)), found, length)[:, 12:]
    return length, np.stack([raw & 15, raw >> 4], axis=2).reshape(len(lines), -1)


@pytest.mark.parametrize("by_word", [True, False])
def test_near_lines_pass(by_word):
    draw = random.Random(7)
    pairs = []
    for _ in range(400):
        a = [f"w{draw.randrange(50)}" for _ in range(draw.randrange(12, 120))]
        if by_word:
            b = list(a)
            for _ in range(len(a) // 13):  # of the shorter line's words, one in twelve at most
                at, kind = draw.randrange(len(b)), draw.randrange(3)
                b[at : at + (kind > 0)] = [] if kind == 1 else [f"x{draw.randrange(50)}"]
            k = min(len(a), len(b)) // 12
            assert line_dedup.within(a, b, k)
            pairs.append((" ".join(a), " ".join(b)))
        else:
            a = b = " ".join(a[:20])
            for _ in range(2):
                at, kind = draw.randrange(len(b)), draw.randrange(3)
                b = b[:at] + ("" if kind == 1 else draw.choice("a 　")) + b[at + (kind > 0) :]
            pairs.append((a, b))
    for a, b in pairs:
        length, counts = sketched([a, b])
        order = np.argsort(length, kind="stable")
        assert passing(np.array([0]), np.array([2]), length[order], np.full(2, by_word), counts[order], 2, 12).all(), (a, b)
    # In one group, as blocks of pairs: lines with a partner are those with a near sketch.
    length, counts = sketched([x for p in pairs for x in p])
    order = np.argsort(length, kind="stable")
    assert passing(np.array([0]), np.array([800]), length[order], np.full(800, by_word), counts[order], 2, 12).all()


@pytest.mark.parametrize("block", [512, 8])
def test_lines_that_share_a_passage_move_no_text(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)  # 8: keys are large and in bands
    passage = [f"p{i}" for i in range(30)]
    lines = [[f"d{n}w{i}" for i in range(20 + n)] + passage + [f"d{n}v{i}" for i in range(20)] for n in range(60)]
    near = [["other", *lines[5][1:]], lines[30][:-1], [*lines[59], "more", "words"]]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate([*lines, *near])], "doc_id long, text string").repartition(3)
    asked, own = [], line_dedup.line_texts
    monkeypatch.setattr(line_dedup, "line_texts", lambda docs, some, *more: (asked.append(some.distinct().count()), own(docs, some, *more))[1])
    got = {r.doc_id for r in line_dedup.line_report(docs, **WHOLE).collect() if r.n_near}
    assert got == {60, 61, 62}
    assert asked == [6]  # all 63 before: each shares the passage's keys
