"""Offsets of JSON values against the parser: what stands there is the value, and no value is left out."""

import json
import random

from quarry.operators import documents, locations


def values(v, at=""):
    yield at
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield from values(x, f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}")


def made(draw, depth):
    kind = draw.randrange(6 if depth else 4)
    if kind == 4:
        return [made(draw, depth - 1) for _ in range(draw.randrange(4))]
    if kind == 5:
        return {draw.choice(["a", "b/c", "d~e", 'q"{', "é😀", "", "\\"]): made(draw, depth - 1) for _ in range(draw.randrange(4))}
    return [draw.randrange(100), draw.choice([None, True]), draw.choice(["", "x,y", "[}", 'a"b', "tail\\", "é😀:"]), -1.5e3][kind]


def test_locations_equal_parser(spark):
    draw = random.Random(4)
    texts = []
    for i in range(300):
        t = json.dumps(made(draw, 4), ensure_ascii=bool(i % 2), indent=draw.choice([None, 2]), separators=draw.choice([(",", ":"), (", ", " : ")]))
        texts.append(" " * (i % 3) + t + "\n" * (i % 2))
    texts += [None, "", "{", "[1,", "not json", "[" * 300 + "]" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {r.id: r["values"] for r in locations.located(df, "text").collect()}
    assert len(got) == len(texts) and all(got[i] == [] for i in range(300, 305)) and len(got[305]) == 300
    for i in range(300):
        doc = json.loads(texts[i])
        assert sorted(v.pointer for v in got[i]) == sorted(values(doc)), texts[i]
        for v in got[i]:
            assert json.loads(texts[i][v.start : v.end]) == documents.select(doc, v.pointer) and texts[i][v.start : v.end].strip() == texts[i][v.start : v.end]
    assert locations.located(df.where("false"), "text").collect() == []
