"""No row ends a job: texts nested too deeply, numbers too large, pointers of no place."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import documents, pysource

DEEP = ["x" + ".a" * 50_000, "a" + "+a" * 20_000, "-" * 100_000 + "1", "(" * 5_000 + ")" * 5_000, "\x00", "class A:\n def f(self, a=" + "[" * 150 + "]" * 150 + "): return g(1)"]


@pytest.mark.parametrize("extension", [".json", ".jsonc", ".yaml", ".toml"])
def test_documents(spark, extension):
    texts = ["[" * 100_000 + "]" * 100_000, '{"a":' * 50_000 + "1" + "}" * 50_000, "a = " + "[" * 50_000, "[1, 2]"]
    df = spark.createDataFrame([(t, p) for t in texts for p in ("", "/inf", "/-inf", "/nan", "/1e400", "/1")], "t string, p string")
    rows = df.select("t", "p", documents.query_udf("t", F.lit(extension), "p").alias("r"), documents.canonical_udf("t").alias("c")).collect()
    assert len(rows) == 24 and all(r.r.error for r in rows if r.t.startswith(('{"a":' * 50, "a = [[")) and extension != ".yaml")
    good = {r.p: (r.r.value, r.r.present, r.r.error) for r in rows if r.t == "[1, 2]"}
    if extension != ".toml":
        assert good["/1"] == ("2", True, None) and all(good[p] == (None, False, None) for p in ("/inf", "/-inf", "/nan", "/1e400"))


def test_sources(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate([*DEEP, "def ok(): return f(1)"])], "path string, text string")
    assert [r.name for r in pysource.symbol_map(df).where("path = '6'").collect()] == ["ok"]
    got = df.select("path", pysource.error_count_udf("text").alias("e"), pysource.imports_udf("text").alias("i"), pysource.calls_udf("text").alias("c")).collect()
    assert {r.path: r.e for r in got}["6"] == 0 and len(got) == 7
    assert pysource.search(df, "f($X)").where("path = '6'").count() == 1 and pysource.surface(df).where("path = '6'").count() == 1
    assert pysource.rewrite_first(DEEP[1], "f($X)", "g($X)")[0] == 0
