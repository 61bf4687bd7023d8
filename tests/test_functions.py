"""Functions and operators on small inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import paths, replacing, scanning, text
from quarry.operators import changes, config_layers, content, documents, graph, policy, pysource, search, transcripts
from quarry.plans import goldens
from quarry.streaming import expiry


@pytest.mark.parametrize(
    ("body", "start", "end", "cap", "want"),
    [
        ("zero\none\ntwo\nthree\n", 1, 3, 1 << 20, ("one\ntwo\n", 1, 3, False, True)),
        ("alpha\nbeta\n", 0, 100, 1 << 20, ("alpha\nbeta\n", 0, 2, False, False)),
        ("a" * 4096, 0, 1, 1024, ("a" * 1024, 0, 1, True, True)),
        ("a\nb", 5, 9, 10, ("", 5, 5, False, False)),
        ("a\nb", 0, 2, 10, ("a\nb", 0, 2, False, False)),
        ("a\n\n", 0, 9, 10, ("a\n\n", 0, 2, False, False)),
        ("\n", 0, 1, 10, ("\n", 0, 1, False, False)),
        ("", 0, 1, 10, ("", 0, 0, False, False)),
    ],
)
def test_line_slice(spark, body, start, end, cap, want):
    r = spark.createDataFrame([(body,)], "t string").select(content.line_slice(F.col("t"), start, end, cap).alias("s")).first().s
    assert tuple(r[k] for k in ("content", "returned_start", "returned_end", "truncated", "has_more")) == want


def test_slice_limits():
    with pytest.raises(ValueError, match="1000"):
        content.line_slice(F, 0, 1001)


def test_capabilities(spark):
    rows = [("a/x.ts", b"let x", 0), ("x.json", b"{}", 0), ("x.toml", b"", 0), ("x.txt", b"t", None), ("x.bin", b"\0\1\2", None), (".bashrc", b"x", None), ("x.md", b"# t", 0)]
    df = spark.createDataFrame(rows, "path string, b binary, e int").select("path", content.capabilities(F.col("path"), content.is_binary(F.col("b")), F.col("e")).alias("c"))
    got = {r.path: (r.c.kind, r.c.read, r.c.patch) for r in df.collect()}
    assert got["a/x.ts"] == ("source", ["ast", "text"], ["ast", "block"])
    assert got["x.json"] == ("document", ["ast", "text"], ["ast", "block"])
    assert got["x.toml"] == ("document", ["ast", "text"], ["block"])
    assert got["x.txt"] == ("text", ["text"], ["block"]) and got["x.bin"] == ("binary", [], []) and got[".bashrc"][0] == "text"
    assert got["x.md"] == ("source", ["ast", "text"], ["block"])


def test_text_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.utf16_length(F.lit("a😀"))) == 3
    assert one(text.pointer_escape(F.lit("a/b~c"))) == "a~1b~0c" and one(text.pointer_unescape(F.lit("a~1b~0c"))) == "a/b~c"
    assert one(text.line_of(F.lit("a\nb\nc"), F.lit(4))) == 3 and one(text.column_of(F.lit("a\nbcd"), F.lit(4))) == 3
    assert one(text.occurrences(F.lit("aaaa"), "aa")) == 2
    assert one(text.normalize_whitespace_line(F.lit("\tif  (a)   b  "))) == "  if (a) b"
    assert one(text.xml_escape(F.lit("<a & 'b'>"))) == "&lt;a &amp; &apos;b&apos;&gt;"


@pytest.mark.parametrize(("glob", "path", "hit"), [("**", "a/b", True), ("src/**", "src", True), ("src/**", "src/a/b", True), ("*.ts", "a/b.ts", False), ("**/*.ts", "b.ts", True), ("**/*.ts", "a/b.ts", True), ("a?c", "abc", True), ("{a,b}.py", "b.py", True), ("[a-c]x", "bx", True), ("[!a]x", "ax", False), ("a.c", "abc", False)])
def test_globs(spark, glob, path, hit):
    import re

    assert bool(re.match(paths.glob_regex(glob), path)) is hit
    assert spark.range(1).select(F.regexp_like(F.lit(path), F.lit(paths.glob_regex(glob))).alias("x")).first().x is hit


def test_selector_expansion():
    assert paths.expand_selector("a{b,c}[1-2]") == ["ab1", "ab2", "ac1", "ac2"]
    assert paths.expand_selector("[!a]") == ["[!a]"]
    assert paths.expand_selector("[0-9][0-9][0-9]") is None
    assert paths.can_match_below("src/**", "src/a") and not paths.can_match_below("lib/*", "src") and paths.can_match_below("**/x", "a/b")
    assert not paths.can_match_below("a/b", "a/b/c") and paths.can_match_below("a/{b,c}/**", "a/c")
    assert [paths.covers_below(g, r) for g, r in [("**", "a"), ("a/**", "a"), ("a/*", "a"), ("a/**/x", "a"), ("private/**", "private/k")]] == [True, True, False, False, True]


def test_policy_goldens(spark):
    rules = [
        policy.Rule("workspace", "/w", "allow", "request", excludes=("private/**",)),
        policy.Rule("source-allow", "/w/src", "allow", "allow"),
        policy.Rule("source-deny", "/w/src", "deny", "deny"),
        policy.Rule("outside", "/o", "allow", "allow", source="project"),
        policy.Rule("scoped-deny", "/w/special", "deny", "deny", includes=("*.ts",)),
        policy.Rule("scoped-allow", "/w/special", "allow", "allow", includes=("secret*",), excludes=("secret.*",)),
    ]
    checks = [("/w/src/value.ts", "read"), ("/w/value.ts", "write"), ("/w/private/key.txt", "read"), ("/w/conf.toml", "write"), ("/x/y", "read"), ("/w/special/secret.ts", "read"), ("/o/f", "read"), ("/w", "read")]
    d = policy.decide(spark.createDataFrame(checks, "path string, operation string"), rules, policy.Baseline(("/w",), ("/w/conf.toml",)))
    got = {r.path: (r.policy, r.rule_id, r.source) for r in d.collect()}
    assert got["/w/src/value.ts"][:2] == ("deny", "source-deny")
    assert got["/w/value.ts"][:2] == ("request", "workspace")
    assert got["/w/private/key.txt"] == ("allow", None, "baseline")
    assert got["/w/conf.toml"] == ("request", None, "configuration")
    assert got["/x/y"][0] == "deny" and got["/w/special/secret.ts"][:2] == ("deny", "scoped-deny")
    assert got["/o/f"][0] == "request" and got["/w"][:2] == ("allow", "workspace")
    assert policy.tree_readable("/w/lib", [policy.Rule("a", "/w", "allow", "deny")])
    assert not policy.tree_readable("/w", [policy.Rule("a", "/w", "allow", "deny"), policy.Rule("b", "/w/x", "deny", "deny")])
    assert policy.tree_readable("/w/x/y", [policy.Rule("a", "/w", "allow", "deny"), policy.Rule("b", "/w/x", "deny", "deny", excludes=("y/**",))])


def test_links(spark):
    checks = spark.createDataFrame([("/w/l", "read"), ("/w/m", "read")], "path string, operation string")
    links = spark.createDataFrame([("/w/l", "/x/t"), ("/w/m", "/w/t")], "path string, target string")
    rules = [policy.Rule("w", "/w", "allow", "allow", follow_symlinks=True)]
    assert {r.path: r.policy for r in policy.decide_links(checks, links, rules, policy.Baseline(("/w",))).collect()} == {"/w/l": "deny", "/w/m": "allow"}


@pytest.mark.parametrize(("pointer", "want"), [("/a~1b/m~0n/1", "one"), ("/a~1b/m~0n/", "zero"), ("/a~1b/m~0n/01", "one"), ("/a~1b/m~0n/-1", None), ("/a~1b/m~0n/1.5", None), ("/a~1b/m~0n/x", None), ("/missing/value", None)])
def test_pointers(pointer, want):
    got = documents.select({"a/b": {"m~n": ["zero", "one"]}}, pointer)
    assert (None if got is documents._MISSING else got) == want


def test_document_query(spark):
    rows = [('{"a": null}', ".json", "/a"), ('{"a": null}', ".json", "/b"), ("{}", ".json", "x"), ("// c\n{\"a\": [1,],}", ".jsonc", "/a/0"), ("[t]\nx = 2", ".toml", "/t/x"), ("k: [1, 2]", ".yaml", "/k"), ("{", ".json", ""), ("x", ".txt", ""), ('"' + "x" * (256 << 10) + '"', ".json", "")]
    got = [tuple(r.r) for r in spark.createDataFrame(rows, "t string, e string, p string").select(documents.query_udf("t", "e", "p").alias("r")).collect()]
    assert got == [("null", True, None), (None, False, None), (None, False, "invalid_document_selector"), ("1", True, None), ("2", True, None), ("[1,2]", True, None), (None, False, "document_invalid"), (None, False, "document_format_unsupported"), (None, False, "document_result_too_large")]
    assert documents.canonical_json('{"b": 1, "a": {"d": 2, "c": 3}}') == '{"a":{"c":3,"d":2},"b":1}'


def test_config(spark):
    rows = [("default", 0, "a", "1"), ("global", 1, "a", None), ("project", 2, "a", "3"), ("default", 0, "b", "x"), ("global", 1, "paths", "[1]"), ("project", 2, "paths", "[2, 3]")]
    got = {r.leaf: (r.value, r.provenance) for r in config_layers.merge(spark.createDataFrame(rows, "layer string, layer_ord int, leaf string, value string")).collect()}
    assert got == {"a": ("3", "project"), "b": ("x", "default"), "paths": ("[1,2, 3]", "project")}
    near = config_layers.nearest_config(spark.createDataFrame([("/a/b/c/f",), ("/z/f",)], "path string"), spark.createDataFrame([("/a",), ("/a/b",)], "dir string"), spark.createDataFrame([("/a/b/c",)], "dir string"))
    assert {r.path: r.config_dir for r in near.collect()} == {"/a/b/c/f": None, "/z/f": None}
    c = config_layers.with_defaults(spark.createDataFrame([(1, None, None, None, "request"), (2, "reject", None, "deny", "allow")], "version int, fallback string, allow_temp boolean, `delete` string, write string"))
    assert [(r.fallback, r.allow_temp, r["delete"]) for r in c.orderBy("version").collect()] == [("dprint", True, "request"), ("reject", False, "deny")]


def test_commit_all_or_nothing(spark, tmp_path):
    files = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "path string, content string, sha256 string")
    cols = "path string, operation string, expected_sha256 string, content string, destination string, forced boolean"
    good = spark.createDataFrame([("a", "patch", "1", "new", None, None), ("b", "delete", "2", None, None, True), ("n", "write", None, "fresh", None, None)], cols)
    out = {r.path: r.content for r in changes.commit(good, files, str(tmp_path / "ok")).collect()}
    assert out == {"a": "new", "n": "fresh"}
    with pytest.raises(ValueError, match="stale"):
        changes.commit(spark.createDataFrame([("a", "patch", "9", "new", None, None), ("n", "write", None, "f", None, None)], cols), files, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()
    gone = changes.removed_directories(spark.createDataFrame([("d/e/f",)], "path string"), spark.createDataFrame([("d/x",)], "path string"))
    assert [r.dir for r in gone.collect()] == ["d/e"]
    assert changes.unified_hunk(["a", "b", "c"], ["a", "x", "c"]) == ["@@ -2,1 +2,1 @@", "-b", "+x"]
    twice = changes.stable_rewrite(files.select("path", "content"), lambda f: f.withColumn("content", F.upper("content")), str(tmp_path / "rw"))
    assert {r.path: r.content for r in twice.collect()} == {"a": "X", "b": "Y"}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "src long, dst long")
    assert sorted(map(tuple, graph.cycles(e).collect())) == [(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (6, 6)]
    assert {r.node: r.depth for r in graph.reach(e, spark.createDataFrame([(7,)], "node long")).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    path = lambda a, b: graph.shortest_path(e, spark.createDataFrame([(a, b)], "start long, goal long")).orderBy("position").collect()
    assert [r.node for r in path(7, 5)] == [7, 1, 2, 3, 4, 5]
    assert [tuple(r) for r in path(5, 7)] == [(0, 5, False), (1, 7, False)]


def test_scanners():
    assert scanning.nested_calls("// tools.p_x(1)\n'tools.p_y(2)'; tools.p_z({a: ')'})", "p_") == [{"tool": "z", "input": "{a: ')'}", "concurrent": False}]
    assert scanning.embedded_mutates("x({cmd: 'rm f'})") and not scanning.embedded_mutates("x({note: 'rm f'})") and scanning.embedded_mutates('{"command": "rm f"}')
    assert scanning.target_count('{"a": {"filePaths": [1, 2, 3]}, "files": {"x": 1}}') == 3 and scanning.target_count("{paths: ['a', 'b']}") == 2
    assert scanning.masked("a // b\n'c // d'", comments_only=True) == "a     \n'c // d'"
    assert scanning.request_paths('{"files": {"a": {"x": 1}}, "paths": ["b", "a"], "root": "c"}') == ["a", "b", "c"]


def test_replace_policy_and_blocks():
    with pytest.raises(replacing.MatchError, match="matcher_disabled"):
        replacing.replace_block("a b", "a", "x", allowed=("fuzzy",))
    assert replacing.replace_block("a\r\nb", "a", "x") == ("x\nb", "exact")
    assert replacing.parse_blocks("f.py\n<<<<<<< SEARCH\na\n=======\nb\n>>>>>>> REPLACE\n") == [replacing.Block("f.py", "a", "b")]
    with pytest.raises(replacing.MatchError, match="malformed"):
        replacing.parse_blocks("<<<<<<< SEARCH\na\n")


@settings(max_examples=60, deadline=None)
@given(st.text("ab\n ", max_size=30), st.text("ab\n ", min_size=1, max_size=4))
def test_replace_exact_is_literal(content_, needle):
    if content_.count(needle) == 1 and needle.strip():
        assert replacing.replace_block(content_, needle, "Z")[0] == content_.replace(needle, "Z")


def test_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta\nrepeated line\nx"), (2, "repeated line\n"), (3, None)], "k long, t string")
    codes = search.legend(docs, "k", "t")
    assert [r.line for r in codes.collect()] == ["repeated line"]
    back = {r.k: r.text for r in search.unsqueeze(search.squeeze(docs, "k", "t", codes), "k", codes).collect()}
    assert back == {1: "alpha beta\nrepeated line\nx", 2: "repeated line\n", 3: ""}
    assert [r.k for r in search.bm25(docs, "k", "t", "alpha line").orderBy(F.desc("score")).collect()] == [1, 2]
    assert search.auto_alpha("find_name") < search.auto_alpha("how does the parser recover from errors")
    p = search.prose(spark.createDataFrame([(1, "One two. Three!\n```\ncode here.\n```\nFour")], "k long, t string"), "k", "t").first()
    assert (p.sentences, p.words) == (3, 4)


def test_python_source(spark):
    s = goldens.sources(spark)
    assert sorted(r.name for r in pysource.surface(s).collect()) == ["Shape", "area"]
    assert [r.body for r in pysource.show(s, ["area"]).collect()] == ["def area(s):\n    return s.side(2) * s.side(2)"]
    assert [m["text"] for m in pysource.pattern_matches("f(1, 1); f(1, 2)", "f($X, $X)")] == ["f(1, 1)"]
    assert pysource.imports(goldens.SOURCE) == ["os", "typing"] and ("Shape.side", "helper") in pysource.calls(goldens.SOURCE)
    assert pysource.search(s, "s.side($$$A)").first().total == 2


def test_squeeze_shows_a_damaged_line(spark):
    docs = spark.createDataFrame([(1, "a line that repeats\nshort\n\na line that repeats"), (2, "a line that repeats")], "k long, t string")
    codes = search.legend(docs, "k", "t")
    squeezed = search.squeeze(docs, "k", "t", codes)
    assert sorted((r.k, r.place, r.code is None, r.line) for r in squeezed.collect()) == [(1, 0, False, None), (1, 1, True, "short"), (1, 2, True, ""), (1, 3, False, None), (2, 0, False, None)]
    damaged = squeezed.withColumn("line", F.when(F.col("line") == "short", "shorn").otherwise(F.col("line")))
    back = {r.k: r.text for r in search.unsqueeze(damaged, "k", codes).collect()}
    assert back[1] != docs.where("k = 1").first().t and back[2] == "a line that repeats"


def test_never_queried_operators(spark):
    """Drift, versions, conflicts, redaction, nearest vectors, strict scores, quota of refused items."""
    kv = lambda *rows: spark.createDataFrame(list(rows), "k string, v string")
    assert sorted(map(tuple, changes.drift(kv(("a", "1"), ("b", "2"), ("c", None)), kv(("a", "1"), ("b", "3")), "k", "v").collect())) == [("b", "unequal")]
    assert changes.same_multiset(kv(("a", "1"), ("a", "1")), kv(("a", "1"))).first().equal is False
    versions = spark.createDataFrame([("r", 2), ("r", 1), ("q", 2)], "root string, version int")
    assert {r.root: r.version for r in config_layers.effective_version(versions, "root").collect()} == {"r": 1, "q": 2}
    rules = lambda *rows: config_layers.conflicts(spark.createDataFrame(list(rows), "root string, rule string")).first()
    assert tuple(rules(("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"))) == (2, True) and tuple(rules(("a", "x"), ("b", "y"))) == (2, False)
    shown = config_layers.status(spark.createDataFrame([("api.token", "t"), ("color", "red")], "leaf string, value string"))
    assert {r.leaf: r.value for r in shown.collect()} == {"api.token": "[redacted]", "color": "red"}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])], "k long, v array<double>")
    assert [r.k for r in search.nearest(vectors, "k", "v", [1.0, 0.0], 3).collect()] == [1, 4, 3]
    strict = transcripts.score(goldens.sessions(spark), goldens.cases(spark), strict=True).collect()
    assert all(any(e.startswith("missing eval ID") for e in r.errors) for r in strict if r.evaluated_cases == 0)
    items = spark.createDataFrame([("s", 1, 6), ("s", 2, 9), ("s", 3, 4), ("s", 4, 1)], "session string, at long, size long")
    got = expiry.quota(items, "session", "size", "at", max_bytes=10, max_items=2).orderBy("at").collect()
    assert [(r.accepted, r.used_bytes, r.used_items) for r in got] == [(True, 6, 1), (False, 6, 1), (True, 10, 2), (False, 10, 2)]


def test_stored_needs_a_shared_folder():
    from types import SimpleNamespace

    from quarry.operators.shared import stored

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stored(SimpleNamespace(sparkSession=far))


def test_suite(spark):
    got = {r.problem for r in transcripts.suite_problems(goldens.cases(spark), ["file_hash"]).collect()}
    assert {"unknown surface: file_rename", "fewer than 3 cases: file_hash", "file_hash has no case of category negative"} <= got


def test_streams(spark, tmp_path, sf_dir):
    schema = "session string, action string, token string, file string, sha256 string, generation long, size long, at_ms long"
    rows = [("s", "preview", "t1", "f", "h", 1, 10, 0), ("s", "commit", "t1", "f", "h", 1, 0, 5), ("s", "commit", "t1", "f", "h", 1, 0, 6), ("s", "preview", "t2", "f", "h", 1, 10, 10), ("s", "commit", "t2", "f", "other", 1, 0, 11), ("s", "commit", "t2", "f", "h", 1, 0, 400_000), ("s", "preview", "t3", "f", "h", 1, 5 << 20, 400_001)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = expiry.receipts(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("receipts_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.token, r.outcome) for r in spark.table("receipts_out").collect())
    assert got == [("t1", "committed"), ("t1", "issued"), ("t1", "unknown_or_expired"), ("t2", "issued"), ("t2", "stale_or_missing_hash"), ("t2", "unknown_or_expired"), ("t3", "preview_receipt_limit")]
    loads = spark.createDataFrame([("r", 1, "a"), ("r", 3, None), ("r", 2, "b"), ("q", 1, None)], "root string, generation long, config string")
    assert {r.root: (r.generation, r.config, r.healthy) for r in expiry.registry_batch(loads).collect()} == {"r": (3, "b", False), "q": (1, None, False)}
    c = spark.createDataFrame([("s", 0, 100), ("s", 1, 2), ("s", 3, 100)], "session string, at_ms long, expires_ms long")
    assert [(r.pending, r.accepted) for r in expiry.challenges(c, 1).orderBy("at_ms").collect()] == [(0, True), (1, False), (1, False)]


def test_file_sources(spark, tmp_path):
    import hashlib

    from quarry.sources import files

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    got = {r.path.rsplit("/", 1)[1]: (r.sha256, r.size) for r in files.hashes(spark, str(tmp_path)).collect()}
    assert got == {"a.py": (hashlib.sha256(b"x = 1\n").hexdigest(), 6), "b.bin": (hashlib.sha256(b"\0\1").hexdigest(), 2)}
    assert {r.path.rsplit("/", 1)[1]: r.kind for r in files.inspected(spark, str(tmp_path)).collect()} == {"a.py": "source", "b.bin": "binary"}
    assert files.files(spark, str(tmp_path), "*.py").count() == 1
    now = files.hashes(spark, str(tmp_path))
    todo, drop = files.refreshed_index(spark.createDataFrame([(r.path, r.sha256 if r.path.endswith("py") else "old") for r in now.collect()], "path string, sha256 string"), now)
    assert todo.count() == 1 and drop.count() == 1
