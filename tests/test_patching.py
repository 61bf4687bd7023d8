"""Patches, roots, proofs, grants, migration and assertions on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import migrating, paths
from quarry.operators import assertions, changes, graph, patching, policy, pysource, transcripts
from quarry.plans import catalogue
from quarry.streaming import expiry

RULES = "path string, ordinal int, strategy string, search string, replace string, expected_matches int, expected_sha256 string"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a.py", "x = f(1, g('é'))\nprint(x)\n"), ("b.txt", "old\nkeep\n"), ("c.txt", "c c"), ("u.py", "y = 1\n")]
    return spark.createDataFrame(rows, "path string, content string").withColumn("sha256", F.sha2("content", 256))


def test_patch_rules_work_in_order_and_commit_whole(spark, files, tmp_path):
    sha = {r.path: r.sha256 for r in files.collect()}
    block = "<<<<<<< SEARCH\nold\n=======\nnew\n>>>>>>> REPLACE"
    rules = spark.createDataFrame([("a.py", 2, "aider_block", "h(g('é'), 1)", "z", None, sha["a.py"]), ("a.py", 1, "ast", "f($A, $$$R)", "h($$$R, $A)", None, sha["a.py"]), ("b.txt", 1, "aider_block", None, block, None, sha["b.txt"])], RULES)
    p = patching.preview(rules, files, generation=3)
    got = {r.path: r for r in p.collect()}
    assert got["a.py"].content == "x = z\nprint(x)\n" and got["a.py"].methods == ["ast", "exact"]
    assert got["b.txt"].diff == ["@@ -1,1 +1,1 @@", "-old", "+new"]
    assert len({r.receipt for r in got.values()} | {r.receipt for r in patching.preview(rules, files, generation=4).collect()}) == 4
    out = {r.path: r.content for r in patching.commit(p, files, str(tmp_path / "next")).collect()}
    assert out == {"a.py": "x = z\nprint(x)\n", "b.txt": "new\nkeep\n", "c.txt": "c c", "u.py": "y = 1\n"}
    later = files.withColumn("sha256", F.when(F.col("path") == "b.txt", F.lit("0")).otherwise(F.col("sha256")))
    with pytest.raises(ValueError, match="b.txt: stale_or_missing_hash"):
        patching.commit(p, later, str(tmp_path / "stale"))
    actions = {(r.token, r.size) for r in patching.preview_actions(p, "s", 5).collect()}
    assert actions == {(r.receipt, len(r.content.encode())) for r in got.values()}


def test_patch_errors(spark, files, tmp_path):
    sha = {r.path: r.sha256 for r in files.collect()}
    rows = [("a.py", 1, "ast", "zz($A)", "q", None, sha["a.py"]), ("b.txt", 1, "none", "old", "x", None, sha["b.txt"]), ("c.txt", 1, "aider_block", "c", "d", None, sha["c.txt"]), ("m", 1, "aider_block", "c", "d", None, "0"), ("u.py", 1, "ast", "1", "2", None, None)]
    p = patching.preview(spark.createDataFrame(rows, RULES), files)
    assert {r.path: (r.failed_rule, r.error) for r in p.collect()} == {"a.py": (1, "match_count"), "b.txt": (1, "unknown_strategy"), "c.txt": (1, "ambiguous"), "m": (None, "not_found"), "u.py": (None, "stale_or_missing_hash")}
    with pytest.raises(ValueError, match="a.py: match_count"):
        patching.commit(p, files, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    assert patching.preview(spark.createDataFrame([], RULES), files).count() == 0
    two = [("a.py", 1, "ast", "$A", "q", 10, sha["a.py"])]
    n = len(pysource.pattern_matches("x = f(1, g('é'))\nprint(x)\n", "$A"))
    two = [(*two[0][:5], n, two[0][6])]
    assert patching.preview(spark.createDataFrame(two, RULES), files).first().error == "expected_matches_not_one"


def test_rewrite_first():
    assert pysource.rewrite_first("a = é(1) + f(2)\nb = f(3)\n", "f($X)", "[$X, $Y]") == (2, "a = é(1) + [2, $Y]\nb = f(3)\n")
    assert pysource.rewrite_first("f(1, 1); f(1, 2)", "f($X, $X)", "g($X)") == (1, "g(1); f(1, 2)")
    assert pysource.rewrite_first("x", "def (", "y") == (0, "x")


def test_formatter(spark):
    df = spark.createDataFrame([("a", "b\na\n"), ("n", None)], "path string, content string")
    r = df.select("path", patching.formatter_udf(["sort"])("path", "content").alias("s"), patching.formatter_udf(["no-such-program"])("path", "content").alias("m"), patching.formatter_udf(["false"])("path", "content").alias("f"), patching.formatter_udf(["echo", "{path}"])("path", "content").alias("e"))
    a, n = sorted(r.collect())
    assert (a.s.content, a.s.error, a.m.content, a.m.error, a.f.error, a.e.content) == ("a\nb\n", None, "b\na\n", "formatter_failed: FileNotFoundError", "formatter_failed: exit 1", "a\n")
    assert n.s.content is None


def test_resolve_and_relative(spark):
    import posixpath

    cases = [("/w", "a/../b"), ("/w", "/x//y/."), ("/w/v", "../../../q"), ("/", ""), ("/w", "."), ("/w/v", "../u/t")]
    r = spark.createDataFrame(cases, "r string, p string").select("r", "p", paths.resolve(F.col("r"), F.col("p")).alias("x")).select("*", paths.relative(F.col("r"), F.col("x")).alias("y")).collect()
    for row in r:
        want = posixpath.normpath(posixpath.join(row.r, row.p))
        below = posixpath.relpath(want, row.r)
        assert row.x == want and row.y == ("" if below == "." else below)


def test_lock_queue_skips_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "a"), (None, "a"), (3, None)], "batch long, path string")
    assert sorted(tuple(r) for r in patching.lock_queue(df).select("batch", "path", "place", "waits_for").collect()) == [(1, "a", 0, None), (1, "b", 1, None), (2, "a", 0, 1)]


def test_selected_roots(spark):
    roots = spark.createDataFrame([("s", "/w/", 0), ("s", "/v", 1), ("t", "/w", 0), ("t", "/", 1), ("u", "/a", 2), ("u", "/b", 1)], "session string, root string, place int")
    asked = spark.createDataFrame([("s", "/v/x/../y"), ("s", "/vv"), ("t", "/q"), ("u", "rel"), ("u", None), ("none", "/v")], "session string, path string")
    assert sorted(tuple(r) for r in policy.selected_roots(roots, asked).collect()) == [("s", "/v"), ("t", "/"), ("u", "/b")]


def test_rename_proof_awkward(spark):
    req = spark.createDataFrame([("c", "a", "b"), ("d", "a", None), ("e", "a", "b"), ("e", "x", "y")], "call string, source string, destination string")
    res = spark.createDataFrame([("c", "/w/a", "/w/b", True), ("d", "a", "/w/b", True), ("e", "a", "b", True)], "call string, file string, destination_path string, renamed boolean")
    assert {r.call: r.proven for r in changes.rename_proof(req, res, "/w").collect()} == {"c": True, "d": False, "e": False}


def test_subtypes_and_callers(spark):
    bases = spark.createDataFrame([("m.B", "m.A"), ("m.C", "m.B"), ("n.D", "n.A"), ("m.X", "m.AA"), (None, "m.A")], "type string, base string")
    assert sorted(tuple(r) for r in graph.subtypes(bases, "A").collect()) == [("m.B", 1), ("m.C", 2), ("n.D", 1)]
    assert sorted(tuple(r) for r in graph.subtypes(bases, "m.A", direct=True).collect()) == [("m.B", 1)]
    symbols = spark.createDataFrame([("m.A.f",), ("m.B.f",), ("m.g",)], "name string")
    calls = spark.createDataFrame([("x", "f"), ("y", "A.f"), ("y", "A.f"), ("z", "g"), ("w", "nf")], "caller string, callee string")
    assert [tuple(r) for r in graph.callers_of(calls, symbols, "A.f").orderBy("caller").collect()] == [("x", "f", True, 2), ("y", "A.f", False, 2)]
    assert [r.caller for r in graph.callers_of(calls, symbols, "f", hide_ambiguous=True).collect()] == ["y"]


def _grants(rows, ttl):
    """Every action in order of its number, all states in dictionaries."""
    opened, session, once, declined, always, out = {}, set(), set(), set(), set(), []
    for a in sorted(rows, key=lambda r: r.seq):
        k = (a.session, a.grant)
        live = k in opened and a.at_ms < opened[k] + ttl
        if a.action == "request":
            if a.grant in always or k in session or (k, a.invocation) in once:
                out.append((a.seq, "allowed"))
            elif k in declined:
                out.append((a.seq, "denied"))
            else:
                out.append((a.seq, "asked"))
                if not live:
                    opened[k] = a.at_ms
            declined.discard(k)
        elif live:
            del opened[k]
            declined.discard(k)
            {"allow_once": lambda: once.add((k, a.invocation)), "allow_session": lambda: session.add(k), "always_allow": lambda: always.add(a.grant), "decline": lambda: declined.add(k)}[a.action]()
    return out


@pytest.mark.parametrize("ttl", [300_000, 10**9])
def test_grants(spark, sf_dir, ttl):
    actions = catalogue._approvals(spark, sf_dir)
    got = sorted((r.seq, r.outcome) for r in expiry.grants(actions, ttl).collect())
    assert got == _grants(actions.collect(), ttl)
    few = [(1, "s", "i", "g", 0, "request"), (2, "s", "i", "g", 1, "allow_once"), (3, "s", "i", "g", 2, "request"), (4, "s", "j", "g", 3, "request"), (5, "s", "j", "g", 4, "decline"), (6, "s", "j", "g", 5, "request"), (7, "s", "j", "g", 6, "request"), (8, "s", "j", "g", 6 + ttl, "allow_session"), (9, "s", "j", "g", 7 + ttl, "request"), (10, "s", "j", "g", 8 + ttl, "always_allow"), (11, "t", "k", "g", 9 + ttl, "request"), (12, "t", "k", "h", 9 + ttl, "allow_session"), (13, "t", "k", "h", 9 + ttl, "request")]
    df = spark.createDataFrame(few, "seq long, session string, invocation string, grant string, at_ms long, action string")
    assert {r.seq: r.outcome for r in expiry.grants(df, ttl).collect()} == {1: "asked", 3: "allowed", 4: "asked", 6: "denied", 7: "asked", 9: "asked", 11: "allowed", 13: "asked"}
    assert expiry.grants(df.limit(0), ttl).count() == 0


def test_migrate_keeps_comments_and_line_ends(spark):
    src = '# top\r\nversion = 1 # v\r\n[workspace]\r\nroots = ["a", "/b"]\r\n[safety]\r\nallow_any_path = true # gone\r\n[[formatting.formatters]]\r\nid = "x"\r\n[[formatting.formatters]]\r\nmode = "in-place"\r\n'
    out, version, changed, warnings = migrating.migrate(src, "/w/c.toml")
    assert out.count("\n") == out.count("\r\n") and "# top" in out and "version = 2 # v" in out and "allow_any_path" not in out
    assert (version, changed, len(warnings)) == (1, True, 1)
    import tomllib

    c = tomllib.loads(out)
    assert [r["path"] for r in c["paths"]] == ["/w/a", "/b", "/tmp", "/"]
    assert c["formatting"]["formatters"] == [{"id": "x", "enabled": True, "mode": "stdout"}, {"id": "legacy-2", "enabled": True, "mode": "in-place"}]
    assert c["formatting"]["fallback"] == "dprint" and len(c["files"]["patch"]["aider_matchers"]) == 4
    assert migrating.migrate(out, "/w/c.toml") == (out, 2, False, [])
    got = spark.createDataFrame([("version = 3",), ("= x",), (None,)], "s string").select(migrating.migrate_udf("s", F.lit("/c")).alias("m")).select("m.*").collect()
    assert [r.error for r in got] == ["unsupported_version", "invalid_toml", None] and got[2].source.startswith("version = 2")


def test_assertions_by_phrase(spark):
    call = lambda tool, given, concurrent=False: (0, tool, given, concurrent)
    entry = '{"files": {"a": {"destination": "b", "expectedSha256": "0"}}}'
    pair = '{"files": {"a": {"destination": "b"}, "c": {"destination": "d"}}}'
    said = json.dumps({"files": {"/w/a": {"destinationPath": "/w/b", "renamed": True}}})
    table = [
        ("It does not overwrite", [call("file_rename", entry)], "destination already exists", True),
        ("It does not overwrite", [], "destination already exists", False),
        ("Reports each source and destination", [call("file_rename", entry)], said, True),
        ("Reports each source and destination", [call("file_rename", pair)], said, False),
        ("never calls bad", [call("bad", "{x: 1}")], "x", False),
        ("never calls bad", [call("good", "{x: 1}")], "x", True),
        ("Uses bounded lines", [call("file_read", "{files: [{filePath: 'a', lines: [1, 2]}]}")], "x", True),
        ("Sets maxBytes", [call("file_read", "{files: []}")], "x", False),
        ("All declared files in a batch", [call("file_rename", pair)], "x", True),
        ("All declared files in a batch", [call("file_rename", entry)], "x", False),
        ("One keyed call", [call("file_hash", "{filePaths: ['a', 'b']}")], "x", True),
        ("Takes a fresh hash", [(0, "file_hash", "{}", False), (1, "file_write", "{}", False)], "x", True),
        ("Takes a fresh hash", [(0, "file_write", "{}", False), (1, "file_hash", "{}", False)], "x", False),
        ("preview true first", [call("file_patch", "{preview: true}")], "x", True),
        ("A dry run", [call("run", "{write: true}")], "x", False),
        ("exactly one match", [call("file_patch", "{expectedMatches: 1}")], "x", True),
        ("ast strategy", [call("file_patch", "{patchStrategy: 'aider_block'}")], "x", False),
        ("Gives output", [call("x", "{}")], " \n", False),
        ("Something else", [call("need", "{}")], "x", True),
        ("Something else", [], "x", False),
    ]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(table)], "i int, a string, calls array<struct<number:int,tool:string,input:string,concurrent:boolean>>, out string, want boolean")
    need = F.when(F.col("a") == "Something else", F.array(F.lit("need"))).otherwise(F.array().cast("array<string>"))
    got = df.select("i", "a", "want", assertions.holds(F.col("a"), F.col("calls"), F.col("out"), need, F.array(F.lit("bad")), F.lit(False), F.lit("/w"), F.lit(True), "p__").alias("got")).collect()
    assert [(r.i, r.a) for r in got if r.got != r.want] == []


def test_paths_of_calls_have_to_stay_within_roots(spark):
    rows = [("file_read", "{filePath: '/w/a'}", 0), ("file_read", "{filePath: '/w/../x/a'}", 1), ("file_read", "{filePath: '/tmp/a'}", 0), ("search", "{path: '/tmp/a'}", 1), ("file_read", "{paths: ['a/../../b', 'c']}", 1), ("map", "{paths: ['/v/x', '/ww/x', 'plain']}", 1)]
    df = spark.createDataFrame(rows, "tool string, input string, n int")
    calls = F.array(F.struct(F.lit(0).alias("number"), "tool", "input", F.lit(False).alias("concurrent")))
    roots = F.array(F.lit("/w"), F.lit("/v"))
    got = df.select("n", assertions.path_problems(calls, roots).alias("p"), assertions.path_problems(calls, roots, assertions.Access(any_path=True)).alias("q")).collect()
    assert [len(r.p) for r in got] == [r.n for r in got] and [len(r.q) for r in got] == [0, 0, 0, 1, 0, 1]
    assert got[3].p == ["search input escapes transcript workspace roots: /tmp/a"]


def test_evaluate_files_and_expected_output(spark):
    inv = F.array(F.struct(F.lit("search").alias("tool"), F.col("given").alias("input"), F.lit(False).alias("concurrent")))
    rows = [("ok", "{query: 'a.txt'}", "found a.txt here"), ("untargeted", "{query: 'b'}", "found a.txt"), ("unproven", "{query: 'a.txt'}", "found"), ("blank", "{}", "a.txt"), ("outside", "{query: 'a.txt', path: '/x/y'}", "a.txt")]
    b = spark.createDataFrame(rows, "session string, given string, output string").select("session", F.lit(1).alias("line"), inv.alias("invocations"), F.array(F.lit(1).cast("long")).alias("eval_ids"), F.lit(False).alias("failed"), "output")
    cases = spark.createDataFrame([(1, ["search"], [], ["reports it", "anything"], ["a.txt"], "finds it")], "id int, required_tools array<string>, forbidden_tools array<string>, assertions array<string>, files array<string>, expected_output string")
    declared = spark.createDataFrame([(r[0], "/w") for r in rows], "session string, root string")
    got = {r.session: (r.problem, r.assertions) for r in transcripts.evaluate(b, cases, declared).collect()}
    assert got == {"ok": (None, 2), "untargeted": ("input does not target required file: a.txt", 0), "unproven": ("output does not prove file result: a.txt", 0), "blank": ("input lacks required keys", 0), "outside": ("search input escapes transcript workspace roots: /x/y", 0)}


def test_bodies_of_a_trace(spark):
    steps = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "position int, node string")
    bodies = spark.createDataFrame([("a", "1\n2\n3"), ("b", "z"), ("b", "y")], "node string, body string")
    got = {r.node: (r.position, r.body, r.cut) for r in graph.with_bodies(steps, bodies, max_lines=2).collect()}
    assert got == {"a": (0, "1\n2", True), "b": (1, "y", False), "c": (2, None, None)}


def test_catalogue_problems(spark):
    inv = spark.createDataFrame([("s", 0, "trace", "{from: 'a'}"), ("s", 1, "trace", '{"from": "a", "to": "b"}'), ("s", 2, "nope", "{}"), ("t", 0, "search", "{}")], "session string, number int, tool string, input string")
    assert sorted(tuple(r) for r in transcripts.catalogue_problems(inv).collect()) == [("s", 0, "trace lacks to"), ("s", 2, "unknown tool: nope"), ("t", 0, "search lacks query")]
