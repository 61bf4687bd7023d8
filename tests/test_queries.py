"""Every query against its oracle; those without one against inline goldens."""

import pytest
from oracle import compare

from quarry.plans import catalogue, goldens


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_oracle(spark, sf_dir, name):
    compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLES[name], sf_dir)


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["doc_id", "sha256", "size", "n_lines", "content", "has_more", "kind"] and df.count() > 0


def test_byte_cap(spark, sf_dir):
    for r in catalogue.QUERIES["byte_cap"](spark, sf_dir).collect():
        assert len(r.content.encode()) <= 1024 + 2 and (r.has_more or not r.truncated)


def test_shell_goldens(spark, sf_dir):
    got = {r.command: r.mutates for r in catalogue.EXAMPLES["shell_mutates"](spark, sf_dir).collect()}
    assert got == goldens.SHELL


def test_hook_goldens(spark, sf_dir):
    got = {r.name: (r.denied, r.rule) for r in catalogue.EXAMPLES["hook_decision"](spark, sf_dir).collect()}
    assert got == {
        "blocked": (True, "blocked"), "allowed": (False, "allowed"), "direct": (True, "direct"), "shell": (True, "shell"), "shell_read": (False, "none"),
        "executor_nested": (True, "nested"), "executor_plain": (False, "none"), "other": (False, "none"),
    }


def test_cascade_goldens(spark, sf_dir):
    got = {r.name: (r.method, r.error, r.content) for r in catalogue.EXAMPLES["cascade_method"](spark, sf_dir).collect()}
    assert got["exact"] == ("exact", None, "a $$$ARGS b")
    assert got["ambiguous"][1] == "ambiguous" and got["empty"][1] == "empty_search" and got["none"][1] == "no_match"
    assert got["append"] == ("append", None, "first\nsecond")
    assert got["whitespace"][:1] == ("whitespace",) and got["whitespace"][2] == "done"
    assert got["indentation"] == ("relative-indentation", None, "def f():\n  three()\n")
    assert got["fuzzy"] == ("fuzzy", None, "const importantValue = 2;\n")
    assert got["fuzzy_long"][0] == "fuzzy" and got["fuzzy_long"][2].endswith("const x = 2;\n")


def test_transcript_goldens(spark, sf_dir):
    got = {r.session: r for r in catalogue.EXAMPLES["transcript_goldens"](spark, sf_dir).collect()}
    assert got["malformed"].errors == "line 1: invalid JSON; unmatched output ID: orphan" and not got["malformed"].passed
    d = got["direct"]
    assert (d.batches, d.evaluated_cases, d.tool_calls, d.output_chars) == (1, 1, "file_hash=1", 11) and "unknown eval ID: 999" in d.errors
    assert "duplicate call ID: n" in got["duplicate"].errors and "duplicate output ID: n" in got["duplicate"].errors
    m = got["mixed"]
    assert (m.evaluated_cases, m.verified_assertions, m.tool_calls) == (2, 3, "file_hash=2")
    e = got["efficiency"]
    assert (e.invocations, e.batch_density, e.parallel_read_only_calls, e.mutation_calls) == (5, 0.4, 1, 1)
    assert e.error_codes == "path_denied=1"
    assert got["shapes"].passed and got["shapes"].evaluated_cases == 0
    assert got["null"].errors == "line 1: invalid JSON"


def test_preflight_goldens(spark, sf_dir):
    got = sorted((r.path, r.code) for r in catalogue.EXAMPLES["preflight_errors"](spark, sf_dir).collect())
    assert got == [("b", "still_imported"), ("c", "destination_exists"), ("e", "duplicate_destination"), ("g", "stale_or_missing_hash"), ("h", "not_found")]


def test_python_symbols(spark, sf_dir):
    got = sorted((r.kind, r.name, r.start, r.end) for r in catalogue.EXAMPLES["python_symbols"](spark, sf_dir).collect())
    assert ("class", "Shape", 8, 13) in got and ("method", "Shape.side", 9, 10) in got and len(got) == 5


def test_whole_graph_has_every_adjacent_pair(spark, sf_dir):
    """Edges, cycles and reach over all lines of all orders, by brute force."""
    orders: dict = {}
    for r in catalogue.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect():
        orders.setdefault(r[0], []).append(tuple(r)[1:])
    edges = {(a[2], b[2]) for lines in orders.values() for a, b in zip(sorted(lines), sorted(lines)[1:])}
    assert {(r.src, r.dst) for r in catalogue.QUERIES["graph_edges"](spark, sf_dir).collect()} == edges
    nodes = {n for e in edges for n in e}
    reached = {}
    for n in nodes:
        seen, new = set(), {b for a, b in edges if a == n}
        while new:
            seen |= new
            new = {b for a, b in edges if a in new} - seen
        reached[n] = seen
    mutual = {n: {m for m in reached[n] if n in reached[m]} for n in nodes}
    assert {(r.component, r.node) for r in catalogue.QUERIES["cycles"](spark, sf_dir).collect()} == {(min(m), n) for n, m in mutual.items() if m}
    top = max(r.s_suppkey for r in catalogue.table(spark, sf_dir, "supplier").collect())
    assert {r.node for r in catalogue.QUERIES["closure"](spark, sf_dir).collect()} == reached[top]
