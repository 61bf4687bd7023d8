"""Small inline inputs for operators that the fixed tables can't exercise."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def cases(spark: SparkSession) -> DataFrame:
    rows = [(71, "file_hash", "positive", ["file_hash"], ["file_patch"], ["hash is returned", "one call", "no change"]), (72, "file_hash", "variant", ["file_hash", "file_read"], [], ["a", "b", "c"]), (92, "file_rename", "negative", ["file_rename"], [], ["does not overwrite", "b", "c"])]
    return spark.createDataFrame(rows, "id long, surface string, category string, required_tools array<string>, forbidden_tools array<string>, assertions array<string>")


def _record(kind: str, **payload: object) -> str:
    return json.dumps({"type": "response_item", "payload": {"type": kind, **payload}})


def _user(text: object) -> str:
    return _record("message", role="user", content=text)


def _call(id_: str, name: str, given: object) -> str:
    return _record("custom_tool_call", call_id=id_, name=name, input=given)


def _answer(id_: str, out: object, **more: object) -> str:
    return _record("custom_tool_call_output", call_id=id_, output=out, **more)


def sessions(spark: SparkSession) -> DataFrame:
    hash_ = "mcp__tools__file_hash"
    parallel = "await Promise.all([tools.mcp__tools__file_hash({filePaths: ['a', 'b']}), tools.mcp__tools__file_patch({x: 1})]); tools.mcp__tools__file_read({files: [1]}) // tools.mcp__tools__none()"
    rows = [
        ("malformed", "not-json\n\n" + _answer("orphan", "x")),
        ("direct", _user("run eval:999 now") + "\n" + _call("a", hash_, {"filePaths": ["x"]}) + "\n" + _answer("a", "hash output")),
        ("duplicate", "\n".join([_call("n", hash_, {"filePaths": []})] * 2 + [_answer("n", "ok")] * 2)),
        ("mixed", "\n".join([_user("eval:71"), _call("a", hash_, {"filePaths": ["x", "y"]}), _answer("a", "done"), _user("eval:999"), _call("b", hash_, {"filePaths": ["x"]}), _answer("b", "done")])),
        ("efficiency", "\n".join([_call("e", "exec", parallel), _answer("e", [{"text": "ok"}]), _call("d1", hash_, {"filePaths": ["a", "b"]}), _answer("d1", "ok"), _call("d2", hash_, {"filePaths": ["a"]}), _answer("d2", {"isError": True, "text": '"code": "path_denied"'})])),
        ("shapes", "\n".join([_user("plain"), _user({}), _user([{"text": "x"}, "y", 3])])),
        ("null", "null\n" + json.dumps({"type": "turn_context", "payload": {"cwd": "/w", "workspace_roots": ["/w", "/v"]}})),
    ]
    return spark.createDataFrame(rows, "session string, text string")


def replacements(spark: SparkSession) -> DataFrame:
    header = "".join(f"// header line {i}\n" for i in range(20))
    rows = [
        ("exact", "a old b", "old", "$$$ARGS"),
        ("ambiguous", "x x", "x", "y"),
        ("append", "first", "", "second"),
        ("empty", "first", "", ""),
        ("whitespace", "if (a)  {\n\treturn 1;\n}\n", "if (a) {\n  return 1;\n}", "done"),
        ("indentation", "def f():\n  one()\n  two()\n", "      one()\n      two()", "  three()"),
        ("fuzzy", "const importantValue = 1;\n", "const importantVlue = 1;", "const importantValue = 2;"),
        ("fuzzy_long", header + "const veryLongTargetNameForThisCase = compute(alpha, beta);\n", "const veryLongTargetNameForThisCase = compute(alpha, bet);", "const x = 2;"),
        ("none", "completely different", "zzzzzzzzzzzzzzzz", "y"),
    ]
    return spark.createDataFrame(rows, "name string, content string, search string, replacement string")


def events(spark: SparkSession) -> DataFrame:
    e = lambda **k: json.dumps(k)
    rows = [
        ("blocked", e(tool_name="Danger", tool_input={})),
        ("allowed", e(tool_name="ns.Reader", tool_input={"command": "rm x"})),
        ("direct", e(tool_name="Edit", tool_input={})),
        ("shell", e(tool_name="Bash", tool_input={"command": "sed -i s/a/b/ f"})),
        ("shell_read", e(toolName="bash", toolInput={"cmd": "cat f | grep rm"})),
        ("executor_nested", e(name="exec", input="tools.run({cmd: 'rm -rf x'})")),
        ("executor_plain", e(name="exec", input="rm x")),
        ("other", e(name="search", input={"command": "rm x"})),
    ]
    return spark.createDataFrame(rows, "name string, event string")


#: Command lines and whether they change files.
SHELL = {
    "cat f": False, "rm f": True, "sudo -u root rm f": True, "env A=1 touch f": True, "timeout 5 mv a b": True, "sed s/a/b/ f": False,
    "sed -i s/a/b/ f": True, "sed -ni p f": True, "find . -delete": True, "find . -exec rm {} ;": True, "find . -name rm": False, "git rm f": False,
    "bash -c 'rm f'": True, "bash -lc 'ls'": False, "python3 -c \"open('f', 'w').write('x')\"": True, "python3 -c \"print(open('f').read())\"": False,
    "node -e \"fs.writeFileSync('f', 'x')\"": True, "xargs rm": True, "echo 'rm f'": False, "echo $(rm f)": True, "command -v rm": False,
    "ls; rm f": True, "echo \"unterminated": False, "eval rm f": True, "env -S 'rm f'": True, "ls | tee out": False, "cat <<< rm": False, "": False,
    "cat <<EOF\nrm x\nEOF": False, "cat <<EOF\n$(rm x)\nEOF": True, "cat <<'EOF'\n$(rm x)\nEOF": False, "cat <<-E\n\trm x\n\tE\nrm y": True, "cat <<A <<B\nrm\nA\nrm\nB\nls": False,
    "function f { rm x; }": True, "f() { rm x; }": True, "coproc rm x": True, "coproc P { rm x; }": True, "coproc cat": False,
}


def shell(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in SHELL], "command string")


SOURCE = '''"""Module."""
import os
from typing import Any

__all__ = ["Shape", "area"]


class Shape:
    def side(self, n: int = 1) -> int:
        return helper(n)

    def _hidden(self):
        return os.getcwd()


def area(s):
    return s.side(2) * s.side(2)


def helper(n):
    return n
'''


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("shape.py", SOURCE), ("bad.py", "def ("), ("empty.py", "")], "path string, text string")


def batch(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = [("a", "patch", "1", None, None), ("b", "delete", "2", None, False), ("c", "rename", "3", "d", None), ("e", "rename", "5", "f", None), ("g", "rename", "7", "f", None), ("h", "patch", "8", None, None), ("i", "delete", "9", None, True)]
    f = [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5"), ("g", "old"), ("i", "9"), ("u", "10")]
    return (
        spark.createDataFrame(b, "path string, operation string, expected_sha256 string, destination string, forced boolean"),
        spark.createDataFrame(f, "path string, sha256 string"),
        spark.createDataFrame([("u", "b"), ("u", "i"), ("i", "b")], "file string, target string"),
    )
