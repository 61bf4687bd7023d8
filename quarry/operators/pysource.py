"""Maps, digests, symbol bodies and pattern search of Python sources, by the standard library's parser.

Other languages have no parser here; their rows get ``language_unsupported``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.lazy import pandas_udf

SYMBOLS = "array<struct<kind:string,name:string,parent:string,signature:string,start:int,end:int,public:boolean>>"


def symbols(source: str) -> list[dict]:
    """Definitions with 1-based line spans, in order of appearance."""
    out: list[dict] = []

    def walk(body: list[ast.stmt], parent: str) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if parent else "function"
                head = f"class {node.name}" if kind == "class" else f"def {node.name}({ast.unparse(node.args)})"
                name = f"{parent}.{node.name}" if parent else node.name
                out.append({"kind": kind, "name": name, "parent": parent or None, "signature": head, "start": node.lineno, "end": node.end_lineno, "public": not node.name.startswith("_")})
                if kind == "class":
                    walk(node.body, name)

    walk(ast.parse(source).body, "")
    return out


#: What the parser and walks over its trees raise on texts that are no source or are nested too deeply for them.
UNREADABLE = (SyntaxError, ValueError, RecursionError, MemoryError)


def error_count(source: str) -> int:
    try:
        ast.parse(source)
    except UNREADABLE:
        return 1
    return 0


def guarded(f: Callable[[str], object], source: str | None, failed: object) -> object:
    """``f`` of a source, or ``failed`` where it can't be read; one row never ends a job."""
    try:
        return f(source or "")
    except UNREADABLE:
        return failed


@pandas_udf(SYMBOLS)
def symbols_udf(source: pd.Series) -> pd.Series:
    return source.map(lambda s: guarded(symbols, s, None))


@pandas_udf("int")
def error_count_udf(source: pd.Series) -> pd.Series:
    return source.map(lambda s: error_count(s or "")).astype("int32")


def symbol_map(sources: DataFrame, path: str = "path", text: str = "text", max_members: int | None = None) -> DataFrame:
    """``path`` and its symbols, one row each; with ``max_members``, the first of each parent and ``cut``, how many are left out."""
    rows = sources.select(F.col(path).alias("path"), F.explode(symbols_udf(text)).alias("s")).select("path", "s.*")
    if max_members is None:
        return rows.withColumn("cut", F.lit(0).cast("long"))
    w = Window.partitionBy("path", "parent")
    ranked = rows.withColumn("_n", F.row_number().over(w.orderBy("start"))).withColumn("cut", F.greatest(F.lit(0), F.count(F.lit(1)).over(w) - max_members))
    return ranked.where(F.col("_n") <= max_members).drop("_n")


def digest(sources: DataFrame, path: str = "path", text: str = "text", max_members: int = 50, private: bool = False) -> DataFrame:
    """Names of public symbols, at most ``max_members`` of each parent."""
    m = symbol_map(sources, path, text, max_members)
    return (m if private else m.where("public")).select("path", "kind", "name", "cut")


def show(sources: DataFrame, wanted: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """Bodies of symbols whose dotted name ends with one of ``wanted``."""
    s = sources.select(F.col(path).alias("path"), F.col(text).alias("_text"), F.explode(symbols_udf(text)).alias("s"))
    hit = F.exists(F.array(*map(F.lit, wanted)), lambda w: (F.col("s.name") == w) | F.endswith(F.col("s.name"), F.concat(F.lit("."), w)))
    return s.where(hit).select("path", "s.name", "s.start", "s.end", F.array_join(F.slice(F.split("_text", "\n"), F.col("s.start"), F.col("s.end") - F.col("s.start") + 1), "\n").alias("body"))


def imports(source: str) -> list[str]:
    out: list[str] = []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Import):
            out += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append("." * node.level + (node.module or ""))
    return sorted(set(out))


@pandas_udf("array<string>")
def imports_udf(source: pd.Series) -> pd.Series:
    return source.map(lambda s: guarded(imports, s, []))


def calls(source: str) -> list[tuple[str, str]]:
    """(caller, callee name) pairs; a call outside any definition has the caller ``<module>``."""
    out: set[tuple[str, str]] = set()

    def walk(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                inner = child.name if owner == "<module>" else f"{owner}.{child.name}"
            if isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    out.add((owner, name))
            walk(child, inner)

    walk(ast.parse(source), "<module>")
    return sorted(out)


@pandas_udf("array<struct<caller:string,callee:string>>")
def calls_udf(source: pd.Series) -> pd.Series:
    return source.map(lambda s: guarded(lambda t: [{"caller": a, "callee": b} for a, b in calls(t)], s, []))


def surface(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Public top-level names: those of ``__all__`` where a module states it, else the public definitions."""

    @F.pandas_udf("array<string>")
    def listed(source: pd.Series) -> pd.Series:
        def one(s: str | None) -> list[str] | None:
            if error_count(s or ""):
                return []
            for node in ast.parse(s or "").body:
                if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
                    return [e.value for e in getattr(node.value, "elts", []) if isinstance(e, ast.Constant)]
            return None

        return source.map(one)

    top = F.transform(F.filter(symbols_udf(text), lambda s: s.parent.isNull() & s.public), lambda s: s["name"])
    return sources.select(F.col(path).alias("path"), F.explode(F.coalesce(listed(text), top)).alias("name"))


def _matches(source: str, pattern: str) -> list[tuple[ast.expr, dict[str, list[ast.AST]]]]:
    """Expressions that match a pattern, in order of place, with the nodes that its variables stand for."""
    wanted = ast.parse(pattern.replace("$$$", "META_MANY_").replace("$", "META_ONE_"), mode="eval").body

    def same(p: object, n: object, bound: dict[str, list[ast.AST]]) -> bool:
        if isinstance(p, ast.Name) and p.id.startswith("META_ONE_"):
            if not isinstance(n, ast.expr):
                return False
            return ast.dump(bound.setdefault(p.id, [n])[0]) == ast.dump(n)
        if type(p) is not type(n):
            return False
        if isinstance(p, ast.AST):
            return all(same(getattr(p, f, None), getattr(n, f, None), bound) for f in p._fields if f != "ctx")
        if isinstance(p, list):
            if p and isinstance(p[-1], ast.Name) and p[-1].id.startswith("META_MANY_"):
                bound[p[-1].id] = n[len(p) - 1 :]
                return len(n) >= len(p) - 1 and all(same(a, b, bound) for a, b in zip(p[:-1], n, strict=False))
            return len(p) == len(n) and all(same(a, b, bound) for a, b in zip(p, n, strict=True))
        return p == n

    out = []
    for node in ast.walk(ast.parse(source)):
        bound: dict[str, list[ast.AST]] = {}
        if isinstance(node, ast.expr) and same(wanted, node, bound):
            out.append((node, bound))
    return sorted(out, key=lambda m: (m[0].lineno, m[0].col_offset))


def pattern_matches(source: str, pattern: str) -> list[dict]:
    """Places where an expression pattern matches; ``$X`` stands for any expression, equal names for equal ones, ``$$$X`` for any arguments."""
    return [{"line": n.lineno, "column": n.col_offset + 1, "text": (ast.get_source_segment(source, n) or "")[:200]} for n, _ in _matches(source, pattern)]


def rewrite_first(source: str, pattern: str, template: str) -> tuple[int, str]:
    """The number of matches, and the source with the first replaced by the template, whose variables take the matched text.

    A pattern that is no expression matches nothing.
    """
    try:
        found = _matches(source, pattern)
    except UNREADABLE:
        return 0, source
    if not found:
        return 0, source
    node, bound = found[0]
    shown = {k: ", ".join(ast.get_source_segment(source, n) or "" for n in nodes) for k, nodes in bound.items()}
    text = re.sub(r"(\$\$\$|\$)(\w+)", lambda m: shown.get(("META_MANY_" if m[1] == "$$$" else "META_ONE_") + m[2], m[0]), template)
    # Columns of the parser count bytes of a line; its lines end at any newline.
    raw = source.encode()
    starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", raw))]
    first, last = starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset
    return len(found), (raw[:first] + text.encode() + raw[last:]).decode()


def search(sources: DataFrame, pattern: str, path: str = "path", text: str = "text", shown: int = 10) -> DataFrame:
    """``path, matches`` (at most ``shown``), ``total`` of files with a match."""

    @F.pandas_udf("array<struct<line:int,column:int,text:string>>")
    def run(source: pd.Series) -> pd.Series:
        return source.map(lambda s: guarded(lambda t: pattern_matches(t, pattern), s, []))

    found = sources.select(F.col(path).alias("path"), run(text).alias("m")).where(F.size("m") > 0)
    return found.select("path", F.slice("m", 1, shown).alias("matches"), F.size("m").cast("long").alias("total"))
