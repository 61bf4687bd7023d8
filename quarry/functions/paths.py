"""Lexical path functions, glob translation and selector expansion."""

from __future__ import annotations

import functools
import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of each known extension.
LANGUAGES = {
    ".cc": "cpp", ".cjs": "javascript", ".cpp": "cpp", ".cs": "csharp", ".cxx": "cpp", ".ddl": "sql", ".dml": "sql",
    ".go": "go", ".hh": "cpp", ".hpp": "cpp", ".java": "java", ".js": "javascript", ".json": "json", ".jsonc": "json",
    ".jsx": "javascript", ".kt": "kotlin", ".kts": "kotlin", ".markdown": "markdown", ".md": "markdown",
    ".mdown": "markdown", ".mdx": "markdown", ".mjs": "javascript", ".php": "php", ".py": "python", ".pyi": "python",
    ".rb": "ruby", ".rs": "rust", ".scala": "scala", ".sql": "sql", ".toml": "toml", ".ts": "typescript",
    ".tsx": "tsx", ".yaml": "yaml", ".yml": "yaml",
}
DOCUMENTS = (".json", ".jsonc", ".toml", ".yaml", ".yml")
EXPANSION_LIMIT, RANGE_LIMIT = 256, 64


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/+$", ""), "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; none for names that only start with a dot."""
    return F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    return F.element_at(F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in LANGUAGES.items())), extension(path))


def within(root: Column, target: Column) -> Column:
    """Containment by whole segments; a child whose name starts with two dots counts as outside."""
    base = F.regexp_replace(root, "/+$", "")
    below = F.startswith(target, F.concat(base, F.lit("/"))) & ~F.startswith(target, F.concat(base, F.lit("/..")))
    return (target == root) | (target == base) | below


def ancestors(path: Column) -> Column:
    """The path itself and every prefix of whole segments, longest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def resolve(root: Column, path: Column) -> Column:
    """The absolute path: a relative one taken from ``root``, empty and ``.`` segments dropped, ``..`` taking one back, not above ``/``."""
    parts = F.split(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(root, F.lit("/"), path)), "/")
    start = F.array().cast("array<string>")
    kept = F.aggregate(F.filter(parts, lambda x: ~x.isin("", ".")), start, lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def relative(root: Column, path: Column) -> Column:
    """The way from one resolved path to another: ``..`` for each segment left, then those entered; empty where they are one."""
    a, b = F.filter(F.split(root, "/"), lambda x: x != ""), F.filter(F.split(path, "/"), lambda x: x != "")
    shared = F.size(F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda n: F.slice(a, 1, n) == F.slice(b, 1, n))) - 1
    up = F.array_repeat(F.lit(".."), F.size(a) - shared)
    return F.array_join(F.concat(up, F.slice(b, shared + 1, F.size(b))), "/")


def literal_prefix(glob: str) -> int:
    """Characters before the first wildcard."""
    found = re.search(r"[?*\[{]", glob)
    return found.start() if found else len(glob)


def expand_braces(glob: str, limit: int = EXPANSION_LIMIT) -> list[str] | None:
    """All alternatives of ``{a,b}`` groups, innermost first; None beyond the limit."""
    done, waiting = [], [glob]
    while waiting:
        current = waiting.pop(0)
        group = re.search(r"\{([^{}]*,[^{}]*)\}", current)
        if group is None:
            done.append(current)
        else:
            waiting[:0] = [current[: group.start()] + option + current[group.end() :] for option in group[1].split(",")]
        if len(done) + len(waiting) > limit:
            return None
    return done


def expand_classes(glob: str, limit: int = EXPANSION_LIMIT) -> list[str] | None:
    """All alternatives of positive ``[...]`` classes; a negated or too wide class stays as it is."""

    def options(body: str) -> list[str] | None:
        if not body or body[0] in "!^":
            return None
        out: list[str] = []
        for m in re.finditer(r"(.)-(.)|(.)", body, re.S):
            if m[3]:
                out.append(m[3])
            elif 0 <= ord(m[2]) - ord(m[1]) <= RANGE_LIMIT:
                out += map(chr, range(ord(m[1]), ord(m[2]) + 1))
            else:
                return None
        return list(dict.fromkeys(out))

    pieces = re.split(r"(\[[^\]]+\])", glob)
    choices: list[list[str]] = []
    for i, piece in enumerate(pieces):
        found = options(piece[1:-1]) if i % 2 else None
        choices.append(found if found is not None else [piece])
        if i % 2 and found is None:  # nothing behind such a class is expanded
            choices.append(["".join(pieces[i + 1 :])])
            break
    total = functools.reduce(lambda a, c: a * len(c), choices, 1)
    return None if total > limit else ["".join(c) for c in itertools.product(*choices)]


def expand_selector(glob: str) -> list[str] | None:
    braces = expand_braces(glob)
    if braces is None:
        return None
    out: list[str] = []
    for b in braces:
        classes = expand_classes(b)
        if classes is None or len(out) + len(classes) > EXPANSION_LIMIT:
            return None
        out += classes
    return list(dict.fromkeys(out))


def glob_regex(glob: str) -> str:
    """An anchored regular expression (Java and Python alike) for one glob.

    ``**`` as a whole segment matches any number of segments, ``*`` and ``?`` stay within
    one, classes and braces are as in shells, and a trailing ``/**`` also matches its root.
    """

    def one(g: str) -> str:
        tail = ""
        if g == "**":
            return ".*"
        if g.endswith("/**"):
            g, tail = g[:-3], "(?:/.*)?"
        out, i = "", 0
        while i < len(g):
            c = g[i]
            if g.startswith("**/", i) and (i == 0 or g[i - 1] == "/"):
                out += "(?:[^/]*/)*"
                i += 3
                continue
            if c == "*":
                while g.startswith("*", i):
                    i += 1
                out += "[^/]*"
                continue
            if c == "?":
                out += "[^/]"
            elif c == "[" and (end := g.find("]", i + 2)) > 0:
                body = g[i + 1 : end]
                negated = body[0] in "!^"
                out += "[" + ("^" if negated else "") + re.sub(r"([\[\]\\&~^])", r"\\\1", body[negated:]) + "]"
                i = end
            elif c == "\\" and i + 1 < len(g):
                i += 1
                out += re.escape(g[i])
            else:
                out += re.escape(c)
            i += 1
        return out + tail

    alternatives = expand_braces(glob) or [glob]
    return "^(?:" + "|".join(one(a) for a in alternatives) + ")$"


def _states(glob: str, root: str) -> list[tuple[list[str], set[int]]]:
    """For each alternative of a glob, its segments and the places in them that the root's segments lead to.

    A place is how many segments are used up; ``**`` keeps its place and lets the next one begin.
    """
    out = []
    for alternative in expand_braces(glob) or [glob]:
        parts = [x for x in alternative.split("/") if x]
        tests = [None if x == "**" else re.compile(glob_regex(x)) for x in parts]

        def opened(places: set[int], tests: list = tests) -> set[int]:
            more = set(places)
            for k in range(len(tests)):
                if k in more and tests[k] is None:
                    more.add(k + 1)
            return more

        places = opened({0})
        for segment in filter(None, root.split("/")):
            stay = {k for k in places if k < len(parts) and tests[k] is None}
            places = opened(stay | {k + 1 for k in places if k < len(parts) and tests[k] is not None and tests[k].match(segment)})
        out.append((parts, places))
    return out


def can_match_below(glob: str, root: str) -> bool:
    """Whether the glob can match the root or something below it."""
    return any(places for _, places in _states(glob, root))


def covers_below(glob: str, root: str) -> bool:
    """Whether the glob matches all that is below the root."""
    return any(k < len(parts) and all(x == "**" for x in parts[k:]) for parts, places in _states(glob, root) for k in places)
