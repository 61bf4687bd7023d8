"""Migration of configuration texts from version 1 to 2: line by line, so that comments and line ends stay."""

from __future__ import annotations

import json
import posixpath
import re
import tomllib

import pandas as pd

from quarry.functions.lazy import pandas_udf

# Settings that version 2 replaces by path rules, what it adds, and the text of a rule.
DROPPED = ("allow_any_path", "allow_external_roots", "allow_temp_directory", "follow_symlinks")
MATCHERS = 'aider_matchers = ["exact", "whitespace", "relative-indentation", "diff-match-patch"]'
FALLBACK = 'fallback = "dprint"'
FORMATTER = (("id", 'id = "legacy-{n}"'), ("enabled", "enabled = true"), ("mode", 'mode = "stdout"'))
RULE = '[[paths]]\nid = {id}\npath = {path}\npolicies = {{ read = "allow", write = "allow", delete = "allow" }}\nfollow_symlinks = {follow}\nincludes = ["**/*"]\nexcludes = [".git/**"]'
UNRESTRICTED = "UNRESTRICTED: safety.allow_any_path=true became an explicit catch-all path rule"


class MigrationError(ValueError):
    pass


def _header(line: str) -> str | None:
    """The name of a table that a line opens, ``[[name]]`` for an element of an array."""
    found = re.fullmatch(r"[ \t]*(\[\[?)([^\[\]]+)(\]\]?)[ \t]*(?:#.*)?", line)
    return found[1] + found[2] + found[3] if found else None


def _key(line: str) -> str | None:
    found = re.match(r"\s*([A-Za-z0-9_-]+)\s*=", line)
    return found[1] if found else None


def _under(lines: list[str], table: str, line: str) -> list[str]:
    """``line`` put first in a table, which is made at the end where there is none."""
    for i, text in enumerate(lines):
        if _header(text) == f"[{table}]":
            return [*lines[: i + 1], line, *lines[i + 1 :]]
    return [*"\n".join(lines).rstrip().split("\n"), "", f"[{table}]", line, ""]


def _formatters(lines: list[str]) -> list[str]:
    """Every formatter with what version 2 wants of it, after its header."""
    opens = [i for i, text in enumerate(lines) if _header(text) == "[[formatting.formatters]]"]
    out = lines
    for n, i in reversed(list(enumerate(opens, 1))):
        stop = next((j for j in range(i + 1, len(out)) if re.match(r"[ \t]*\[", out[j])), len(out))
        have = {_key(text) for text in out[i + 1 : stop]}
        out = [*out[: i + 1], *(text.format(n=n) for key, text in FORMATTER if key not in have), *out[i + 1 :]]
    return out


def path_rules(config: dict, path: str, temp_root: str) -> tuple[list[str], list[str]]:
    """The path rules that stand for version 1's roots and safety settings, and warnings."""
    safety, roots = config.get("safety", {}), config.get("workspace", {}).get("roots", [])
    here = posixpath.dirname(path)
    anchors = [(f"legacy-workspace-{n}", posixpath.normpath(posixpath.join(here, root))) for n, root in enumerate((r for r in roots if isinstance(r, str)), 1)] if isinstance(roots, list) else []
    if safety.get("allow_temp_directory") is not False:
        anchors.append(("legacy-os-temp", temp_root))
    warnings = []
    if safety.get("allow_any_path") is True:
        anchors.append(("legacy-unrestricted", "/"))
        warnings.append(UNRESTRICTED)
    follow = "true" if safety.get("follow_symlinks") is True else "false"
    return [RULE.format(id=json.dumps(i, ensure_ascii=False), path=json.dumps(a, ensure_ascii=False), follow=follow) for i, a in anchors], warnings


def migrate(source: str, path: str, temp_root: str = "/tmp") -> tuple[str, int, bool, list[str]]:
    """The text in version 2, the version it had, whether it changed, and warnings; raises ``MigrationError``.

    A text of version 2 stays as it is. Where it has line ends of two characters, all of the
    result do. Settings that version 2 has no more are dropped with their lines.
    """
    try:
        config = tomllib.loads(source)
    except tomllib.TOMLDecodeError as e:
        raise MigrationError("invalid_toml") from e
    version = config.get("version", 1)
    if version not in (1, 2) or isinstance(version, bool):
        raise MigrationError("unsupported_version")
    if version == 2:
        return source, 2, False, []
    plain = source.replace("\r\n", "\n")
    lines = plain.split("\n")
    stated = next((i for i, text in enumerate(lines) if re.match(r"[ \t]*version[ \t]*=", text)), None)
    if stated is None:
        lines = ["version = 2", "", *lines]
    else:
        lines[stated] = re.sub(r"(=[ \t]*)[^\s#]+", r"\g<1>2", lines[stated], count=1)
    if "fallback" not in config.get("formatting", {}):
        lines = _under(lines, "formatting", FALLBACK)
    lines = _under(_formatters(lines), "files.patch", MATCHERS)
    rules, warnings = path_rules(config, path, temp_root)
    kept = "\n".join(text for text in lines if _key(text) not in DROPPED)
    done = "\n\n".join([kept.rstrip(), *rules]) + "\n"
    try:
        tomllib.loads(done)
    except tomllib.TOMLDecodeError as e:
        raise MigrationError("invalid_result") from e
    return (done.replace("\n", "\r\n") if "\r\n" in source else done), 1, done != plain, warnings


@pandas_udf("source string, from_version int, changed boolean, warnings array<string>, error string")
def migrate_udf(source: pd.Series, path: pd.Series) -> pd.DataFrame:
    rows = []
    for s, p in zip(source, path, strict=True):
        try:
            rows.append((*migrate(s or "", p or "/"), None))
        except MigrationError as e:
            rows.append((s, None, False, [], str(e)))
    return pd.DataFrame(rows, columns=["source", "from_version", "changed", "warnings", "error"]).astype({"from_version": "Int32"})
