"""Patches of files: ordered rules per file, previewed with a diff and a receipt, committed all or not at all.

A preview writes nothing. Its receipt names the file, the source and result hashes and the
configuration's generation; ``expiry.receipts`` keeps receipts once and for a time.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.replacing import TIERS, MatchError, parse_blocks, replace_block
from quarry.operators import changes, pysource
from quarry.operators.shared import stored

Adapter = Callable[[str, dict, tuple[str, ...]], tuple[str, list[str]]]


def _blocks(content: str, rule: dict, allowed: tuple[str, ...]) -> tuple[str, list[str]]:
    """A search and its replacement, or where there is no search text, all blocks of ``replace``."""
    if rule["search"] is None:
        pairs = [(b.search, b.replace) for b in parse_blocks(rule["replace"] or "")]
        if not pairs:
            raise MatchError("no_blocks")
    else:
        pairs = [(rule["search"], rule["replace"] or "")]
    methods = []
    for search, replace in pairs:
        content, method = replace_block(content, search, replace, allowed)
        methods.append(method)
    return content, methods


def _syntax(content: str, rule: dict, allowed: tuple[str, ...]) -> tuple[str, list[str]]:
    """The one match of a pattern rewritten. Only a first match is ever rewritten, so any other expected number is refused."""
    expected = 1 if pd.isna(rule["expected_matches"]) else int(rule["expected_matches"])
    if pysource.error_count(content):
        raise MatchError("parse_error")
    found, after = pysource.rewrite_first(content, rule["search"] or "", rule["replace"] or "")
    if found != expected:
        raise MatchError("match_count")
    if expected != 1:
        raise MatchError("expected_matches_not_one")
    return after, ["ast"]


#: The names of the strategies in a patch request. A further one is a further entry.
STRATEGIES: dict[str, Adapter] = {"aider_block": _blocks, "ast": _syntax}

RULE = "array<struct<ordinal:int,strategy:string,search:string,replace:string,expected_matches:int>>"
RESULT = "content string, methods array<string>, failed_rule int, error string, diff array<string>"


def apply_udf(allowed: tuple[str, ...] = TIERS, diff_lines: int = 200):  # noqa: ANN201
    """UDF of (content, rules): every rule works on what the one before made; the first that fails ends it."""

    def one(content: str, rules: list[dict]) -> tuple:
        now, methods = content, []
        for rule in rules:
            try:
                if rule["strategy"] not in STRATEGIES:
                    raise MatchError("unknown_strategy")
                now, used = STRATEGIES[rule["strategy"]](now, rule, allowed)
            except MatchError as e:
                return None, None, rule["ordinal"], e.code, None
            methods += used
        return now, methods, None, None, changes.unified_hunk(content.split("\n"), now.split("\n"), diff_lines)

    @F.pandas_udf(RESULT)
    def run(content: pd.Series, rules: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 5 if c is None else one(c, list(r)) for c, r in zip(content, rules, strict=True)]
        out = pd.DataFrame(rows, columns=["content", "methods", "failed_rule", "error", "diff"])
        return out.astype({"failed_rule": "Int32"})

    return run


def preview(rules: DataFrame, files: DataFrame, generation: int = 0, allowed: tuple[str, ...] = TIERS, diff_lines: int = 200) -> DataFrame:
    """One row per patched file: ``path, before, after, content, methods, diff, receipt, failed_rule, error``.

    ``rules``: path, ordinal, strategy, search, replace, expected_matches, expected_sha256.
    ``files``: path, content, sha256. ``error`` is not_found, stale_or_missing_hash (also
    where the rules of a file state no hash or several), or that of the rule ``failed_rule``.
    """
    rule = F.struct(F.col("ordinal").cast("int").alias("ordinal"), "strategy", "search", "replace", F.col("expected_matches").cast("int").alias("expected_matches"))
    per = rules.groupBy("path").agg(F.array_sort(F.collect_list(rule)).cast(RULE).alias("rules"), F.min("expected_sha256").alias("_least"), F.max("expected_sha256").alias("_most"))
    met = per.join(files.select("path", F.col("content").alias("_was"), F.col("sha256").alias("before")), "path", "left")
    fresh = F.coalesce((F.col("_least") == F.col("before")) & (F.col("_most") == F.col("before")), F.lit(False))
    guard = F.when(F.col("before").isNull(), F.lit("not_found")).when(~fresh, F.lit("stale_or_missing_hash"))
    done = met.withColumn("guard", guard).withColumn("r", apply_udf(allowed, diff_lines)(F.when(F.col("guard").isNull(), F.coalesce("_was", F.lit(""))), "rules"))
    after = F.sha2(F.col("r.content").cast("binary"), 256)
    receipt = F.when(F.col("r.content").isNotNull(), F.sha2(F.to_json(F.array(F.col("path"), F.col("before"), after, F.lit(str(generation)))).cast("binary"), 256))
    return done.select("path", "before", after.alias("after"), F.col("r.content").alias("content"), F.col("r.methods").alias("methods"), F.col("r.diff").alias("diff"), receipt.alias("receipt"), F.col("r.failed_rule").alias("failed_rule"), F.coalesce("guard", F.col("r.error")).alias("error"))


def commit(previewed: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Writes the next state of ``files`` to ``path`` if no file of the preview has an error and none changed since; else raises."""
    p = stored(previewed)
    bad = p.where("error IS NOT NULL").orderBy("path").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.path}: {r.error}" for r in bad))
    batch = p.select("path", F.lit("patch").alias("operation"), F.col("before").alias("expected_sha256"), F.lit(None).cast("string").alias("destination"), F.lit(False).alias("forced"), "content")
    return changes.commit(batch, files, path)


def lock_queue(requests: DataFrame, batch: str = "batch", path: str = "path") -> DataFrame:
    """``batch, path, place, waits_for``: each batch takes its distinct paths in ascending order, each path its batches.

    As all batches take locks in one order, none waits for another that waits for it.
    ``waits_for`` is the batch before on that path, null for the first.
    """
    one = requests.select(F.col(batch).alias("batch"), F.col(path).alias("path")).where("batch IS NOT NULL AND path IS NOT NULL").distinct()
    placed = one.withColumn("place", (F.row_number().over(Window.partitionBy("batch").orderBy("path")) - 1).cast("long"))
    return placed.withColumn("waits_for", F.lag("batch").over(Window.partitionBy("path").orderBy("batch")))


def distinct_in_order(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """``key, values``: the distinct values that are not null of each key, each at its first place in order."""
    at = F.struct(*order)
    first = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(at).alias("_at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("values"))


FORMATTED = "content string, error string"


def formatter_udf(argv: list[str], timeout: float = 30.0):  # noqa: ANN201
    """UDF of (path, content): the output of a program that reads the content on standard input.

    ``argv`` is run without a shell; ``{path}`` in an argument stands for the path. A program
    that is missing, fails or takes too long gives an error and leaves the content as it is.
    """

    def one(path: str, content: str) -> tuple[str, str | None]:
        try:
            done = subprocess.run([a.replace("{path}", path) for a in argv], input=content.encode(), capture_output=True, timeout=timeout, check=False)
            return (content, f"formatter_failed: exit {done.returncode}") if done.returncode else (done.stdout.decode(), None)
        except (OSError, UnicodeDecodeError, subprocess.TimeoutExpired) as e:
            return content, f"formatter_failed: {type(e).__name__}"

    @F.pandas_udf(FORMATTED)
    def run(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if c is None else one(p or "", c) for p, c in zip(path, content, strict=True)]
        return pd.DataFrame(rows, columns=["content", "error"], dtype=object)

    return run


def preview_actions(previewed: DataFrame, session: str, at_ms: int, generation: int = 0) -> DataFrame:
    """The previews without an error as actions for ``expiry.receipts``."""
    ok = previewed.where("error IS NULL")
    return ok.select(F.lit(session).alias("session"), F.lit("preview").alias("action"), F.col("receipt").alias("token"), F.col("path").alias("file"), F.col("before").alias("sha256"), F.lit(generation).cast("long").alias("generation"), F.octet_length("content").cast("long").alias("size"), F.lit(at_ms).cast("long").alias("at_ms"))
