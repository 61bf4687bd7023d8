"""Priority-ordered path policies: containment and glob join, specificity, winner."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths

EXACT, PER_SEGMENT = 1_000_000, 10_000
OPERATIONS = ("read", "write", "delete")


@dataclass(frozen=True)
class Rule:
    """One path rule; ``delete`` defaults to ``write``."""

    id: str
    anchor: str
    read: str
    write: str
    delete: str | None = None
    includes: tuple[str, ...] = ("**",)
    excludes: tuple[str, ...] = ()
    source: str = "global"
    follow_symlinks: bool = False


@dataclass(frozen=True)
class Baseline:
    """What decides where no rule does."""

    roots: tuple[str, ...]
    protected: tuple[str, ...] = ()
    version: int = 2
    temp_root: str = "/tmp"
    allow_temp: bool = False
    allow_any: bool = False
    follow_symlinks: bool = False
    extra: tuple = field(default=())


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules with compiled globs; as many rows as there are rules, so it is broadcast."""
    rows = [(i, r.id, r.anchor.rstrip("/") or "/", r.read, r.write, r.delete or r.write, [paths.glob_regex(g) for g in r.includes], [paths.literal_prefix(g) for g in r.includes], [paths.glob_regex(g) for g in r.excludes], r.source, r.follow_symlinks) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ordinal int, rule_id string, anchor string, read string, write string, `delete` string, includes array<string>, prefixes array<int>, excludes array<string>, source string, follow_symlinks boolean")


def decide(checks: DataFrame, rules: list[Rule], baseline: Baseline) -> DataFrame:
    """``checks`` (path, operation) with policy, rule_id, source, specificity, symlinks and reason.

    A rule's anchor is a whole-segment prefix of the path, so rules meet paths by an
    equi-join on the path's ancestors, not by comparing every path with every rule.
    """
    spark = checks.sparkSession
    keyed = checks.select("path", "operation").distinct()
    chain = keyed.select("path", "operation", F.explode(F.when(F.startswith("path", F.lit("/")), F.transform(paths.ancestors(F.col("path")), lambda a: F.when(a == "", F.lit("/")).otherwise(a))).otherwise(paths.ancestors(F.col("path")))).alias("anchor"))
    met = chain.join(F.broadcast(rule_table(spark, rules)), "anchor")
    relative = F.when(F.col("path") == F.col("anchor"), F.lit("")).when(F.col("anchor") == "/", F.substring("path", 2, 1 << 30)).otherwise(F.expr("substring(path, length(anchor) + 2)"))
    met = met.withColumn("relative", relative).where(~F.startswith("relative", F.lit("..")))
    hit = lambda globs: F.exists(F.col(globs), lambda g: F.regexp_like("relative", g))
    met = met.where((F.col("relative") == "") | (hit("includes") & ~hit("excludes")))
    depth = F.when(F.col("anchor") == "/", F.lit(2)).otherwise(F.size(F.split("anchor", "/")))
    longest = F.coalesce(F.array_max(F.transform(F.filter(F.arrays_zip("includes", "prefixes"), lambda z: F.regexp_like("relative", z.includes)), lambda z: z.prefixes)), F.lit(0))
    specificity = F.when(F.col("relative") == "", EXACT).otherwise(F.lit(0)) + depth * PER_SEGMENT + F.when(F.col("relative") == "", 0).otherwise(longest)
    policy = F.when(F.col("operation") == "read", F.col("read")).when(F.col("operation") == "write", F.col("write")).otherwise(F.col("delete"))
    strict = F.when(policy == "deny", 2).when(policy == "request", 1).otherwise(0)
    best = met.groupBy("path", "operation").agg(F.max_by(F.struct("rule_id", policy.alias("policy"), "source", specificity.cast("long").alias("specificity"), F.col("follow_symlinks").alias("symlinks")), F.struct(specificity.cast("long"), strict, -F.col("ordinal"))).alias("won"))
    out = keyed.join(best, ["path", "operation"], "left")
    path = F.col("path")
    trusted = F.lit(False)
    for root in baseline.roots:
        trusted = trusted | paths.within(F.lit(root), path)
    protected = (F.col("operation") != "read") & path.isin(*baseline.protected) if baseline.protected else F.lit(False)
    legacy_temp = F.lit(baseline.version == 1 and baseline.allow_temp) & paths.within(F.lit(baseline.temp_root), path)
    legacy_any = F.lit(baseline.version == 1 and baseline.allow_any)
    won = F.col("won")
    beyond = won.isNotNull() & (won.policy == "allow") & ~trusted & (won.source == "project")
    return out.select(
        "path",
        "operation",
        F.when(protected | beyond, F.lit("request")).when(won.isNotNull(), won.policy).when(legacy_temp | legacy_any | trusted, F.lit("allow")).otherwise(F.lit("deny")).alias("policy"),
        F.when(~protected, won.rule_id).alias("rule_id"),
        F.when(protected, F.lit("configuration")).when(won.isNotNull(), won.source).otherwise(F.lit("baseline")).alias("source"),
        F.when(protected, F.lit((1 << 53) - 1)).otherwise(F.coalesce(won.specificity, F.lit(0))).cast("long").alias("specificity"),
        F.when(protected, F.lit(False)).when(won.isNotNull(), won.symlinks).otherwise(F.lit(baseline.version == 1 and baseline.follow_symlinks)).alias("symlinks"),
        F.when(protected, F.lit("active configuration files are protected")).when(beyond, F.lit("project access beyond the baseline needs approval")).when(won.isNotNull(), F.concat(F.lit("matched rule "), won.rule_id)).when(legacy_temp, F.lit("legacy temporary directory")).when(legacy_any, F.lit("legacy any path")).when(trusted, F.lit("within the baseline")).otherwise(F.lit("no rule outside the baseline")).alias("reason"),
    )


def decide_links(checks: DataFrame, links: DataFrame, rules: list[Rule], baseline: Baseline) -> DataFrame:
    """Decides a path, and where ``links`` (path, target) names a target also that; the stricter policy holds."""
    own = decide(checks, rules, baseline)
    followed = checks.join(links, "path").select("path", F.col("target"), "operation")
    target = decide(followed.select(F.col("target").alias("path"), "operation"), rules, baseline).select(F.col("path").alias("target"), "operation", F.col("policy").alias("target_policy"))
    both = own.join(followed.distinct(), ["path", "operation"], "left").join(target, ["target", "operation"], "left")
    rank = lambda c: F.when(c == "deny", 2).when(c == "request", 1).otherwise(0)
    denied = F.col("target").isNotNull() & ~F.col("symlinks")
    final = F.when(denied, F.lit("deny")).when(rank(F.coalesce("target_policy", F.lit("allow"))) > rank(F.col("policy")), F.col("target_policy")).otherwise(F.col("policy"))
    return both.select("path", "operation", "target", final.alias("policy"), "rule_id")


def tree_readable(root: str, rules: list[Rule]) -> bool:
    """Whether a whole directory may be read: one allow rule covers it, and no rule that can match below, its exclusions weighed, denies."""
    covers = any(r.read == "allow" and (root == r.anchor or root.startswith(r.anchor.rstrip("/") + "/")) and "**" in r.includes and not r.excludes for r in rules)

    def touches(r: Rule) -> bool:
        if r.anchor == root or r.anchor.startswith(root.rstrip("/") + "/"):
            return True
        if not root.startswith(r.anchor.rstrip("/") + "/"):
            return False
        below = root[len(r.anchor.rstrip("/")) + 1 :]
        return any(paths.can_match_below(g, below) for g in r.includes) and not any(paths.covers_below(g, below) for g in r.excludes)

    return covers and not any(r.read == "deny" and touches(r) for r in rules)


def longest_root(items: DataFrame, path: str, roots: list[str]) -> DataFrame:
    """``items`` with the longest of ``roots`` that contains the path, null if none does."""
    best: Column = F.lit(None).cast("string")
    for root in sorted(set(roots), key=len):
        best = F.when(paths.within(F.lit(root), F.col(path)), F.lit(root)).otherwise(best)
    return items.withColumn("root", best)


def first_formatter(items: DataFrame, path: str, formatters: list[tuple[str, tuple[str, ...], tuple[str, ...], bool]]) -> DataFrame:
    """``items`` with the first enabled formatter (name, extensions, globs, enabled) that takes the path."""
    chosen: Column = F.lit(None).cast("string")
    for name, extensions, globs, enabled in reversed(formatters):
        if enabled:
            hit = paths.extension(F.col(path)).isin(*extensions) if extensions else F.lit(False)
            for g in globs:
                hit = hit | F.regexp_like(path, F.lit(paths.glob_regex(g)))
            chosen = F.when(hit, F.lit(name)).otherwise(chosen)
    return items.withColumn("formatter", chosen)


def selected_roots(roots: DataFrame, requests: DataFrame) -> DataFrame:
    """``session, root``: the roots that contain an absolute path that the session asks for; if none does, its first.

    ``roots``: session, root, place; ``requests``: session, path. Roots meet paths by an
    equi-join on the paths' ancestors. A session without roots has none.
    """
    clean = roots.select("session", "root", "place", F.when(F.col("root") == "/", F.lit("/")).otherwise(F.regexp_replace("root", "/+$", "")).alias("_dir"))
    asked = requests.where(F.startswith("path", F.lit("/"))).select("session", paths.resolve(F.lit("/"), F.col("path")).alias("_path")).distinct()
    above = F.transform(paths.ancestors(F.col("_path")), lambda a: F.when(a == "", F.lit("/")).otherwise(a))
    chain = asked.select("session", "_path", F.explode(above).alias("_dir"))
    inside = chain.where(paths.within(F.col("_dir"), F.col("_path"))).select("session", "_dir").distinct()
    met = clean.join(inside.withColumn("_met", F.lit(True)), ["session", "_dir"], "left")
    per = met.groupBy("session").agg(F.bool_or(F.coalesce("_met", F.lit(False))).alias("_any"), F.min("place").alias("_first"))
    return met.join(per, "session").where((F.col("_any") & F.col("_met")) | (~F.col("_any") & (F.col("place") == F.col("_first")))).select("session", "root").distinct()
