"""Layered configuration: merge by leaf with provenance, defaults, versions, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYERS = ("default", "global", "project", "environment")


def merge(leaves: DataFrame, *keys: str, concatenated: tuple[str, ...] = ("paths",)) -> DataFrame:
    """From ``layer, layer_ord, leaf, value`` (per ``keys``): the last layer's value of each leaf, and that layer.

    Undefined (null) values are skipped. The leaves named in ``concatenated`` hold
    arrays as JSON and are joined over the layers instead, in order.
    """
    defined = leaves.where("value IS NOT NULL")
    plain = defined.where(~F.col("leaf").isin(*concatenated)).groupBy(*keys, "leaf").agg(F.max_by("value", "layer_ord").alias("value"), F.max_by("layer", "layer_ord").alias("provenance"))
    lists = defined.where(F.col("leaf").isin(*concatenated)).groupBy(*keys, "leaf").agg(F.array_sort(F.collect_list(F.struct("layer_ord", "value"))).alias("parts"), F.max_by("layer", "layer_ord").alias("provenance"))
    joined = F.concat(F.lit("["), F.array_join(F.filter(F.transform("parts", lambda p: F.regexp_extract(p.value, r"^\s*\[(.*)\]\s*$", 1)), lambda v: F.trim(v) != ""), ","), F.lit("]"))
    return plain.unionByName(lists.select(*keys, "leaf", joined.alias("value"), "provenance"))


def effective_version(sources: DataFrame, *keys: str) -> DataFrame:
    """Any source of version 1 makes the whole version 1."""
    return sources.groupBy(*keys).agg(F.min("version").alias("version"))


def with_defaults(config: DataFrame) -> DataFrame:
    """Version-dependent defaults of ``fallback``, ``allow_temp`` and ``delete``."""
    first = F.col("version") == 1
    return config.select(
        *[c for c in config.columns if c not in ("fallback", "allow_temp", "delete")],
        F.coalesce("fallback", F.when(first, F.lit("dprint")).otherwise(F.lit("preserve"))).alias("fallback"),
        F.coalesce("allow_temp", first).alias("allow_temp"),
        F.coalesce("delete", "write").alias("delete"),
    )


def conflicts(rules: DataFrame, root: str = "root") -> DataFrame:
    """Per root a canonical form of its rule set; ``equal`` says whether all roots agree."""
    canonical = rules.groupBy(root).agg(F.array_join(F.array_sort(F.collect_list("rule")), "\n").alias("canonical"))
    return canonical.agg(F.count(F.lit(1)).alias("roots"), (F.countDistinct("canonical") <= 1).alias("equal"))


def nearest_config(paths: DataFrame, configs: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """For each path, the deepest ancestor directory among ``configs`` (dir), not above the deepest ``boundary`` (dir)."""
    parts = F.split("path", "/")
    chain = paths.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "dir"))
    found = chain.join(configs.select("dir").distinct(), "dir").groupBy("path").agg(F.max_by("dir", "depth").alias("config_dir"), F.max("depth").alias("config_depth"))
    out = paths.select("path").distinct().join(found, "path", "left")
    if boundary is not None:
        stop = chain.join(boundary.select("dir").distinct(), "dir").groupBy("path").agg(F.max("depth").alias("stop"))
        out = out.join(stop, "path", "left").withColumn("config_dir", F.when(F.coalesce("config_depth", F.lit(-1)) >= F.coalesce("stop", F.lit(-1)), F.col("config_dir")))
    return out.select("path", "config_dir")


def status(config: DataFrame, secret: str = "(?i)(token|secret|password|key)") -> DataFrame:
    """Leaves for display, secret ones redacted."""
    return config.withColumn("value", F.when(F.regexp_like("leaf", F.lit(secret)), F.lit("[redacted]")).otherwise(F.col("value")))
