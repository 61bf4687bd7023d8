"""Sources: whole files with hashes, directory walks by glob, JSONL with line numbers, inverted index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.operators import content


def files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """``path, size, modified, content`` of the regular files below a directory."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob and "/" not in glob and "{" not in glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return found.where(F.regexp_like("path", F.lit(paths.glob_regex(f"**/{glob}")))) if glob and ("/" in glob or "{" in glob) else found


def hashes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, sha256, size``; content never leaves the scan."""
    return content.hashed(files(spark, path, glob), "content", "path")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``path, fingerprint`` (modification time in ms and size), without reading contents."""
    return files(spark, path).select("path", F.concat_ws(":", F.unix_millis("modified").cast("string"), F.col("size").cast("string")).alias("fingerprint"))


def inspected(spark: SparkSession, path: str) -> DataFrame:
    """Capabilities of files; texts of unknown parse state have no parser here."""
    f = files(spark, path)
    binary = content.is_binary(F.col("content"))
    return f.select("path", "size", content.capabilities(F.col("path"), binary, F.lit(None).cast("int")).alias("c")).select("path", "size", "c.*")


def jsonl_sessions(spark: SparkSession, path: str) -> DataFrame:
    """``session, text``: one row per transcript file, so that lines keep their order."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("session"), F.col("value").alias("text"))


def refreshed_index(old: DataFrame | None, current: DataFrame, key: str = "path", digest: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """Rows of ``current`` to index anew, and keys of ``old`` to drop, by comparing digests."""
    if old is None:
        return current, current.select(key).where("false")
    same = old.select(key, digest)
    return current.join(same, [key, digest], "left_anti"), old.join(current.select(key, digest), [key, digest], "left_anti").select(key)
