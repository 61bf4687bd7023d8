"""Set differences between snapshots, batch preflight and all-or-nothing commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths

MAX_BATCH = 50


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``key, change`` (new, removed, changed) of keys that differ."""
    b = before.select(F.col(key), F.col(value).alias("_before"), F.lit(1).alias("_b"))
    a = after.select(F.col(key), F.col(value).alias("_after"), F.lit(1).alias("_a"))
    both = b.join(a, key, "full")
    change = F.when(F.col("_b").isNull(), F.lit("new")).when(F.col("_a").isNull(), F.lit("removed")).when(~F.col("_before").eqNullSafe(F.col("_after")), F.lit("changed"))
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def drift(canonical: DataFrame, local: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of ``canonical`` that are missing in ``local`` or differ there."""
    c, other = canonical.select(key, F.col(value).alias("_c")), local.select(key, F.col(value).alias("_l"))
    return c.join(other, key, "left").where(~F.col("_c").eqNullSafe(F.col("_l"))).select(key, F.when(F.col("_l").isNull(), F.lit("missing")).otherwise(F.lit("unequal")).alias("problem"))


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``equal``: whether two tables hold the same rows as often."""
    diff = a.exceptAll(b).select(F.lit(1).alias("_")).unionAll(b.exceptAll(a).select(F.lit(1).alias("_")))
    return diff.agg((F.count(F.lit(1)) == 0).alias("equal"))


def preflight(batch: DataFrame, files: DataFrame, importers: DataFrame | None = None) -> DataFrame:
    """Errors of a mutation batch, one row per problem; the batch may go on if there is none.

    ``batch``: path, operation (write, patch, delete, rename), expected_sha256,
    destination, forced. ``files``: path, sha256. ``importers``: file, target.
    """
    f = files.select("path", F.col("sha256").alias("_now"))
    met = batch.join(f, "path", "left")
    exists = F.col("_now").isNotNull()
    stale = exists & ~F.col("expected_sha256").eqNullSafe(F.col("_now"))
    problem = F.when(~exists & F.col("operation").isin("patch", "delete", "rename"), F.lit("not_found")).when(stale, F.lit("stale_or_missing_hash"))
    out = met.select("path", problem.alias("code")).where("code IS NOT NULL")
    moves = batch.where(F.col("operation") == "rename")
    twice = moves.groupBy("destination").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n > 1").select("path", F.lit("duplicate_destination").alias("code"))
    taken = moves.join(files.select(F.col("path").alias("destination")), "destination", "left_semi").select("path", F.lit("destination_exists").alias("code"))
    out = out.unionByName(twice).unionByName(taken)
    repeated = batch.groupBy("path").count().where("count > 1").select("path", F.lit("duplicate_path").alias("code"))
    out = out.unionByName(repeated)
    if importers is not None:
        gone = batch.where((F.col("operation") == "delete") & ~F.coalesce("forced", F.lit(False))).select(F.col("path").alias("target"))
        used = importers.join(gone, "target").join(batch.where(F.col("operation") == "delete").select(F.col("path").alias("file")), "file", "left_anti")
        out = out.unionByName(used.select(F.col("target").alias("path"), F.lit("still_imported").alias("code")).distinct())
    return out


def commit(batch: DataFrame, files: DataFrame, path: str, importers: DataFrame | None = None) -> DataFrame:
    """Writes the files' next state to ``path`` in one job if preflight finds nothing; else raises.

    ``files``: path, content, sha256; ``batch`` as in ``preflight``, with ``content``.
    A Spark write is committed as a whole, so readers of ``path`` see all of it or nothing.
    """
    errors = preflight(batch, files.select("path", "sha256"), importers)
    first = errors.orderBy("path", "code").limit(5).collect()
    if first:
        raise ValueError("; ".join(f"{r.path}: {r.code}" for r in first))
    b = batch.select("path", "operation", F.col("content").alias("_new"), "destination")
    kept = files.join(b, "path", "left").where("operation IS NULL OR operation != 'delete'")
    kept = kept.select(F.when(F.col("operation") == "rename", F.col("destination")).otherwise(F.col("path")).alias("path"), F.when(F.col("operation").isin("write", "patch"), F.col("_new")).otherwise(F.col("content")).alias("content"))
    new = b.where("operation = 'write'").join(files.select("path"), "path", "left_anti").select("path", F.col("_new").alias("content"))
    state = kept.unionByName(new)
    state.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).write.mode("errorifexists").parquet(path)
    return files.sparkSession.read.parquet(path)


def removed_directories(deleted: DataFrame, remaining: DataFrame) -> DataFrame:
    """Directories that hold no file any more once ``deleted`` (path) is gone; ``remaining``: path."""
    dirs = lambda df: df.select(F.explode(F.expr("transform(sequence(1, greatest(1, size(split(path, '/')) - 1)), n -> array_join(slice(split(path, '/'), 1, n), '/'))")).alias("dir")).where("dir != ''").distinct()
    return dirs(deleted).join(dirs(remaining), "dir", "left_anti")


def unified_hunk(before: list[str], after: list[str], limit: int = 200) -> list[str]:
    """One hunk: common ends trimmed, removed then added lines, at most ``limit`` and a mark if cut."""
    i = 0
    while i < min(len(before), len(after)) and before[i] == after[i]:
        i += 1
    j = 0
    while j < min(len(before), len(after)) - i and before[-1 - j] == after[-1 - j]:
        j += 1
    out = [f"@@ -{i + 1},{len(before) - i - j} +{i + 1},{len(after) - i - j} @@", *(f"-{x}" for x in before[i : len(before) - j]), *(f"+{x}" for x in after[i : len(after) - j])]
    return out if len(out) <= limit else [*out[:limit], "... diff cut"]


def stable_rewrite(files: DataFrame, rewrite, path: str) -> DataFrame:  # noqa: ANN001
    """Applies ``rewrite`` (DataFrame of path, content to the same) only if two previews agree on the changed files.

    The preview is written before it is taken again, so a rewrite that is not
    deterministic, or files that change meanwhile, raise instead of being committed.
    """
    changed = lambda: rewrite(files).join(files.withColumnRenamed("content", "_was"), "path").where(~F.col("content").eqNullSafe(F.col("_was"))).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    preview = f"{path}-preview"
    changed().write.mode("errorifexists").parquet(preview)
    first = files.sparkSession.read.parquet(preview)
    if not same_multiset(first, changed()).first().equal:
        raise ValueError("the rewrite changed between preview and commit")
    rewrite(files).withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).write.mode("errorifexists").parquet(path)
    return files.sparkSession.read.parquet(path)


def rename_proof(requests: DataFrame, results: DataFrame, root: str = "/") -> DataFrame:
    """``call, proven``: whether every rename that a call asks for is reported done, at the destination asked for.

    ``requests``: call, source, destination; ``results``: call, file, destination_path,
    renamed. A result may name the source as written or resolved from ``root``; the first
    is preferred. Requests without a destination are not proven.
    """
    base = F.lit(root)
    asked = requests.select("call", "source", paths.resolve(base, F.col("destination")).alias("_to"), F.monotonically_increasing_id().alias("_id"))
    tried = asked.select("call", "_id", F.posexplode(F.array("source", paths.resolve(base, F.col("source")))).alias("_way", "file"))
    said = results.select("call", "file", F.struct(paths.resolve(base, F.col("destination_path")).alias("at"), F.col("renamed").alias("done")).alias("_said")).groupBy("call", "file").agg(F.first("_said").alias("_said"))
    best = tried.join(said, ["call", "file"]).groupBy("call", "_id").agg(F.min_by("_said", "_way").alias("_said"))
    ok = F.coalesce((F.col("_said.at") == F.col("_to")) & F.col("_said.done"), F.lit(False))
    return asked.join(best, ["call", "_id"], "left").groupBy("call").agg(F.bool_and(ok).alias("proven"))
