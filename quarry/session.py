"""Session helper, table reader and the shipping of this package to the workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Applications whose workers have this package already.
_shipped: set[str] = set()


#: Shuffle files go when the query that made them ends, and not when the driver's memory happens to be collected.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of one Arrow batch, Spark's own and ours: functions over texts hold several copies of a batch in each Python worker.
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def tidy(spark: SparkSession) -> None:
    """Sets ``TIDY`` and ``BYTES`` where the session has not chosen; the jobs here write what they read again."""
    if spark.conf.get(TIDY, None) is None:
        spark.conf.set(TIDY, "true")
    key, default, own = BYTES
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, own)


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers of ``spark``, once for each application.

    Functions that run in Python workers are pickled by name, so each worker has to import the
    package, wherever the driver was started and whether or not it is installed there.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    if package.parent.is_dir():  # else this is an archive that was shipped already
        archive = Path(tempfile.mkdtemp(prefix="quarry-ship-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def session(cores: int | str = "*", app: str = "quarry", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", os.environ.get("QUARRY_SHUFFLE_PARTITIONS", "8"))
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixed tables; goes through Spark's reader only, so any store works."""
    ship(spark)
    tidy(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
