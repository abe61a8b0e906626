"""Session defaults for local runs; a cluster brings its own configuration."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, name: str = "gleaner") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GLEANER_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, laptops) is a local one set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(configured or "/tmp/checkpoints")
        current = spark.sparkContext.getCheckpointDir()
    return configured or current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint directory, in this application's own."""
    return f"{shared_dir(spark).rstrip('/')}/gleaner-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors.

    ``discard`` deletes it; what a lazy result still reads stays until ``clear_scratch``.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._gleaner_scratch = path
    return written


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these frames; everything computed from them must be written by now."""
    for frame in frames:
        delete_path(frame.sparkSession, frame._gleaner_scratch)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch of this application; call it when the results are written."""
    delete_path(spark, f"{shared_dir(spark).rstrip('/')}/gleaner-{spark.sparkContext.applicationId}")


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_gleaner_shipped", False):
        return
    import tempfile
    import zipfile
    from pathlib import Path

    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gleaner-")) / "gleaner.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._gleaner_shipped = True
