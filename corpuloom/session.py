"""Session helpers: building a session, shipping this package to executors, scratch tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def build_session(app: str = "corpuloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; every setting can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_corpuloom_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="corpuloom-"), "corpuloom_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, str(path.relative_to(PACKAGE.parent)))
    sc.addPyFile(target)
    sc._corpuloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local one serves local masters only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = getattr(sc, "_corpuloom_scratch", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            local = tempfile.mkdtemp(prefix="corpuloom-scratch-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            folder = sc._corpuloom_scratch = f"file://{local}"
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; clear_scratch() deletes what is written there."""
    path = f"{shared_folder(spark)}/corpuloom/{name}-{uuid.uuid4().hex}"
    scratch_paths(spark).append(path)
    return path


def scratch_paths(spark: SparkSession) -> list[str]:
    """The session's scratch paths that have not been cleared, in order."""
    sc = spark.sparkContext
    if not hasattr(sc, "_corpuloom_paths"):
        sc._corpuloom_paths = []
    return sc._corpuloom_paths


def clear_scratch(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the scratch tables from the `since`-th on, but those to keep. Results that read them must have been written before."""
    paths = scratch_paths(spark)
    for path in [p for p in paths[since:] if p not in keep]:
        drop_scratch(spark, path)
        paths.remove(path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again.

    Survives the loss of any executor, unlike a local checkpoint.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
