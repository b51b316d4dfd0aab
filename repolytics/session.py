"""Session helpers: a tuned local session, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def make_session(cores: int = 8, app: str = "repolytics", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: they need not find it on a
    path of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_repolytics_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # Spark's file server hands the archive out for as long as the application runs
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="repolytics-"), "repolytics"), "zip", os.path.dirname(package), os.path.basename(package))
    sc.addPyFile(archive)
    sc._repolytics_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local
    folder would be lost with its executor, so an unset key is an error there.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="repolytics-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/repolytics/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint and return a frame that reads it back.

    Used where two branches must see one and the same run of a plan (sampled range bounds,
    partition ids) or where a loop would otherwise grow the lineage.
    """
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
