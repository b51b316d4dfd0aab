"""Written tables in the shared folder, labelled folds and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def written(df: DataFrame, name: str = "llm", **options: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back: cuts the lineage,
    survives lost executors, is computed once however often it is read. ``options`` are those of the writer."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage: Spark's cleaner then removes the shuffle files of
    plans that are gone, which otherwise stay until the driver's heap happens to fill."""
    spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more, once their successor is written."""
    for df in tables:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    clean_up(tables[0].sparkSession)


def fold(id: Column, folds: int) -> Column:
    """Remainder of the crc32 of the id's text; null for a null id."""
    return F.crc32(id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id: str, most: int, folds: int = 5) -> DataFrame:
    """``docs`` of at most ``most`` labelled rows outside fold 0, with ``__y`` 0 or 1.

    The rows with the smallest id hashes are taken; a repeated label counts as its least
    value; null labels and ids are left out.
    """
    known = labels.where(F.col(label).isNotNull() & (fold(F.col(id), folds) != 0))
    picked = known.groupBy(F.col(id).alias("__lid")).agg(F.min(label).cast("int").alias("__y"))
    picked = picked.orderBy(F.xxhash64("__lid"), "__lid").limit(most)
    # at most ``most`` rows of two numbers
    return docs.join(F.broadcast(picked), F.col(f"`{id}`") == F.col("__lid"))
