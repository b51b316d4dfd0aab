"""Draining file streams into parquet."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import remove_path, scratch_path


@dataclass(frozen=True)
class BatchOperator:
    """A stateful operator made of batch plans: ``step(batch, state)`` returns rows and new state.

    ``state`` is a DataFrame with one row for each key, the one returned for the batch before. A
    step may sort, split and join like any batch plan, so one key may own a whole batch.
    """

    source: DataFrame
    step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
    schema: str
    state_schema: str

    @property
    def sparkSession(self) -> SparkSession:
        return self.source.sparkSession


def drain_steps(op: BatchOperator, sink: str, checkpoint: str) -> None:
    """Rows of every batch go below a folder of their own, and so does the state after it.

    A batch that is run again reads the state of the batch before once more and overwrites its
    own folders. Only the states of the last two batches are kept.
    """
    spark, states = op.sparkSession, f"{checkpoint}/keyed-state"

    def save(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(op.state_schema).parquet(f"{states}/{batch_id - 1}") if batch_id else session.createDataFrame([], op.state_schema)
        rows, state = op.step(batch, before)
        state.write.mode("overwrite").parquet(f"{states}/{batch_id}")
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        remove_path(session, f"{states}/{batch_id - 2}")

    # an empty source leaves an empty, readable sink
    spark.createDataFrame([], op.schema).write.mode("append").parquet(f"{sink}/batch=-1")
    query = op.source.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_batch: int | None = None, kind: str = "parquet") -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Fixed value: Spark's state store that keeps the keys on disk instead of the executors' heap.
DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def disk_state(spark: SparkSession):
    """Stateful queries started inside keep their state on disk: it may outgrow the memory."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, DISK_STATE)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def drain_append(df: DataFrame | BatchOperator, sink: str, checkpoint: str) -> None:
    """Process everything available and stop. The file sink commits each batch once."""
    if isinstance(df, BatchOperator):
        return drain_steps(df, sink, checkpoint)
    writer = df.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint)
    with disk_state(df.sparkSession):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def drain_updates(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Write the changed rows of every batch below its own folder.

    A batch that is run again after a failure overwrites its own folder, so the sink is
    idempotent; ``latest_updates`` reads the newest row per key.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = df.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    with disk_state(df.sparkSession):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def run_append(df: DataFrame | BatchOperator, name: str) -> DataFrame:
    spark = df.sparkSession
    sink = scratch_path(spark, name)
    schema = df.schema
    drain_append(df, sink, f"{sink}-state")
    # the batch folders of an operator add no column
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(sink)


def run_updates(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    spark = df.sparkSession
    sink = scratch_path(spark, name)
    schema = df.schema
    drain_updates(df, sink, f"{sink}-state")
    return latest_updates(spark, sink, schema, keys)


def latest_updates(spark: SparkSession, sink: str, schema, keys: list[str]) -> DataFrame:
    """The newest row per key of an update sink."""
    from pyspark.sql import functions as F

    rows = spark.read.schema(schema).option("basePath", sink).parquet(sink)
    others = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")
