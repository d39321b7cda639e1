"""Running a finite stream: files in, files out, with a checkpoint in the shared folder.

Two ways. ``run_to_table`` runs a streaming plan; its state (windows, numbers per session) lies in RocksDB, so on the executors' disks and in
the checkpoint, not in their heap. ``run_steps`` hands every micro-batch to a function on plain DataFrames, for state that is a row per
key and for answers that need a key's rows in order: a busy key then spreads over tasks by the same range scans as in batch jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.context import materialize, scratch_folder
from larder.operators.grouping import first_per_key

END_OF_TIME = "2999-01-01 00:00:00"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: After so many micro-batches the state of ``run_steps`` is written whole; in between only what a batch changed.
WHOLE_EVERY = 16


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A parquet folder (or file) as a stream; ``files_per_batch`` bounds the size of a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def as_batches(df: DataFrame, name: str, batch: Column, order: list[int]) -> tuple[DataFrame, str]:
    """Rows as a stream of micro-batches: the rows whose ``batch`` number is ``order[0]`` come first, and so on.

    Returns the stream and its folder. Each batch is one set of files; the source takes as many files at a time as a set has
    at least, so a set is one micro-batch or several.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    numbered = materialize(df.withColumn("_batch", batch), f"{name}-rows")
    least = None
    for k in order:
        before = 0 if least is None else len(spark.read.schema(df.schema).parquet(path).inputFiles())
        numbered.filter(F.col("_batch") == k).drop("_batch").write.mode("append").parquet(path)
        made = len(spark.read.schema(df.schema).parquet(path).inputFiles()) - before
        least = max(1, made if least is None else min(least, made))
    return read_stream(spark, path, df.schema, files_per_batch=least), path


def end_marker(folder: str, schema: T.StructType, time: str) -> Callable[[SparkSession], None]:
    """Write one more file of the source: a row at the end of time, after which every window before it is closed."""

    def write(spark: SparkSession) -> None:
        columns = [f"CAST({repr(END_OF_TIME) if f.name == time else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields]
        spark.range(1).selectExpr(*columns).write.mode("append").parquet(folder)

    return write


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_to_table(stream: DataFrame, name: str, close: Callable[[SparkSession], None] | None = None) -> DataFrame:
    """Process everything available, exactly once, into a new parquet table and return it.

    ``close`` is called when all is processed; then the job goes on from its checkpoint. With ``end_marker`` the windows that a
    finite source leaves open are written too (the marker's own window is not).
    """
    spark = stream.sparkSession
    folder = scratch_folder(spark, name)

    def run() -> None:
        job = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{folder}/rows")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        job.awaitTermination()

    with _state_on_disk(spark):
        run()
        if close:
            close(spark)
            run()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def run_steps(stream: DataFrame, name: str, step: Step, keys: list[str], order: str, state: str, folder: str | None = None) -> DataFrame:
    """Process everything available with ``step``, exactly once, into a new parquet table and return it.

    ``step(batch, held)`` returns a micro-batch's result rows and the new state rows of the keys it touched; ``held`` has their
    newest state row so far (schema ``state``; ``order`` grows with every change of a key). Rows and state of a batch lie in
    folders of its number. A batch that runs again after a failure reads the state of the batches before it and replaces what it
    wrote, so nothing is lost or counted twice. Given a ``folder``, a job goes on from what is there.
    """
    spark = stream.sparkSession
    folder = folder or scratch_folder(spark, name)
    kinds = spark.createDataFrame([], state).schema

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        whole = (number - 1) // WHOLE_EVERY * WHOLE_EVERY  # the last batch before this one that wrote all state
        past = session.createDataFrame([], kinds)
        if number:
            stored = session.read.schema(T.StructType([*kinds.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/state")
            past = stored.filter(F.col("batch").between(whole, number - 1)).drop("batch")
        touched = batch.select(*keys).distinct()
        held = first_per_key(past.join(touched, keys, "left_semi"), keys, [F.col(order).desc()])
        rows, newest = step(batch, materialize(held, "held"))
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        if number % WHOLE_EVERY == 0 and number:
            newest = first_per_key(past.unionByName(newest), keys, [F.col(order).desc()])
        newest.select(*kinds.names).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not _exists(spark, f"{folder}/rows"):  # the source held nothing
        rows, _ = step(spark.createDataFrame([], stream.schema), spark.createDataFrame([], kinds))
        return rows
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)
