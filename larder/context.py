"""Session-level helpers: table access and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: One folder per application, below the folder that all executors share.
_RUN = f"larder-{uuid.uuid4().hex}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One stored parquet table (a single file or a directory of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; ``session.remove_run_folder`` deletes it.

    The cluster names its shared folder in ``spark.checkpoint.dir``. A local session that leaves it unset (driver and executors
    are one process there) gets a folder below Spark's own local folder, which Spark removes when it ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = spark.sparkContext._temp_dir
    return f"{root.rstrip('/')}/{_RUN}"


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor can reach."""
    return f"{run_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_by(df: DataFrame, purpose: str, key: str) -> DataFrame:
    """``materialize`` in buckets of ``key``: joins on it read the table where it lies and shuffle their other side only.

    Spark reads buckets through its catalog only, which holds the table until it is resolved; its files stay in the run's folder.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, purpose)
    name = f"larder_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
