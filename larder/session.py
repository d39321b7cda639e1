"""Session for tests, the benchmark and ad-hoc runs on one machine, and what a run needs on any session.

On a cluster use the cluster's own session with ``spark.checkpoint.dir`` set, and install the wheel on the executors or call
``ship`` once.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

from larder.context import run_folder

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(name: str = "larder", cores: int | None = None) -> SparkSession:
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    path = os.environ.get("PYTHONPATH", "")
    if HOME not in path.split(os.pathsep):  # Python workers import the package from here, whatever the working folder is
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HOME, path]))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LARDER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", os.environ.get("LARDER_SCRATCH") or tempfile.mkdtemp(prefix="larder-scratch-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def remove_run_folder(spark: SparkSession) -> None:
    """Delete this application's intermediate tables."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python, for clusters on which it is not installed."""
    with tempfile.TemporaryDirectory() as folder:
        archive = shutil.make_archive(os.path.join(folder, "larder"), "zip", HOME, "larder")
        spark.sparkContext.addPyFile(archive)
