"""Session helpers: settings a job relies on, and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While it is set, the shuffle files of a query go when it ends. Else they stay until the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "meshledger", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks. On a cluster the job takes the session it is given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MESHLEDGER_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``. Without one only a session whose
    executors are this machine gets a folder of its own; on a cluster each machine would write to its own disk."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="meshledger-checkpoint-"))


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def stage(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Write once as Parquet beside the checkpoints and read back: cuts the lineage, survives lost
    executors, and every later reader loads only the columns it needs. The shuffles behind it are not needed any more.
    ``more`` tables with the same columns are written after it, one at a time, into the same one."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    with dropped_shuffles(df.sparkSession):
        for part in (df, *more):
            part.write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *staged: DataFrame) -> None:
    """Delete staged tables once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for df in staged:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if "/staged-" not in folder:
                continue
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
