"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables that settle() has written and release() not yet deleted.
_SETTLED: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder in ``spark.checkpoint.dir``.

    Where none is set a new local one serves, but only in sessions of one machine (tests,
    benchmarks): executors of a cluster could not read it.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="millrace-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared checkpoint folder and read it from there.

    The lineage is cut, a lost executor costs a read, and unlike ``checkpoint()`` the last stage
    isn't computed twice. Columns are stored by position, so names that clash do no harm.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    _SETTLED.append(path)
    names = [f"c{i}" for i in range(len(df.columns))]
    stored = df.toDF(*names)
    stored.write.parquet(path)
    return spark.read.schema(stored.schema).parquet(path).toDF(*df.columns)


def release(spark: SparkSession) -> int:
    """Delete the tables that settle() has written so far; call it once results that read them are stored. Returns their number."""
    files, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _SETTLED:
        path = files.Path(_SETTLED.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "millrace", cores: str | None = None, shuffle: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '*')}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
