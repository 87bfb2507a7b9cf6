"""Session helpers: table access and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes in one batch sent to a Python worker.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20
#: Folders that are deleted at the end.
_MARKED: set[str] = set()


def local_session(name: str = "terraquant", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; cluster jobs bring their own."""
    return reachable(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it runs from a source tree instead of an installation, and bound
    the batches they are sent by fewer bytes than the default where the session sets no bound itself.
    """
    here = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH")) if x)
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below sf_dir; only Spark's reader touches the path."""
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder that all executors share, below spark.checkpoint.dir; without that setting a local one, for local masters only.

    The folder is deleted when the application's JVM ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="terraquant-")
        spark.conf.set("spark.checkpoint.dir", found)
    own = f"{found.rstrip('/')}/terraquant-{spark.sparkContext.applicationId}"
    if own not in _MARKED:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MARKED.add(own)
    return own


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, computes df once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(tables: Iterable[DataFrame], label: str = "step") -> DataFrame | None:
    """Write tables of one schema to one shared folder, one job after another, and read them back as one; None of none.

    No plan holds more than one of them, whatever their number.
    """
    spark, schema, path = None, None, None
    for df in tables:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
    return None if path is None else spark.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that stored or gathered wrote; nothing may read it any more."""
    spark = df.sparkSession
    own = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own in parent:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
