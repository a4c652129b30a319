"""Folders that driver and executors share, and tables written there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or the one set on the context. Only a local session may do without: it gets a
    temporary folder of its machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    if not set_already.isDefined():
        if not root and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="evidra-"))
        set_already = sc._jsc.sc().getCheckpointDir()
    return (root or set_already.get()).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared root that no other run uses."""
    return f"{checkpoint_root(spark)}/evidra-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared root and read again: lineage ends there, so lost executors cost no rework."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``stored`` gave and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
