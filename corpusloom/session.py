"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a fresh one only where unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        current = sc.getCheckpointDir()
    return current


def checkpoint_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize once, reliably: lost executors do not repeat the work behind it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """Like ``cut_lineage``, as a Parquet table, and where it is: for ``delete_path``."""
    spark = df.sparkSession
    path = checkpoint_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, as a Parquet table: later steps read only the columns they use."""
    return stored_at(df)[0]


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
