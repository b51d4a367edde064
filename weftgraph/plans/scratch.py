"""Written tables in the folder that driver and executors share: lineage is cut and lost executors can be borne."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Parts of a table up to which it is kept in parts.
MOST_PARTS = 16

_written: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local folder if Spark runs in one process, else an error: executors on other
    machines would not find the driver's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"weftgraph-{uuid.uuid4().hex}")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table, read again."""
    spark = df.sparkSession
    path = f"{root(spark)}/weftgraph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def parts(df: DataFrame) -> list[DataFrame]:
    """The frames that df is the union of by appended(); else df alone."""
    return getattr(df, "_weft_parts", [df])


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new, which is known to be a part: what holds old need not write it again."""
    out = old.unionByName(new)
    out._weft_parts = [*parts(old), *parts(new)]
    return out


def is_written(df: DataFrame) -> bool:
    """Whether df is a table that written() has made or that a stored graph holds."""
    return hasattr(df, "_weft_path") or hasattr(df, "_weft_stored")


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later result reads."""
    for df in tables:
        if path := getattr(df, "_weft_path", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system, its path) of a path."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the session has ended; the folder is the cluster's to clear
            return
