"""Written intermediate tables in the folder that the cluster shares between driver and executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}  # by application, where nothing is set


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one if all runs in one process, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="lodeframe-")
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and reread it: lineage is cut, and any executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodeframe_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by written() once nothing reads it."""
    path = getattr(df, "_lodeframe_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
