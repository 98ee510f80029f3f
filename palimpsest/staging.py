"""Cutting of lineage in loops: a table in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which a cluster has to name; where it is unset, an own folder of this machine, in local mode."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_own_staging_folder", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = sc._own_staging_folder = f"file://{tempfile.mkdtemp(prefix='stages-')}"
    return found


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone; what is left is only scratch
        pass


def cut(df: DataFrame) -> DataFrame:
    """df written and read again: what comes after doesn't repeat what came before, and survives lost executors."""
    path = f"{_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    atexit.register(_drop, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
