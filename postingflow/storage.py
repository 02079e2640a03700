"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, as a URI; one of this process's own only in local mode where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        named = sc._jsc.sc().getCheckpointDir().get()
    path, files = _hadoop(spark, named)
    return re.sub("^file:/+", "file:///", files.makeQualified(path).toString())


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder in the shared folder; removed when the application ends."""
    uri = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path, files = _hadoop(spark, uri)
    files.deleteOnExit(path)
    return uri


def remove(spark: SparkSession, uri: str) -> None:
    path, files = _hadoop(spark, uri)
    files.delete(path, True)


def exists(spark: SparkSession, uri: str) -> bool:
    path, files = _hadoop(spark, uri)
    return files.exists(path)
