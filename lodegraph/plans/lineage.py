"""Cutting lineage where a result is used several times: written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each application, by its id.
_FOLDERS: dict[str, str] = {}


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder below the cluster's `spark.checkpoint.dir`; it is deleted when this process ends.

    Where that is unset, a temporary folder serves in local mode, as in tests; elsewhere that is an
    error, as executors don't see each other's disks.
    """
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{(base or 'file://' + tempfile.mkdtemp(prefix='lodegraph-')).rstrip('/')}/lodegraph-{context.applicationId}"
        _FOLDERS[context.applicationId] = folder

        def clean() -> None:
            with contextlib.suppress(Exception):  # the session may be gone; what is left is in a folder of scratch data
                delete(spark, folder)

        atexit.register(clean)
    return _FOLDERS[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read from there, so that what uses it doesn't compute it again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
