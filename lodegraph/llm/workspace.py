"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodegraph.plans.lineage import delete, shared_folder


class Workspace:
    """A folder of Parquet tables, one a name.

    A kept table survives the loss of executors: its files are in the shared
    folder, not on their disks. What a result still reads goes with the application's folder, when
    the driver's process ends; `drop` is for tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            delete(self.spark, f"{self.path}/{name}")
