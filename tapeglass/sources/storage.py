"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode one is made where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="tapeglass-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables that a job writes and reads again, so that a plan ends at each of them and a lost executor
    costs a reread. ``free`` deletes one that nothing reads any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/job-{uuid.uuid4().hex[:12]}", 0

    def settle(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *tables: DataFrame) -> None:
        for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            delete_folder(self.spark, path)


