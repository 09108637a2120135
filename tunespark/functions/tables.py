"""Steps that are written to the cluster's shared folder, so that what follows starts from a table and lost executors repeat nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it names none, a folder of the warehouse, or a temporary one in a session of one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        alone = spark.sparkContext.master.startswith("local")
        named = tempfile.mkdtemp(prefix="spark-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of a table of its own in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
