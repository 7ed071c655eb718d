"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.  A folder made up here might be local to one machine, so a
    session without one is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """Where this session's intermediate tables lie."""
    return f"{shared_folder(spark)}/quarry/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove this session's intermediate tables, once no result that was made from them is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write a table, in folders by the columns ``by``, and read it back: cuts lineage and survives lost executors."""
    path = f"{session_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
