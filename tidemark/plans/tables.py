"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one writes beside its warehouse, a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-rounds"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so each round starts from a table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """df with the place of each row in its group, from 1, by `order`, whatever the group's size.

    Rows are range-partitioned by group and order; each partition numbers its own, and a row for each partition and
    group says how many stand before it.
    """
    keys = [F.col(g) for g in group]
    spread = checkpointed(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = spread.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order))
    return spread.withColumn("__own", own).join(before.drop("__n"), ["__part", *group]).withColumn(rank, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def stamp(df: DataFrame) -> tuple:
    """Names, sizes and times of the files df reads: its revision, without reading them."""
    spark = df.sparkSession
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for name in sorted(df.inputFiles()):
        at = path(spark._jvm.java.net.URI(name))
        status = at.getFileSystem(conf).getFileStatus(at)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(found)
