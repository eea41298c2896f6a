"""Shared scratch tables: how lineage is cut.

A job that reuses an intermediate result writes it as Parquet into the folder that
`spark.checkpoint.dir` names, which every executor and the driver share, and reads it
back. Losing an executor then never loses the result. Once a table is written, the shuffles
behind it are read no more and their files go at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.shared import shared_folder as folder


#: Spark's setting for shuffle files that go when the query they belong to has ended.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again with its own schema."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table from saved(); call it once nothing reads them any more."""
    spark = df.sparkSession
    root = folder(spark)
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tables/" in parent and parent.split("/tables/")[0].split(":")[-1].lstrip("/") == root.split(":")[-1].lstrip("/"):
            p = jvm.org.apache.hadoop.fs.Path(parent)
            p.getFileSystem(hadoop).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes every scratch table of the shared folder; for when no result of an operator is read any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/tables")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
