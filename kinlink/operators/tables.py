"""Tables written once and read many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir`` (a local session without it: its warehouse) that goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/kinlink-{uuid.uuid4().hex}")
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where)
    store.deleteOnExit(where)
    return where.toString()


def saved(df: DataFrame, files: int | None = None) -> DataFrame:
    """``df`` written to a ``folder`` and read back, by ``files`` tasks at most."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    (df if files is None else df.coalesce(files)).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``saved`` returned, possibly with columns added, when nothing reads it again."""
    spark = df.sparkSession
    for where in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/kinlink-" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, as a small file is read by one task whatever is made of its rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
