"""Session helpers of the text operators: shared tables, batch sizes, bucket counts, folds, bounded id filters."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Per application and parent, the one folder that is made: each call of mkdirs starts a helper process, which shares the driver's memory for a moment.
_MADE: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The name of a new folder under ``spark.checkpoint.dir``, for its writer to make, that goes when the driver ends.

    Where the setting is unset, a local session (tests) uses its warehouse; a cluster has no folder
    that all machines see, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    key = spark.sparkContext.applicationId, root
    if key not in _MADE:
        _MADE[key] = f"{root.rstrip('/')}/kinlink-{uuid.uuid4().hex}"
        where = spark._jvm.org.apache.hadoop.fs.Path(_MADE[key])
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)  # only what is there can be marked
        files.deleteOnExit(where)
    return f"{_MADE[key]}/{uuid.uuid4().hex}"


#: While set, shuffle files go as soon as the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows with texts, sets or n-grams, and rows of a few numbers, for which a stored table gets a file.
WIDE, NARROW = 2000, 20_000


def stored(df: DataFrame, files: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors, leaves no shuffle files.

    ``files``: tasks that write it at most, so that a small table is not dealt over all shuffle partitions.
    """
    df = df if files is None else df.coalesce(max(1, files))
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame | None) -> None:
    """Remove the files behind ``stored`` tables that nothing reads any more."""
    for df in tables:
        if df is None:
            continue
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/kinlink-" in path:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Bound what one Arrow batch and one batch of a scan hold, whatever the length of the texts. Spark reads these settings when a plan runs, so they stay set."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 512)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def buckets(docs: DataFrame) -> int:
    """How many hash buckets to deal rows into: grows with the input and with the session's shuffle partitions."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


#: Bits of a broadcast set of ids: 2 MB, whatever the number of ids.
SET_BITS = 1 << 24
_BITMAP = 32768


def split_by_id(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose doc_id is surely not in ``ids`` (column ``_id``), and those for which a join must tell.

    The ids are hashed into a bit set of fixed size, so the first part, most rows where few ids are given, is
    never shuffled.  Only DataFrame functions; any column of ``docs`` may have any name.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(SET_BITS))
    marks = ids.select(place(F.col("_id")).alias("_p")).groupBy(F.floor(F.col("_p") / _BITMAP).alias("_bucket")).agg(F.bitmap_construct_agg(F.col("_p") % _BITMAP).alias("_bits"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    p = place(F.col("_row.doc_id"))
    byte = F.conv(F.hex(F.expr("substring(_bits, _at, 1)")), 16, 10).cast("long")
    found = rows.withColumn("_p", p).withColumn("_bucket", F.floor(F.col("_p") / _BITMAP)).join(F.broadcast(marks), "_bucket", "left").withColumn("_at", F.floor(F.col("_p") % _BITMAP / 8).cast("int") + 1)
    hit = F.col("_bits").isNotNull() & (F.coalesce(F.getbit(byte, (F.col("_p") % 8).cast("int")), F.lit(0)) == 1)
    found = found.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return found.where(~F.col("_hit")).select("_row.*"), found.where("_hit").select("_row.*")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids`` (column ``_id``); rows without doc_id go."""
    docs = docs.where(F.col("doc_id").isNotNull())
    ids = stored(ids.distinct(), 1 + docs.count() // NARROW)
    clean, rest = split_by_id(docs, ids)
    return clean.unionByName(rest.join(ids, rest["doc_id"].cast("long") == ids["_id"], "left_anti"))
