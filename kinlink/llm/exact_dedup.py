"""Exact deduplication by a stateful stream with disk-backed keyed state. DataFrame functions only.

Every row leaves a fingerprint (digest of the text without blanks, doc_id, length, locator).  The
fingerprints are read as a stream and aggregated by digest in the RocksDB state store, without a
watermark and so without expiry: per digest the state retains the group's size and the identifier,
length and content locator of the row that stays.  On a hit, the full bytes of the row are compared
with those of the retained row; rows whose bytes differ (a digest collision) are regrouped by their
text itself.

Defined results.  Null text counts as empty; all texts of blanks only are equal.  Rows without doc_id
are left out.  Rows that repeat doc_id, length and text without blanks are one document; one doc_id
with several texts has a row for each.  Ties in length go to the
smallest doc_id.  An empty table gives an empty table.  Extra columns never take part; of rows that
repeat a document, the filter form keeps any one.  Very long texts are hashed and compared whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import NARROW, WIDE, documents, dropped, shared_dir, split_by_id, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that share one copy of the retained text while bytes are compared.
ROWS_PER_SALT = 500


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    text = without_blanks(F.col("text"))
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), sha256(text).alias("text_sha256"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), _locator(docs).alias("locator"))


def _locator(docs: DataFrame) -> Column:
    """The file of a row; for rows of joined tables, which have no one file, their identifier."""
    try:
        docs.select(F.input_file_name())
        return F.input_file_name()
    except AnalysisException:
        return F.col("doc_id").cast("string")


def retained(prints: DataFrame) -> DataFrame:
    """Drain the stored fingerprints as a stream; per digest: keep_id, keep_chars, locator, group_size."""
    spark = prints.sparkSession
    source = prints.inputFiles()[0].rpartition("/")[0] if prints.inputFiles() else None
    out, saved = shared_dir(spark), {}
    schema = "digest string, best struct<n_chars: bigint, rank: bigint, locator: string>, group_size bigint"
    spark.createDataFrame([], schema).write.parquet(f"{out}/batch=-1")
    if source:
        for key, value in {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64", "spark.sql.streaming.stateStore.maintenanceInterval": "10s", "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}.items():
            saved[key] = spark.conf.get(key, None)
            spark.conf.set(key, value)
        # the complement of an id falls as the id rises, and cannot overflow
        state = spark.readStream.schema(prints.schema).parquet(source).groupBy("digest").agg(
            F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("rank"), "locator")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        query = (state.writeStream.outputMode("update").option("checkpointLocation", shared_dir(spark)).trigger(availableNow=True)
                 .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start())
        try:
            query.awaitTermination()
        finally:
            query.stop()
            for key, value in saved.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    # sizes only grow, so the largest is the latest word on a digest
    last = spark.read.schema(f"{schema}, batch long").parquet(out).groupBy("digest").agg(F.max(F.struct("group_size", "best")).alias("s"))
    return last.select("digest", F.bitwise_not("s.best.rank").alias("keep_id"), F.col("s.best.n_chars").alias("keep_chars"), F.col("s.best.locator").alias("locator"), F.col("s.group_size").alias("group_size"))


def unequal(docs: DataFrame, members: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Members of a group whose bytes differ from the retained row's: doc_id, digest.

    Only the texts of groups are shuffled.  Both sides are dealt by (digest, salt), so a hot group spreads.
    """
    files = 1 + members.count() // NARROW
    hits = stored(members.where("group_size > 1").select("doc_id", "digest", "keep_id", "group_size"), files)
    found = split_by_id(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), hits.select(F.col("doc_id").alias("_id")))[1]
    text = without_blanks(F.col("text"))
    texts = found.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), text.alias("bytes")).join(hits, ["doc_id", "digest"])
    texts = stored(texts, 1 + hits.count() // WIDE)  # read twice
    salts = F.floor(F.col("group_size") / ROWS_PER_SALT).cast("int")
    rows = texts.where("doc_id != keep_id").select("doc_id", "digest", "bytes", F.pmod(F.xxhash64("doc_id"), salts + 1).cast("int").alias("salt"))
    kept = texts.where("doc_id = keep_id").dropDuplicates(["digest"]).select("digest", F.col("bytes").alias("kept_bytes"), F.explode(F.sequence(F.lit(0), salts)).alias("salt"))
    odd = stored(rows.join(kept, ["digest", "salt"]).where("bytes != kept_bytes").select("doc_id", "digest"), files)
    dropped(hits, texts)
    return odd


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, locator (file of the row that stays) for each document."""
    return _dedup(docs, digest).drop("n_chars", "copies")


def _dedup(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Also n_chars of the document and how many rows repeat it."""
    prints = fingerprints(docs, digest).groupBy("doc_id", "digest", "n_chars", "text_sha256").agg(F.min("locator").alias("locator"), F.count(F.lit(1)).alias("copies"))
    files = 1 + docs.count() // NARROW
    prints = stored(prints, files)
    members = stored(_members(prints, files), files)
    odd = unequal(docs, members, digest)
    if odd.isEmpty():
        kept = (F.col("doc_id") == F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
        return members.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", F.col("keep_locator").alias("locator"), "n_chars", "copies")
    return _regrouped(docs, members, odd, digest)


def _members(prints: DataFrame, files: int) -> DataFrame:
    # stored, so that the join deals both sides itself and Spark can split a hot digest
    groups = stored(retained(prints).select("digest", "keep_id", "keep_chars", "group_size", F.col("locator").alias("keep_locator")), files)
    return prints.join(groups, "digest")


def _regrouped(docs: DataFrame, members: DataFrame, odd: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Groups whose digest collided, by the text itself; the others as they are."""
    split = odd.select("digest").distinct()
    text = without_blanks(F.col("text"))
    mixed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), text.alias("bytes")).join(split, "digest", "left_semi").dropDuplicates(["doc_id", "bytes"])
    mixed = mixed.join(members.select("doc_id", "digest", "text_sha256", "n_chars", "locator", "copies"), ["doc_id", "digest"]).where(F.col("text_sha256") == sha256(F.col("bytes")))
    best = mixed.groupBy("bytes").agg(F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("rank"), "locator")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    columns = ["doc_id", "keep_id", "keep_chars", "group_size", "text_sha256", "locator", "n_chars", "copies"]
    again = mixed.join(best, "bytes").select("doc_id", F.bitwise_not("best.rank").alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), "group_size", "text_sha256", F.col("best.locator").alias("locator"), "n_chars", "copies")
    rest = members.join(split, "digest", "left_anti").drop("locator").withColumnRenamed("keep_locator", "locator").select(*columns)
    kept = (F.col("doc_id") == F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return rest.unionByName(again).withColumn("kept", kept).drop("keep_chars")


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """Filter form: the documents that stay, whole rows.

    Documents that are alone or repeated nowhere pass without a shuffle; the others are joined with the
    result by (doc_id, length, text without blanks), so one doc_id with several texts loses none of them.
    Rows without doc_id go.
    """
    docs, found = docs.where(F.col("doc_id").isNotNull()), stored(_dedup(docs, sha256), 1 + docs.count() // NARROW)
    some = found.where("NOT kept OR copies > 1").select(F.col("doc_id").alias("_id"))
    clean, rest = split_by_id(docs, some)
    stay = found.where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("n_chars").alias("_kept_chars"), F.col("text_sha256").alias("_kept_digest"), F.col("copies").alias("_kept_copies"))
    same = (rest["doc_id"].cast("long") == stay["_kept_id"]) & (F.coalesce(F.char_length(rest["text"]), F.lit(0)) == stay["_kept_chars"]) & (sha256(without_blanks(rest["text"])) == stay["_kept_digest"])
    once = rest.join(stay.where("_kept_copies = 1"), same, "left_semi")
    again = stay.where("_kept_copies > 1")
    if again.isEmpty():
        return clean.unionByName(once)
    names = [f"_c{k}" for k in range(len(docs.columns))]
    more = rest.join(again, same, "left_semi").toDF(*names)
    ids, texts = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    key = F.struct(F.col(ids), F.coalesce(F.char_length(texts), F.lit(0)), sha256(without_blanks(F.col(texts))))
    more = more.withColumn("_key", key).dropDuplicates(["_key"]).drop("_key").toDF(*docs.columns)
    return clean.unionByName(once).unionByName(more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("locator")


SQL = """
WITH t AS (
  SELECT DISTINCT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents WHERE doc_id IS NOT NULL),
g AS (
  SELECT doc_id, n_chars, norm, first_value(doc_id) OVER w AS keep_id, first_value(n_chars) OVER w AS keep_chars, count(*) OVER (PARTITION BY norm) AS group_size
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND n_chars = keep_chars AS kept, sha256(norm) AS text_sha256 FROM g
"""
