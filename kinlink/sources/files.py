"""Tab-separated records and id lists, Parquet artifacts, provenance and reports.

Files are read and written by Spark only, so any store that Spark reaches will do.  Text files have no
quoting and no escapes: quotes are part of a name.  An empty field is an empty string, never null.
"""

from __future__ import annotations

import datetime
import json
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import keys as K

# The columns of the files.
SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
MATCHING_HEADER = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_HEADER = ("source1_entity_id", "candidate_entity_ids")


def scan_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, by the header line; empty fields stay empty."""
    return spark.read.options(sep="\t", quote="", header="true", encoding="UTF-8").csv(path).na.fill("")


def scan_source(spark: SparkSession, path: str) -> DataFrame:
    df = scan_tsv(spark, path)
    if df.columns != SOURCE_COLUMNS:
        raise ValueError(f"{path}: unexpected columns {df.columns}")
    return df


def load_split(spark: SparkSession, folder: str, split: str) -> dict[str, DataFrame]:
    """s1, s2, s3, and for train the truth."""
    if split not in ("train", "test"):
        raise ValueError("split must be 'train' or 'test'")
    out = {f"s{k}": scan_source(spark, f"{folder}/{split}/{split}_source{k}.tsv") for k in (1, 2, 3)}
    if split == "train":
        out["truth"] = scan_tsv(spark, f"{folder}/train/train_ground_truth.tsv")
    return out


def records_union(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """eid, source, country, name, address of all sources; an id of another source or a repeated one is an error."""
    rows = None
    for k in (1, 2, 3):
        eid = K.eid_encode(F.col("entity_id"), strict=True)
        own = F.when(K.source_of(eid) == k, eid).otherwise(F.raise_error(F.lit(f"source {k} has ids of another source")).cast("long"))
        part = scan_source(spark, f"{folder}/{split}/{split}_source{k}.tsv").select(own.alias("eid"), F.lit(k).cast("tinyint").alias("source"), "country", F.col("business_name").alias("name"), F.col("business_address").alias("address"))
        rows = part if rows is None else rows.unionByName(part)
    if not rows.groupBy("eid").count().where("count > 1").isEmpty():
        raise ValueError(f"repeated entity ids in {split}")
    return rows


def truth_pairs(table: DataFrame) -> DataFrame:
    """Comma lists (first column the entity, second its list) to distinct (s1, r); blank entries give no row."""
    s1, ids = (F.col(f"`{c}`") for c in table.columns[:2])
    r = table.select(s1.alias("a"), F.explode(F.split(ids, ",")).alias("b")).where("b != ''")
    return r.select(K.eid_encode(F.col("a"), strict=True).alias("s1"), K.eid_encode(F.col("b"), strict=True).alias("r")).distinct()


def read_id_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities in file order as (ord, entity_id), pairs); ord counts from 0 without gaps, through part files by their names.

    Spark deals files and their blocks to tasks by size, so a row's place is that of its block plus that in it.
    """
    table = scan_tsv(spark, path)
    rows = table.select(F.input_file_name().alias("_file"), F.input_file_block_start().alias("_start"), F.monotonically_increasing_id().alias("_at"), F.col(f"`{table.columns[0]}`").alias("entity_id"))
    blocks = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_file", "_start", (before - F.col("_first")).alias("_shift"))
    return rows.join(F.broadcast(blocks), ["_file", "_start"]).select((F.col("_at") + F.col("_shift")).alias("ord"), "entity_id"), truth_pairs(table)


def id_lists(order: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord, entity_id, ids): of each entity the comma list of its records, by number; only sources 2 and 3, only entities of ``order`` (ord, entity_id), each once."""
    if not order.groupBy("entity_id").count().where("count > 1").isEmpty():
        raise ValueError("the order repeats an entity")
    known = order.select("ord", "entity_id", K.eid_encode(F.col("entity_id"), strict=True).alias("s1"))
    p = pairs.select("s1", "r").distinct()
    if not p.where(~K.source_of(F.col("r")).isin(2, 3)).isEmpty():
        raise ValueError("a record is not of source 2 or 3")
    if not p.join(known, "s1", "left_anti").isEmpty():
        raise ValueError("a pair names an entity that is not in the order")
    lists = p.groupBy("s1").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: K.eid_decode(r)), ",").alias("ids"))
    return known.join(lists, "s1", "left").select("ord", "entity_id", F.coalesce("ids", F.lit("")).alias("ids"))


def write_id_lists(path: str, order: DataFrame, pairs: DataFrame, header: tuple[str, str], single: bool = False) -> None:
    """Part files in the given order, each with the header (``single``: one file, as the organizer's format has it)."""
    rows = id_lists(order, pairs).orderBy("ord").select(F.col("entity_id").alias(header[0]), F.col("ids").alias(header[1]))
    rows = rows.coalesce(1) if single else rows
    rows.write.mode("overwrite").options(sep="\t", quote="", header="true", emptyValue="", escapeQuotes="false").csv(path)


def write_matching(path: str, order: DataFrame, pairs: DataFrame, single: bool = True) -> None:
    write_id_lists(path, order, pairs, MATCHING_HEADER, single)


def write_candidates(path: str, order: DataFrame, pairs: DataFrame, single: bool = True) -> None:
    write_id_lists(path, order, pairs, CANDIDATE_HEADER, single)


def check_subset(matches: DataFrame, candidates: DataFrame) -> None:
    n = matches.select("s1", "r").distinct().join(candidates.select("s1", "r"), ["s1", "r"], "left_anti").count()
    if n:
        raise ValueError(f"{n} matched pairs are not candidates")


def write_submission(folder: str, order: DataFrame, candidates: DataFrame, matches: DataFrame) -> None:
    """Both lists, after the check that every match is a candidate."""
    check_subset(matches, candidates)
    write_candidates(f"{folder}/candidate_pairs.tsv", order, candidates)
    write_matching(f"{folder}/matching_results.tsv", order, matches)


# artifacts

def provenance(command: str | None = None, inputs: dict[str, str] | None = None, **extra) -> dict:
    try:
        commit = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=15, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        commit = "unknown"
    return {"git_commit": commit, "command": command or " ".join(sys.argv), "created": datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds"), "inputs": dict(inputs or {}), **extra}


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small text file through Hadoop's file systems: written beside, then renamed."""
    at, tmp = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".tmp"))
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(at, False)
    store.rename(tmp, at)


def _got(spark: SparkSession, path: str) -> str | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return "\n".join(r["value"] for r in spark.read.text(path).collect()) if store.exists(at) else None


def write_artifact(df: DataFrame, folder: str, kind: str, tag: str, split: str, rows_per_file: int = 0, **meta) -> str:
    """``<folder>/<kind>/<tag>/<split>.parquet`` in zstd with its provenance beside it; the job's committer leaves whole tables only."""
    path = f"{folder}/{kind}/{tag}/{split}.parquet"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)
    spark = df.sparkSession
    _put(spark, f"{path}.meta.json", json.dumps(provenance(kind=kind, tag=tag, split=split, rows=spark.read.parquet(path).count(), **meta)))
    return path


def read_artifact(spark: SparkSession, folder: str, kind: str, tag: str, split: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{kind}/{tag}/{split}.parquet")
    return df.select(*columns) if columns else df


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(_got(spark, f"{path}.meta.json") or "{}")


def write_report(spark: SparkSession, path: str, tag: str, payload: dict, merge: bool = True) -> dict:
    """A JSON report; keys of an earlier one stay unless replaced."""
    body = json.loads(_got(spark, path) or "{}") if merge else {}
    body |= {"tag": tag, **provenance(), **payload}
    _put(spark, path, json.dumps(body))
    return body


# keys of whole tables

def entity_sample(entities: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """All pairs of the n entities with the smallest hash (a sampling operator)."""
    few = entities.select("s1").distinct().orderBy(K.splitmix64(F.col("s1")), "s1").limit(n)
    return pairs.join(few, "s1", "left_semi")


def row_hash_key(records: DataFrame, tokens: str = "tokens") -> DataFrame:
    """eid and the key that records of one country with the same set of tokens share; null without tokens."""
    key = F.array_join(F.array_sort(F.array_distinct(tokens)), " ")
    return records.select("eid", F.when(key != "", F.concat_ws("|", "country", key)).alias("key"))


def exact_text_join(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(s1, r) whose fields are equal, where the fields name one record on each side."""
    alone = lambda t, name: t.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*columns))).where("_n = 1").select(F.col("eid").alias(name), *columns)
    return alone(left, "s1").join(alone(right, "r"), columns).select("s1", "r")
