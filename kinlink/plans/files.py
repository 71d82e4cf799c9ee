"""Queries of the readers, writers and keys: files are written from the customer table, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keys as K
from ..operators.tables import folder
from ..sources import files as S
from .catalogue import _EDGES, _RECORDS, _TOKENS, _read, edges, records
from .registry import query

_BASE = "base AS (SELECT c_custkey AS k, 'S' || CAST(1 + c_custkey % 3 AS VARCHAR) || '-' || CAST(c_custkey AS VARCHAR) AS entity_id, '\"' || c_name || '\" & son''s' AS business_name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment || ', ' || CAST(c_nationkey AS VARCHAR) END AS business_address, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'N' || CAST(c_nationkey AS VARCHAR) END AS country FROM customer)"
_EID = "CAST(substr(entity_id, 2, 1) AS BIGINT) * 1000000000 + k"
_ROWS = f"{_BASE}, recs AS (SELECT {_EID} AS eid, CAST(1 + k % 3 AS TINYINT) AS source, country, business_name AS name, business_address AS address FROM base)"
_LISTS = f"{_BASE}, lists AS (SELECT k, entity_id AS source1_entity_id, CASE WHEN k % 2 = 0 THEN 'S2-' || CAST(k + 1 AS VARCHAR) || ',,S3-' || CAST(k + 2 AS VARCHAR) || ',S2-' || CAST(k + 1 AS VARCHAR) ELSE '' END AS matched_entity_ids FROM base WHERE k % 3 = 0), pairs AS (SELECT DISTINCT 1000000000 + k AS s1, 2000000001 + k AS r FROM lists WHERE k % 2 = 0 UNION SELECT 1000000000 + k, 3000000002 + k FROM lists WHERE k % 2 = 0)"


def base(spark, d):
    k = F.col("c_custkey")
    return _read(spark, d, "customer").select(
        k.alias("k"), F.concat(F.lit("S"), (1 + k % 3).cast("string"), F.lit("-"), k.cast("string")).alias("entity_id"), F.concat(F.lit('"'), "c_name", F.lit("\" & son's")).alias("business_name"),
        F.when(k % 4 == 0, "").otherwise(F.concat_ws(", ", "c_mktsegment", F.col("c_nationkey").cast("string"))).alias("business_address"), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("country"))


def split_folder(spark, d):
    """A train split in the files' format."""
    out, rows = f"{folder(spark)}/{uuid.uuid4().hex}", base(spark, d)
    write = lambda df, name: df.write.options(sep="\t", quote="", header="true", emptyValue="", escapeQuotes="false").csv(f"{out}/train/{name}")
    for s in (1, 2, 3):
        write(rows.where(1 + F.col("k") % 3 == s).select(*S.SOURCE_COLUMNS), f"train_source{s}.tsv")
    pieces = F.concat(F.lit("S2-"), (F.col("k") + 1).cast("string"), F.lit(",,S3-"), (F.col("k") + 2).cast("string"), F.lit(",S2-"), (F.col("k") + 1).cast("string"))
    write(rows.where("k % 3 = 0").orderBy("k").select(F.col("entity_id").alias("source1_entity_id"), F.when(F.col("k") % 2 == 0, pieces).otherwise("").alias("matched_entity_ids")), "train_ground_truth.tsv")
    return out


for _s, _name in ((1, "scan_tsv"), (2, "scan_source")):
    @query(_name, f"WITH {_BASE} SELECT entity_id, business_name, business_address, country FROM base WHERE 1 + k % 3 = {_s}")
    def _scan(spark, d, _s=_s):
        return (S.scan_tsv if _s == 1 else S.scan_source)(spark, f"{split_folder(spark, d)}/train/train_source{_s}.tsv")


@query("load_split", f"WITH {_BASE} SELECT 's' || CAST(1 + k % 3 AS VARCHAR) AS part, count(*) AS n FROM base GROUP BY 1 UNION ALL SELECT 'truth', count(*) FROM base WHERE k % 3 = 0")
def _load(spark, d):
    rows = None
    for name, df in S.load_split(spark, split_folder(spark, d), "train").items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows


query("records_union", f"WITH {_ROWS} SELECT * FROM recs")(lambda spark, d: S.records_union(spark, split_folder(spark, d), "train"))
query("truth_pairs", f"WITH {_LISTS} SELECT * FROM pairs")(lambda spark, d: S.truth_pairs(S.load_split(spark, split_folder(spark, d), "train")["truth"]))


@query("read_id_lists", f"WITH {_LISTS} SELECT row_number() OVER (ORDER BY k) AS place, source1_entity_id AS entity_id, (SELECT count(*) FROM pairs WHERE s1 = 1000000000 + k) AS n FROM lists")
def _read_lists(spark, d):
    order, pairs = S.read_id_lists(spark, f"{split_folder(spark, d)}/train/train_ground_truth.tsv")
    n = pairs.groupBy(K.eid_decode(F.col("s1")).alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    return order.join(n, "entity_id", "left").na.fill(0, ["n"]).select((F.col("ord") + 1).alias("place"), "entity_id", "n")


_JOINED = f"WITH {_LISTS} SELECT source1_entity_id, coalesce((SELECT string_agg('S' || CAST(r // 1000000000 AS VARCHAR) || '-' || CAST(r % 1000000000 AS VARCHAR), ',' ORDER BY r) FROM pairs WHERE s1 = 1000000000 + k), '') AS %s FROM lists"
for _name, _column in (("write_id_lists", "matched_entity_ids"), ("write_matching", "matched_entity_ids"), ("write_candidates", "candidate_entity_ids")):
    @query(_name, _JOINED.replace("%s", _column))
    def _write(spark, d, _name=_name):
        order, pairs = S.read_id_lists(spark, f"{split_folder(spark, d)}/train/train_ground_truth.tsv")
        out = f"{folder(spark)}/{uuid.uuid4().hex}.tsv"
        S.write_id_lists(out, order, pairs, S.MATCHING_HEADER) if _name == "write_id_lists" else getattr(S, _name)(out, order, pairs)
        return S.scan_tsv(spark, out)


@query("write_submission", f"{_JOINED.replace('%s', 'matched_entity_ids').replace('FROM pairs', 'FROM pairs p')}".replace("s1 = 1000000000 + k)", "s1 = 1000000000 + k AND r // 1000000000 = 2)"))
def _submission(spark, d):
    order, pairs = S.read_id_lists(spark, f"{split_folder(spark, d)}/train/train_ground_truth.tsv")
    out = f"{folder(spark)}/{uuid.uuid4().hex}"
    S.write_submission(out, order, pairs, pairs.where(K.source_of(F.col("r")) == 2))
    return S.scan_tsv(spark, f"{out}/matching_results.tsv")


query("check_subset", "SELECT 0::BIGINT AS outside")(lambda spark, d: (S.check_subset(edges(spark, d).where("p >= 0.5"), edges(spark, d)), spark.range(1).select(F.lit(0).cast("long").alias("outside")))[1])


def artifact(spark, d, **more):
    out = f"{folder(spark)}/{uuid.uuid4().hex}"
    return out, S.write_artifact(edges(spark, d), out, "scores", "one", "train", **more)


_E = "WITH " + _EDGES
query("parquet_artifact_write", _E + " SELECT * FROM edges")(lambda spark, d: spark.read.parquet(artifact(spark, d)[1]))
query("parquet_artifact_read", _E + " SELECT s1, r, p FROM edges")(lambda spark, d: S.read_artifact(spark, artifact(spark, d)[0], "scores", "one", "train", ["s1", "r", "p"]))
query("chunked_writer", _E + " SELECT count(*) AS rows, true AS several FROM edges")(
    lambda spark, d: spark.read.parquet(artifact(spark, d, rows_per_file=500)[1]).select("*", F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("rows"), (F.countDistinct("f") > 1).alias("several")))


@query("read_meta", _E + " SELECT 'scores' AS kind, 'one' AS tag, 'train' AS split, count(*) AS rows FROM edges")
def _meta(spark, d):
    m = S.read_meta(spark, artifact(spark, d)[1])
    return spark.createDataFrame([(m["kind"], m["tag"], m["split"], m["rows"])], "kind string, tag string, split string, rows long")


@query("write_report", "SELECT unnest(['a', 'b', 'tag']) AS key, unnest(['1', '3', 'two']) AS value")
def _report(spark, d):
    path = f"{folder(spark)}/{uuid.uuid4().hex}.json"
    S.write_report(spark, path, "one", {"a": 1, "b": 2})
    body = S.write_report(spark, path, "two", {"b": 3})
    return spark.createDataFrame([(k, str(body[k])) for k in ("a", "b", "tag")], "key string, value string")


# keys

_K = "SELECT c_custkey AS k, 1000000000 * (1 + c_custkey % 3) + c_custkey AS eid FROM customer"
query("eid_decode", f"SELECT k, 'S' || CAST(eid // 1000000000 AS VARCHAR) || '-' || CAST(eid % 1000000000 AS VARCHAR) AS id, eid // 1000000000 AS source FROM ({_K})")(
    lambda spark, d: _read(spark, d, "customer").select(F.col("c_custkey").alias("k"), (1_000_000_000 * (1 + F.col("c_custkey") % 3) + F.col("c_custkey")).alias("eid")).select("k", K.eid_decode(F.col("eid"), strict=True).alias("id"), K.source_of(F.col("eid")).alias("source")))
_HASH = """WITH a AS (SELECT c_custkey AS key, (xor(c_custkey::UBIGINT, 77::UBIGINT)::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z0 FROM customer), b AS (SELECT key, (xor(z0::UBIGINT, z0::UBIGINT >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z1 FROM a),
  c AS (SELECT key, (xor(z1::UBIGINT, z1::UBIGINT >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z2 FROM b), z AS (SELECT key, xor(z2::UBIGINT, z2::UBIGINT >> 31) AS z FROM c)"""
query("hash_slice", _HASH + " SELECT key FROM z WHERE z % 10 = 0")(lambda spark, d: _read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("key")).where(K.hash_slice(F.col("key"), 77, 10)))
query("entity_sample")(lambda spark, d: S.entity_sample(edges(spark, d), edges(spark, d), 40))
query("row_hash_key", f"WITH {_RECORDS}, t AS (SELECT eid, country, list_sort(list_distinct({_TOKENS})) AS t FROM records) SELECT eid, CASE WHEN len(t) > 0 THEN country || '|' || array_to_string(t, ' ') END AS key FROM t")(
    lambda spark, d: S.row_hash_key(records(spark, d).withColumn("tokens", T.name_tokens(F.col("name")))))
query("exact_text_key", """WITH a AS (SELECT any_value(c_custkey) AS s1, c_nationkey AS n, c_mktsegment AS m FROM customer WHERE c_custkey % 2 = 0 GROUP BY 2, 3 HAVING count(*) = 1), b AS (SELECT any_value(c_custkey) AS r, c_nationkey AS n, c_mktsegment AS m FROM customer WHERE c_custkey % 2 = 1 GROUP BY 2, 3 HAVING count(*) = 1) SELECT s1, r FROM a JOIN b USING (n, m)""")(
    lambda spark, d: (lambda t: S.exact_text_join(t.where("eid % 2 = 0"), t.where("eid % 2 = 1"), ["n", "m"]))(_read(spark, d, "customer").select(F.col("c_custkey").alias("eid"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"))))
