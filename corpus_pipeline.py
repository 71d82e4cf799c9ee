"""Training-data pipeline: documents in, packed sequences out.

Each stage gets the whole of what its predecessor kept.  All but the last return whole rows of
``documents``; stages are written to the session's shared folder and read back, so a lost executor
costs one stage at most.

Rows without doc_id go in the first stage.  Null and empty texts are documents like any other: the
stages score them as empty, keep one of each group of equal texts, and pack what stays.  Any column may
be null, and further columns of any name pass through.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinlink.llm import decontamination, exact_dedup, jaccard_join, packing, toxicity
from kinlink.llm.shared import dropped, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the machine, learnt from ``labels``, does not call toxic. Rows that repeat a doc_id go together."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks, the longest row, then the smallest doc_id; one of repeated rows."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links (similarity of 0.75 or more), the smallest doc_id; documents without words all stay."""
    return jaccard_join.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a ``benchmark`` item; all rows where that table is empty."""
    return decontamination.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and place; repeated rows are packed once each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The toxicity stage is a trained model, which SQL cannot express; tests hold the other stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            dropped(last)
            last = docs
    return docs
