"""Every query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from kinlink.plans import businesses, catalogue, decisions, edits, files, learnt, models, stages  # noqa: F401
from kinlink.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def text(v):
    return "NULL" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)


#: Without SQL, and quick to run; the trained models take long.
MORE = {"sim_ratio", "expected_f", "paired_bootstrap", "classify_ops", "rule_copy", "swapsim", "block_stage", "normalize_stage", "expected_f_full", "stacked_logit_eval", "segment_calibration", "synth_pairs"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) & (set(SQL) | MORE)))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*cols).collect())
    if name in SQL:
        rows = duck.sql(SQL[name])
        assert sorted(rows.columns) == cols
        assert got == sorted(tuple(map(text, r)) for r in rows.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    else:
        assert got
