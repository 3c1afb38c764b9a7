"""Every registered query of the training-data operators runs on the driver's smallest tables; those with SQL agree with it."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from loomquill.llm import queries as Q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
#: The contract's columns, and the table of which there is one row each.
COLUMNS = {
    "op1_quality": "doc_id held_out score predicted",
    "op2_lm_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_near_duplicates": "doc_id class_id",
    "op5_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op6_pieces": "doc_id",
    "op7_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op8_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9_token_counts": "doc_id n_bytes n_tokens over_limit",
}


def canonical(df):
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    got = Q.QUERIES[name](spark, str(DATA)).toPandas()
    if name in COLUMNS:
        assert set(COLUMNS[name].split()) <= set(got.columns)
        docs = spark.read.parquet(str(DATA / "documents.parquet")).toPandas()
        assert sorted(got.doc_id) == sorted(docs.doc_id)
    if name in Q.ORACLE_SQL:
        con = duckdb.connect()
        for file in DATA.glob("*.parquet"):
            con.execute(f"create view {file.stem} as select * from '{file}'")
        want = con.sql(Q.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)
