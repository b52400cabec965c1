"""The registered queries: those with SQL against it, the others by what they cover."""

from __future__ import annotations

import pytest
from helpers import DATA, same_as_sql

from tidegrid.llm.queries import ORACLES, QUERIES

SMALL = str(DATA / "sf0.001")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_is_like_its_sql(spark, name):
    assert same_as_sql(spark, QUERIES[name], ORACLES[name], SMALL)


@pytest.mark.parametrize(("name", "table", "columns"), [
    ("op1_media", "pages", {"page_id", "status", "thumb_hash"}), ("op2_quality", "documents", {"doc_id", "quality", "keep"}), ("op3_toxicity", "documents", {"doc_id", "p_toxic_prose", "toxic"}),
    ("op4_packing", "documents", {"doc_id", "bin", "n_tokens"}), ("op6_pieces", "documents", {"doc_id", "ids", "decoded"}), ("op9_phrases", "documents", {"doc_id", "class_id", "links"}),
])
def test_query_without_sql_covers_its_table(spark, name, table, columns):
    got = QUERIES[name](spark, SMALL)
    assert columns <= set(got.columns)
    key = "page_id" if table == "pages" else "doc_id"
    assert {r[0] for r in got.select(key).collect()} == {r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect()}
