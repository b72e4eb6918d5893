"""Queries against their SQL on the smallest tables, where these are present."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["q_contact_project", "q_coverage", "q_vc", "q_pyramid_chain", "q_paf_arbitrate", "q_nearest_k", "q_components", "q_edit_split", "q_topk_and", "q_edit_recommended", "q_pixel_problems", "q_link_scope", "q_ranges_closed", "q_mask_precedence"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, want))


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scratch_tables_can_be_cleared(spark):
    from strandloom.functions import storage

    kept = storage.materialise(spark.range(5), "numbers")
    path = kept.inputFiles()[0].removeprefix("file:")
    assert kept.count() == 5 and os.path.exists(path)
    storage.clear_scratch(spark)
    assert not os.path.exists(path)
