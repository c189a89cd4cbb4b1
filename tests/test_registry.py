import os

import pytest

import __spark_entry__ as entry
from lodestone.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_twin_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["u2_normalize_url", "u8_pattern_of", "agg1_merge_index", "j3_balanced_pairs", "g11_upgrade_candidates", "ord6_frontier_topk", "d1_job_plan", "st3_generations"])
def test_query_equals_its_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    expected = con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    rows = lambda df: sorted(tuple(str(v).removesuffix(".0").replace("nan", "None") for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got.toPandas()) == rows(expected)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
