import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_entry_points_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r["phi"] <= 1.0 or r["phi"] < 1.0 for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["bezier_point", "orientation_entropy", "circuity_decomposition", "endpoint_audit", "snapping_sensitivity", "segment_crossings", "anomaly_registry", "id_reconciliation", "keep_apart", "reconciled_intersections", "polyline_crossings", "event_rollup", "compact_ranks"])
def test_like_duckdb(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("embeddings", "lineitem", "orders", "events", "supplier"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()[list(want.columns)]
    key = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert len(got) == len(want)
    assert key(got) == key(want)
