"""A few queries against their SQL on the smallest tables; the driver runs them all."""

import duckdb
import pytest

from probatio import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["secrets_per_document", "code_stats", "layout_metrics", "duplication", "patch_code", "tree_facts", "tree_sites", "line_rules_templated", "running_statistics", "cache_keys"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "orders", "part", "events", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    cursor = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    norm = lambda x: round(float(x), 5) if isinstance(x, float) else x
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(norm(float(x) if type(x).__name__ == "Decimal" else x) for x in r) for r in cursor.fetchall()), key=repr)
