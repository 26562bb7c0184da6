"""Registered queries of the training-data operators against their SQL."""

import os

import pytest

pytest.importorskip("barlens.llm")
duckdb = pytest.importorskip("duckdb")
from barlens.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    cur = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want) > 0
    assert [g for g, w in zip(got, want) if g != w and g != pytest.approx(w)] == []
