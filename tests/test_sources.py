"""Pruned scans and provider pages."""

import json

import pytest
from pyspark.sql import functions as F

from barlens.session import scratch_path
from barlens.sources import readers as R
from barlens.sources import writers as W


def bars(spark, n=2000):
    names = ["click", "CLICK", "View", "zeta", "Émile", "a", "Delta"]
    return spark.range(n).select(F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int")).alias("symbol"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("double").alias("close"))


def scanned_rows(df):
    """Rows that the file scan itself returned."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.executedPlan().collectLeaves() if plan.nodeName() == "AdaptiveSparkPlan" else plan.collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_scans_by_symbol_skip_row_groups(spark):
    keyed, plain = scratch_path(spark, "keyed"), scratch_path(spark, "plain")
    W.write_bars(bars(spark), keyed, rows=100)
    bars(spark).repartitionByRange(10, "symbol").sortWithinPartitions("symbol").write.parquet(plain)
    want = bars(spark).where(F.upper("symbol").isin("CLICK", "VIEW")).count()
    for path in (keyed, plain):
        hit = R.scan_bars(spark, path, symbols=["Click", "VIEW"])
        assert hit.count() == want and "symbol_key" not in hit.columns
        assert want <= scanned_rows(hit) < 0.75 * bars(spark).count(), path
    assert R.scan_bars(spark, keyed, symbols=["émile"]).count() == R.scan_bars(spark, plain, symbols=["émile"]).count() > 0
    assert R.scan_bars(spark, keyed, symbols=[]).count() == 0 == R.scan_bars(spark, plain, symbols=[]).count()
    assert scanned_rows(R.scan_bars(spark, keyed, symbols=["CLICKS"])) == 0, "between two symbols: the Bloom filter knows"


def page(symbol, *days):
    return json.dumps({"bars": {symbol: [{"t": f"2024-01-{d:02}T05:00:00Z", "o": 1.0, "h": 1.0, "l": 1.0, "c": float(d), "v": 5, "n": 1, "vw": 1.0} for d in days]}})


def test_pages_are_read_one_a_file(spark):
    path = scratch_path(spark, "pages")
    for i, text in enumerate([page("abc", 2, 3), page("ABC", 4), page("xyz", 2)]):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/p={i}")
    ids = spark.createDataFrame([("Abc", "i1"), ("XYZ", "i2")], "symbol string, instrument_id string")
    pages = R.provider_pages(spark, f"{path}/p=*")
    assert pages.count() == 3
    flat = R.flatten_provider_json(pages, ids, strict=True)
    assert sorted((r.instrument_id, r.close) for r in flat.collect()) == [("i1", 2.0), ("i1", 3.0), ("i1", 4.0), ("i2", 2.0)]


@pytest.mark.parametrize("text, why", [(page("nope", 2), "unknown_symbol for NOPE"), (page("abc", 2, 2), "duplicate_day for ABC")])
def test_faulty_pages_are_errors_when_strict(spark, text, why):
    pages = spark.createDataFrame([(text,)], "value string")
    ids = spark.createDataFrame([("ABC", "i1")], "symbol string, instrument_id string")
    assert R.flatten_provider_json(pages, ids).where(F.size("violations") > 0).count() > 0
    with pytest.raises(Exception, match=why):
        R.flatten_provider_json(pages, ids, strict=True).collect()
