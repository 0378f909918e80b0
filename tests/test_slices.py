from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions import slices


def test_nested_values_and_nulls(spark):
    rows = [(k, None if k % 5 == 0 else [{"a": k, "m": {"x": str(k)}}]) for k in range(1000)]
    df = spark.createDataFrame(rows, "k long, v array<struct<a:long,m:map<string,string>>>").coalesce(1)
    same = slices.by_rows(lambda k, v: {"n": k, "v": v, "m": {"e": [k]} if v else None}, "struct<n:long,v:array<struct<a:long,m:map<string,string>>>,m:map<string,array<long>>>")
    got = df.select("k", "v", same("k", "v").alias("r")).collect()
    assert len(got) == 1000 and all(r["r"]["n"] == r["k"] and r["r"]["v"] == r["v"] and r["r"]["m"] == ({"e": [r["k"]]} if r["v"] else None) for r in got)
    assert df.where("k < 0").select(slices.by_rows(str, "string")("k")).collect() == []


def test_a_batch_is_never_all_objects(spark, monkeypatch):
    """Pages of one task are parsed and put out a slice at a time: of no result more than a slice is held."""
    from weftline.operators import extract

    made = []

    monkeypatch.setattr(slices.F, "arrow_udf", lambda run, kind: lambda *cols: made.append(run) or F.lit(None))
    extract.select_xpath(F.lit(""), "//a/@href")
    batch = pa.array(["<a href='/1'>x</a>"] * 1000)
    sizes = [len(x) for x in made[0](iter([batch]))]
    assert sum(sizes) == 1000 and max(sizes) <= slices.ROWS
