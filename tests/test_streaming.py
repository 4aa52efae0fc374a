from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lumen.operators.drift import psi_categorical, psi_numeric
from lumen.streaming import drift, monitor


def test_stream_and_table_agree(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    out = monitor.windows(stream, "ts", "event_type", "value", F.col("value") > 50)
    got = monitor.run_to_end(spark, out, str(tmp_path / "out"), str(tmp_path / "ck"))
    want = monitor.windows(table, "ts", "event_type", "value", F.col("value") > 50)
    last = want.agg(F.max("start")).first()[0]
    # windows that the watermark has not passed yet are still open
    closed = {tuple(r)[:3] for r in got.collect()}
    assert closed and closed <= {tuple(r)[:3] for r in want.collect()}
    assert {r[0] for r in closed} >= {r["start"] for r in want.where(F.col("start") < F.lit(last) - F.expr("interval 2 hours")).collect()}


def test_drift_of_a_stream_and_of_its_table_agree(spark, tmp_path):
    base = spark.createDataFrame([(float(i % 10), "ab"[i % 2]) for i in range(400)], "v double, kind string")
    drift.Baseline.of(base, ["v", "kind"]).save(f"{tmp_path}/base.json")
    known = drift.Baseline.load(f"{tmp_path}/base.json")
    hour = lambda h, i: datetime.datetime(2024, 1, 1, h, i % 60)
    # the second hour's values move up, the third's are of one kind, the last closes the others
    rows = [(hour(h, i), None if i % 50 == 0 else float(i % 10 + 5 * (h == 1)), "ab"[i % 2] if h < 2 else "a" if i % 9 else "new") for h in range(3) for i in range(200)] + [(hour(5, 0), 1.0, "a")]
    table = spark.createDataFrame(rows, "at timestamp, v double, kind string")
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    got = {(r["start"].hour, r["column"]): r for r in monitor.run_to_end(spark, drift.drift_windows(stream, "at", known), f"{tmp_path}/out", f"{tmp_path}/ck").collect()}
    want = {(r["start"].hour, r["column"]): r for r in drift.drift_windows(table, "at", known).collect()}
    assert len(got) == 6 and all(got[k] == want[k] for k in got) and set(want) - set(got) == {(5, "v"), (5, "kind")}
    assert [got[h, "v"]["drifted"] for h in range(3)] == [False, True, False] and [got[h, "kind"]["drifted"] for h in range(3)] == [False, False, True]
    for h in range(3):
        part = table.where(F.hour("at") == h)
        for c, r in ((r["column"], r["psi"]) for r in psi_numeric(base, part, ["v"]).union(psi_categorical(base, part, ["kind"])).collect()):
            assert got[h, c]["psi"] == pytest.approx(r, abs=1e-12)


def test_late_rows_and_flat_columns(spark, tmp_path):
    known = drift.Baseline.of(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "v double, flat double"), ["v", "flat"])
    at = lambda m: datetime.datetime(2024, 1, 1, 0) + datetime.timedelta(minutes=m)
    schema = "at timestamp, v double, flat double"
    for name, rows in (("a", [(at(1), 1.0, 2.0), (at(65), 1.0, 2.0)]), ("b", [(at(58), 3.0, 2.0), (at(200), 1.0, 2.0)]), ("c", [(at(5), 3.0, 2.0), (at(400), 1.0, 2.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = monitor.run_to_end(spark, drift.drift_windows(stream, "at", known), f"{tmp_path}/out", f"{tmp_path}/ck")
    first = [r for r in out.where("column = 'v'").collect() if r["start"] == at(0)]
    # ten minutes late still counts, hours late does not
    assert len(first) == 1 and first[0]["n"] == 2
    assert {r["psi"] for r in out.where("column = 'flat'").collect()} == {0.0}
