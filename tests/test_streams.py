"""Streams that stop and go on give what one batch gives."""

import datetime as dt

from optlake.functions.median import middle_values
from optlake.streaming import ledger


def test_cost_goes_on_where_it_stopped(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    schema = "at timestamp, agent string, input_tokens long, output_tokens long, cost_usd double"
    first = [(at(0, 5), "a", 1, 1, 1.0), (at(0, 50), "a", 1, 1, 2.0), (at(1, 30), "b", 1, 1, 4.0)]
    second = [(at(1, 25), "a", 1, 1, 8.0), (at(0, 1), "a", 1, 1, 99.0), (at(3, 0), "b", 1, 1, 16.0)]
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        calls = spark.readStream.schema(schema).parquet(source)
        table = ledger.run_available(ledger.windowed_cost(calls), folder)
        return {(r.started.hour, r.agent): r.cost_usd for r in table.collect()}

    assert run(first) == {(0, "a"): 3.0}
    # 0:01 is later than the watermark allows; 1:25 still counts
    assert run(second) == {(0, "a"): 3.0, (1, "a"): 8.0, (1, "b"): 4.0}


def test_status_table_goes_on_and_compacts(spark, tmp_path):
    schema = "source string, version string, outcome string, finished_at timestamp, record_id long"
    source, every = str(tmp_path / "in"), []
    for k in range(7):
        rows = [(f"s{i % 3}", "1", "ok" if (i + k) % 2 else "failed", dt.datetime(2024, 1, 1 + (k * 5 + i) % 9), k * 10 + i) for i in range(6)]
        every += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        table = ledger.StatusTable(spark, str(tmp_path / "out"), compact=2)
        table.update(spark.readStream.schema(schema).parquet(source))
        want = sorted(map(tuple, ledger.latest_status(spark.createDataFrame(every, schema)).collect()))
        assert sorted(map(tuple, table.read().collect())) == want
        assert len(table._parts()) <= 3


def test_status_table_survives_a_crash(spark, tmp_path):
    """A merge that dies while it writes, with or without a file in its part, and then the
    replay of its batch, lose nothing; an empty folder is an empty table."""
    schema = "source string, version string, outcome string, finished_at timestamp, record_id long"
    row = lambda k: (f"s{k}", "1", "ok", dt.datetime(2024, 1, 1 + k), k)
    rows = lambda *ks: spark.createDataFrame([row(k) for k in ks], schema)
    table = ledger.StatusTable(spark, str(tmp_path / "out"), compact=3)
    seen = lambda: {r.source for r in table.read().collect()}
    assert seen() == set() and table.read().columns == ledger.latest_status(rows(1)).columns
    for k in range(3):
        table._save(rows(k), k)
    (tmp_path / "out" / "upto=000000000003").mkdir()
    assert seen() == {"s0", "s1", "s2"}
    ledger.latest_status(rows(9)).write.mode("overwrite").parquet(str(tmp_path / "out" / "upto=000000000003"))
    ledger.latest_status(rows(8)).write.parquet(str(tmp_path / "out" / "batch=000000000003"))
    assert seen() == {"s0", "s1", "s2"}
    table._save(rows(3), 3)
    assert seen() == {"s0", "s1", "s2", "s3"} and table._parts() == ["upto=000000000003"]
    # the merge was committed and the stream's progress was not: the batch comes again
    table._save(rows(3), 3)
    table._save(rows(4), 4)
    got = {r.source: r.failures for r in table.read().collect()}
    assert got == dict.fromkeys(["s0", "s1", "s2", "s3", "s4"], 0)


def test_medians_with_an_outlier(spark):
    rows = [("a", float(i % 1000)) for i in range(5000)] + [("a", 1e12), ("b", 3.0), ("b", None), ("c", -1.0), ("c", 5.0)]
    got = {r.k: (r.n, r.lower, r.upper) for r in middle_values(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {"a": (5001, 500.0, 500.0), "b": (1, 3.0, 3.0), "c": (2, -1.0, 5.0)}
