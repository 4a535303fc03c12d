"""Streaming queries, run to the end of the available data."""

import uuid

from pyspark.sql import functions as F

from optlake.catalog.registry import query
from optlake.catalog import packages  # noqa: F401
from optlake.session import shared_folder
from optlake.streaming import ledger as s


@query("t01_windowed_cost", """
SELECT strftime(time_bucket(INTERVAL '1 hour', stamp), '%Y-%m-%d %H:%M') AS started, agent, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 4) AS cost_usd
FROM v_ledger WHERE time_bucket(INTERVAL '1 hour', stamp) + INTERVAL '1 hour' <= (SELECT max(stamp) FROM v_ledger) - INTERVAL '10 minutes' GROUP BY 1, 2
""")
def _(v):
    schema = v.table("events").schema
    calls = v.spark.readStream.schema(schema).parquet(f"{v.folder}/events.parquet*").selectExpr(
        "cast(ts as timestamp) AS at", "event_type AS agent", "CAST(user_id * 10 AS BIGINT) AS input_tokens", "event_id % 500 AS output_tokens", "value AS cost_usd")
    out = s.run_available(s.windowed_cost(calls), f"{shared_folder(v.spark)}/cost-{uuid.uuid4().hex}")
    return out.select(F.date_format("started", "yyyy-MM-dd HH:mm").alias("started"), "agent", "calls", "input_tokens", "output_tokens", "cost_usd")


@query("t02_build_status", """
SELECT source, version, strftime(max(finished_at), '%Y-%m-%d') AS finished, (max((finished_at, outcome, record_id)))[2] AS outcome, count(*) FILTER (outcome <> 'ok') AS failures FROM v_records GROUP BY 1, 2
""")
def _(v):
    path = f"{shared_folder(v.spark)}/records-{uuid.uuid4().hex}"
    v("records").write.parquet(path)
    stream = v.spark.readStream.schema(v("records").schema).option("maxFilesPerTrigger", 4).parquet(path)
    table = s.StatusTable(v.spark, f"{shared_folder(v.spark)}/status-{uuid.uuid4().hex}", compact=2)
    table.update(stream)
    return table.read().select("source", "version", F.date_format("finished_at", "yyyy-MM-dd").alias("finished"), "outcome", "failures")
