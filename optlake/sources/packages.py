"""Package indexes, installed lists, ledgers and build records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optlake.sources.configs import text_lines

LEDGER_SCHEMA = "at timestamp, agent string, input_tokens long, output_tokens long, cost_usd double, bad string"
RECORD_SCHEMA = "source string, version string, flags_hash string, outcome string, duration_s double, finished_at timestamp, bad string"

ITERATION_SCHEMA = "host long, iteration int, proposals array<string>, measurements struct<size_bytes: double>, regressed boolean, bad string"


def source_stanzas(texts: DataFrame) -> DataFrame:
    """Stanzas of a source index: ``(…, stanza_no, source, version, binaries,
    build_depends)``. Continuation lines are joined; stanzas without a name or a version
    are dropped."""
    keys = [c for c in texts.columns if c != "text"]
    block = texts.select(*keys, F.posexplode(F.split("text", r"\n\s*\n")).alias("stanza_no", "block"))
    block = block.withColumn("block", F.regexp_replace("block", r"\n[ \t]+", " "))
    field = lambda k: F.trim(F.regexp_extract("block", rf"(?m)^{k}:(.*)$", 1))
    listed = lambda text: F.filter(F.transform(F.split(text, r"\s*,\s*"), lambda b: F.trim(b)), lambda b: b != "")
    clauses = F.concat_ws(",", *[F.regexp_extract("block", rf"(?m)^{k}:(.*)$", 1) for k in ("Build-Depends", "Build-Depends-Indep", "Build-Depends-Arch")])
    names = F.transform(F.split(clauses, r"[,|]"), lambda d: F.trim(F.split(d, r"[(\[<]")[0]))
    return block.select(
        *keys, "stanza_no", field("Package").alias("source"), field("Version").alias("version"), listed(field("Binary")).alias("binaries"),
        F.array_sort(F.array_distinct(F.filter(names, lambda n: n != ""))).alias("build_depends"),
    ).where("source <> '' AND version <> ''")


def installed_packages(texts: DataFrame) -> DataFrame:
    """Six tab-separated fields per line; only installed rows, unreadable sizes are 0."""
    p = F.split("line", "\t")
    return text_lines(texts).where((F.size(p) == 6) & (p[5] == "installed")).select(
        "host", p[0].alias("binary"), F.when(p[2] == "", p[0]).otherwise(p[2]).alias("source"), p[3].alias("source_version"),
        F.when(p[1] == "", "optional").otherwise(p[1]).alias("priority"), F.coalesce(p[4].try_cast("bigint"), F.lit(0)).alias("installed_kb"),
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; lines that do not read are dropped."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)
    return rows.where("bad IS NULL").drop("bad")


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_alarms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="arch string, selectee string, selector string, visib_id string, constraint_type string, analysis_result string, verified string, testcase string")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` as ``(path, bytes, sha256)``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree_digest(artifacts: DataFrame, key: str) -> DataFrame:
    """One digest per tree over paths and hashes. Rows are first digested in buckets by
    path hash, so no group holds a whole tree."""
    bucket = F.substring(F.sha2("path", 256), 1, 4)
    line = F.concat_ws(" ", "path", "sha256")
    parts = artifacts.groupBy(key, bucket.alias("bucket")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("part"), F.count(F.lit(1)).alias("files"))
    return parts.groupBy(key).agg(F.sum("files").alias("files"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "part"))), lambda p: F.concat_ws(" ", p["bucket"], p["part"])), "\n"), 256).alias("digest"))
