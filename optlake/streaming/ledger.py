"""Incremental forms of the cost ledger and of build status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_cost(calls: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Cost and tokens per agent and tumbling window; works on a batch or a stream.

    On a stream, lines up to ``late`` behind the newest one still count, and a window is
    emitted once when it can no longer change, so state holds open windows only.
    """
    rows = calls.withWatermark("at", late) if calls.isStreaming else calls
    return rows.groupBy(F.window("at", window).alias("w"), "agent").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd")
    ).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "agent", "calls", "input_tokens", "output_tokens", "cost_usd")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Process what has arrived since the last call with this folder, append the windows
    that closed, return the table of all closed windows."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/windows").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/windows")


def latest_status(records: DataFrame) -> DataFrame:
    """Latest record per source and version, with failures so far: ``(source, version,
    finished_at, outcome, record_id, failures)``."""
    rows = records.withColumn("failures", (F.col("outcome") != "ok").cast("long")) if "failures" not in records.columns else records
    latest = F.max(F.struct("finished_at", "outcome", "record_id")).alias("m")
    return rows.groupBy("source", "version").agg(latest, F.sum("failures").alias("failures")).select("source", "version", "m.*", "failures")


class StatusTable:
    """Latest statuses in a folder, kept up to date from a stream of records.

    A batch is aggregated by itself and written as a part, so the stream holds no state;
    every ``compact`` batches what has been written is merged into one part. A part counts
    only once its commit record is there, which is written after its data in one step: a
    part that a crash left half-written is ignored, what it should have replaced is still
    read, and the replayed batch writes it again. Parts that a merged part stands for are
    deleted after its record, and those of a crash in between by the next merge.
    """

    def __init__(self, spark: SparkSession, folder: str, compact: int = 16):
        self.spark, self.folder, self.compact = spark, folder, compact

    def update(self, records: DataFrame) -> None:
        """Take in what has arrived since the last call with this folder."""
        query = records.writeStream.option("checkpointLocation", f"{self.folder}/state").foreachBatch(self._save).trigger(availableNow=True).start()
        query.awaitTermination()

    def read(self) -> DataFrame:
        """All statuses; none where nothing has been written yet."""
        parts = [f"{self.folder}/{p}" for p in self._parts()]
        if not parts:
            return self.spark.createDataFrame([], "source string, version string, finished_at timestamp, outcome string, record_id long, failures long")
        return latest_status(self.spark.read.parquet(*parts))

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self) -> list[str]:
        fs, path = self._fs()
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _parts(self) -> list[str]:
        """The newest committed merged part and the committed batches after it."""
        names = self._names()
        done = {n.removesuffix(".done") for n in names if n.endswith(".done")}
        upto = max((n for n in done if n.startswith("upto=")), default="upto=")
        return sorted(n for n in done.intersection(names) if n == upto or n.startswith("batch=") and n[6:] > upto[5:])

    def _write(self, rows: DataFrame, name: str) -> None:
        """Data first, then the record that makes it count."""
        fs, path = self._fs()
        record = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{name}.done")
        fs.delete(record, False)
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        fs.create(record, True).close()

    def _save(self, batch: DataFrame, number: int) -> None:
        """A replayed batch that a merged part already stands for is done."""
        merged = [n.removesuffix(".done")[5:] for n in self._names() if n.startswith("upto=") and n.endswith(".done")]
        if not any(n >= f"{number:012d}" for n in merged):
            self._write(latest_status(batch), f"batch={number:012d}")
        if len(self._parts()) > self.compact:
            self._write(self.read(), f"upto={number:012d}")
            kept = set(self._parts())
            fs, path = self._fs()
            old = [n for n in self._names() if n.startswith(("batch=", "upto=")) and n.removesuffix(".done") not in kept]
            for name in sorted(old, key=lambda n: not n.endswith(".done")):
                fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name), True)
