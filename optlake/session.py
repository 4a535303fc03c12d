"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_TABLES: dict[str, list[str]] = {}


def get_spark(app: str = "optlake", cpus: str | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster bring your own session."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("OPTLAKE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only in local mode, where
    driver and executors are one process, a session without it (as in tests) gets a
    temporary folder, which is removed when the process ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if spark.sparkContext.applicationId not in _FOLDERS:
        _FOLDERS[spark.sparkContext.applicationId] = folder = tempfile.mkdtemp(prefix="optlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _FOLDERS[spark.sparkContext.applicationId]


def run_folder(spark: SparkSession) -> str:
    """What this application writes; ``release`` removes it."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application from the shared folder."""
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _writing(spark: SparkSession, **more: str) -> Iterator[None]:
    """While a table is written: what its plan has shuffled goes as soon as it is written, not
    when the driver happens to collect its garbage. ``more`` are further settings."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | more
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: a loop's
    plan stays short, the result outlives any executor, and later plans see its size."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    with _writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of stored tables that nothing reads any more."""
    for df in tables:
        spark, own = df.sparkSession, run_folder(df.sparkSession).removeprefix("file:").replace("//", "/")
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if own in folder.replace("//", "/"):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Heap:
    """A table that a loop appends to, in one bucket of ``key`` for each shuffle partition of
    the session: joins and groupings of such tables whose keys include ``key`` move no rows.

    For that the session no longer asks for all keys of a join in how its sides lie, and reads
    buckets as such; rows of one ``key`` are sorted and joined by one task, which spills what
    it can't hold. A task writes few buckets, so it keeps their files open instead of sorting.

    Rows of a few ids and repeated words are many times their files; the session takes files
    for ``FACTOR`` times their size, so that it doesn't broadcast what the driver can't hold."""

    WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
    FACTOR = "8"

    def __init__(self, spark: SparkSession, key: str):
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        spark.conf.set("spark.sql.sources.fileCompressionFactor", self.FACTOR)
        self.spark, self.key, self.name = spark, key, f"optlake_{uuid.uuid4().hex}"
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        _TABLES.setdefault(spark.sparkContext.applicationId, []).append(self.name)

    def add(self, rows: DataFrame, dealt: bool = False, **options: str) -> None:
        """``dealt``: the rows lie by ``key`` already, as after a grouping by it."""
        path = f"{run_folder(self.spark)}/{self.name}"
        rows = rows if dealt else rows.repartition(self.parts, self.key)
        writer = rows.write.format("parquet").options(**options).bucketBy(self.parts, self.key)
        with _writing(self.spark, **{self.WRITERS: "8"}):
            writer.option("path", path).mode("append").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)


def stored_by(df: DataFrame, key: str, dealt: bool = False, **options: str) -> DataFrame:
    """Like ``cut_lineage``, in buckets of ``key`` (see ``Heap``)."""
    heap = Heap(df.sparkSession, key)
    heap.add(df, dealt, **options)
    return heap.read()


class Rounds:
    """A table that a loop appends to, one partition for each round, so that its plan has
    the same size after any number of rounds."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema = spark, schema
        self.path, self.last = f"{run_folder(spark)}/{uuid.uuid4().hex}", -1

    def add(self, number: int, rows: DataFrame) -> None:
        with _writing(self.spark):
            rows.write.parquet(f"{self.path}/round={number}")
        self.last = number

    def read(self, name: str) -> DataFrame:
        """All rounds, with the number of each as column ``name``."""
        if self.last < 0:
            return self.spark.createDataFrame([], f"{self.schema}, {name} int")
        rows = self.spark.read.schema(f"{self.schema}, round int").option("basePath", self.path).parquet(self.path)
        return rows.withColumnRenamed("round", name)
