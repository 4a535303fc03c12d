"""Views derived from the given tables and the query registry.

A view is one SQL text that Spark and DuckDB both run (two texts where the dialects
differ), so a query and its check start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from optlake.session import cut_lineage, stored_by

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

KEPT: dict[str, str | None] = {}
_STORED: dict[tuple, object] = {}
VIEWS: dict[str, tuple[str, str]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def view(name: str, sql: str, duck: str | None = None, keep: bool = False, by: str | None = None) -> None:
    """``keep`` stores the view once; ``by`` stores it in buckets of that column."""
    if keep or by:
        KEPT[name] = by
    VIEWS[name] = (sql.strip(), (duck or sql).strip())


def _ordered(sql: str, dialect: int, seen: dict[str, str], skip=()) -> None:
    for name in re.findall(r"\bv_\w+", sql):
        if name in VIEWS and name not in seen and name not in skip:
            body = VIEWS[name][dialect]
            _ordered(body, dialect, seen, skip)
            seen.setdefault(name, body)


def with_views(sql: str, dialect: int, skip=()) -> str:
    """``sql`` with the views it names put in front as common table expressions."""
    sql = sql.strip()
    needed: dict[str, str] = {}
    _ordered(sql, dialect, needed, skip)
    ctes = ", ".join(f"{n} AS ({b})" for n, b in needed.items())
    head = re.match(r"(?i)with\s+(recursive\s+)?", sql)
    if head:
        ctes = ", ".join(filter(None, [ctes, sql[head.end():]]))
        return ("WITH RECURSIVE " if head.group(1) else "WITH ") + ctes
    return f"WITH {ctes} {sql}" if ctes else sql


class Inputs:
    """Loads the given tables and the derived views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._version = None

    def version(self) -> tuple:
        """Names, times and sizes of what lies in the folder; one listing."""
        if self._version is None:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
            files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
            self._version = tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in files))
        return self._version

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, sql: str) -> DataFrame:
        text = with_views(sql, 0, KEPT)
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        kept = {n: self.stored(n) for n in sorted(KEPT.keys() & set(re.findall(r"\bv_\w+", text)))}
        for name, df in kept.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __call__(self, name: str) -> DataFrame:
        name = f"v_{name}"
        return self.stored(name) if name in KEPT else self.sql(f"SELECT * FROM {name}")

    def stored(self, name: str) -> DataFrame:
        by = KEPT[name]
        store = (lambda rows: stored_by(rows, by)) if by else cut_lineage
        return self.once(name, lambda: store(self.sql(VIEWS[name][0])))

    def once(self, name: str, make: Callable[[], object]):
        """``make()`` once per session and state of the folder: inputs that a deployment
        keeps as stored tables are written once and read by every query; when the folder
        has changed, they are made anew."""
        key = (self.spark.sparkContext.applicationId, self.folder, self.version(), name)
        if key not in _STORED:
            _STORED[key] = make()
        return _STORED[key]


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name`` with its checking SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
