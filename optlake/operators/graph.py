"""Graph loops over edge tables. Each round is a few joins over the frontier; what is
left is written to the shared folder, so plans stay short and lost executors do not
restart the loop."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optlake.session import Rounds, cut_lineage, run_folder

#: Folders of a table that a loop reads and rewrites in part.
BUCKETS = 64


def _buckets(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


class _Parts:
    """A table in ``BUCKETS`` folders by a hash of its ``key``. A rewritten bucket gets a new
    folder, so a step reads and writes only the buckets it names."""

    def __init__(self, rows: DataFrame, key: str):
        self.spark, self.key, self.schema, self.at = rows.sparkSession, key, rows.schema, {}
        self.put(rows, range(BUCKETS))

    def put(self, rows: DataFrame, buckets) -> None:
        path = f"{run_folder(self.spark)}/{uuid.uuid4().hex}"
        # a hot key is dealt out by its whole row
        rows = rows.withColumn("bucket", _buckets(self.key))
        rows.repartition("bucket", F.pmod(F.xxhash64(*self.schema.names), F.lit(8))).write.partitionBy("bucket").parquet(path)
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
        names = {f.getPath().getName() for f in files}
        self.at |= {b: f"{path}/bucket={b}" if f"bucket={b}" in names else None for b in buckets}

    def get(self, buckets=None) -> DataFrame:
        paths = [self.at[b] for b in (self.at if buckets is None else buckets) if self.at[b]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


def _named(rows: DataFrame, column: str) -> list[int]:
    """The buckets of a column's values: at most ``BUCKETS`` numbers."""
    return [r[0] for r in rows.select(_buckets(column)).distinct().collect()]


def build_waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Wave of each node, dependencies ``(src, dst)`` before dependents.

    A wave takes every node with the fewest open dependencies: none in the ordinary case;
    when all wait on each other, those are forced and marked ``in_cycle``. Each node has a
    counter of open dependencies, null once it is placed by force. A wave reads the edges
    into what the last one placed, lowers the counters at their other ends and takes those
    that became zero; only the buckets of these edges and counters are read and rewritten.
    All counters are read at the start and when a wave has to be forced. Repeated rows and
    null nodes count once; a dependency that is no node stays open.
    """
    pairs = edges.select("src", "dst").distinct()
    counts = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    names = nodes.select("name").distinct()
    into = _Parts(pairs, "dst")
    counters = _Parts(names.join(counts, F.col("name").eqNullSafe(F.col("src")), "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("open")), "name")
    found = Rounds(names.sparkSession, f"name {dict(names.dtypes)['name']}, in_cycle boolean")
    wave, ready, force = 0, counters.get().where("open = 0"), False
    while True:
        ready = cut_lineage(ready.select("name"))
        if ready.isEmpty():
            left = counters.get().where("open > 0")
            fewest = left.agg(F.min("open")).first()[0]
            if fewest is None:
                return found.read("wave")
            ready, force = cut_lineage(left.where(F.col("open") == fewest).select("name")), True
            counters.put(counters.get().withColumn("open", F.when(F.col("open") != fewest, F.col("open"))), range(BUCKETS))
        found.add(wave, ready.withColumn("in_cycle", F.lit(force)))
        closed = into.get(_named(ready, "name")).join(ready.withColumnRenamed("name", "dst"), "dst", "left_semi")
        closed = cut_lineage(closed.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
        touched = _named(closed, "src")
        now = counters.get(touched).join(closed, F.col("name").eqNullSafe(F.col("src")), "left")
        now = cut_lineage(now.select("name", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.col("n").isNotNull().alias("fell")))
        counters.put(now.select("name", "open"), touched)
        ready, force, wave = now.where("fell AND open = 0"), False, wave + 1


def reach(seeds: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Everything reachable from ``seeds (name)`` along ``edges (src, dst)``.

    ``rounds`` bounds the number of steps; without it the closure is complete. Each round
    writes only what it found; what is known is read from the rounds together.
    """
    front, step = cut_lineage(seeds.select("name").distinct()), 0
    found = Rounds(front.sparkSession, f"name {dict(front.dtypes)['name']}")
    found.add(0, front)
    while rounds is None or step < rounds:
        step += 1
        found.add(step, edges.join(front.withColumnRenamed("name", "src"), "src", "left_semi").select(F.col("dst").alias("name")).distinct().join(found.read("step"), "name", "left_anti"))
        front = found.read("step").where(F.col("step") == step).select("name")
        if front.isEmpty():
            break
    return found.read("step").select("name")


def dependency_cone(seeds: DataFrame, relations: DataFrame, follow_selects: bool = False) -> DataFrame:
    """Options a set of options can depend on through ``relations (src, dst, rel)``."""
    kinds = ["depends", "prompt", "default", "choice"] + (["selected_by"] if follow_selects else [])
    return reach(seeds, relations.where(F.col("rel").isin(*kinds)))


def expand_composites(roots: DataFrame, members: DataFrame) -> DataFrame:
    """Containers unfolded to members at any depth: ``(root, name, holds)`` where ``holds``
    is the conjunction of the verdicts along the way. A member reached twice holds if any
    way holds; a step only follows rows that changed, so cyclic containers end."""
    known = cut_lineage(roots.select(F.col("name").alias("root"), "name", "holds"))
    front = known
    while True:
        step = (
            front.join(members.select(F.col("container").alias("name"), "member", F.col("holds").alias("m")), "name")
            .groupBy("root", F.col("member").alias("name")).agg(F.bool_or(F.col("holds") & F.col("m")).alias("holds"))
        )
        fresh = cut_lineage(step.join(known.withColumnRenamed("holds", "was"), ["root", "name"], "left").where("was IS NULL OR (holds AND NOT was)").select("root", "name", "holds"))
        if fresh.isEmpty():
            return known
        kept = known.join(fresh.select("root", "name"), ["root", "name"], "left_anti")
        known, front = cut_lineage(kept.unionByName(fresh)), fresh


def reverse_relations(edges: DataFrame) -> DataFrame:
    """Who selects and who implies each option, as sorted lists."""
    by = lambda rel: F.array_join(F.array_sort(F.collect_set(F.when(F.col("rel") == rel, F.col("src")))), " ")
    return edges.where("rel IN ('select', 'imply')").groupBy(F.col("dst").alias("symbol")).agg(by("select").alias("selected_by"), by("imply").alias("implied_by"))
