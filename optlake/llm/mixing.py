"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Every source may give at most ``epochs`` times its words. All sources rise with a common
level times their weight; those at their cap are clamped and what they can't take goes to
the others in proportion to weight, until nothing changes. A round is one aggregate over
the table of sources and returns one row.

A source's rate (target / size) is a number of whole repetitions, which every document
gets, and a fraction, which a seeded part of the documents gets. Documents fall into
``bins`` by a hash of seed, id, source and size; bins are taken in order until the words
taken are nearest to the target, so a source misses its target by half a bin at most
(half a document where bins hold one). Equal rows share a bin; where the target falls into
it, of n equal rows as many are taken as its share of the bin asks for, which are numbered
in parts of the table with counts before each part, so no task gathers them. The bins of a source are pre-aggregated in every
task: however many rows a source has, no task gathers them.

Defined cases: null and empty texts have size 0 and are taken 0 words; a null source is a
source of its own; sources without a weight, or of weight 0, get target 0; ties, which are
equal rows, get equal decisions outside the bin of the target and are interchangeable in it;
very long texts count whole; an empty table gives an empty result; columns other than the
three named are not read and may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optlake.llm.common import numbered, stored, word_count


def cycled_weights(sources: DataFrame, cycle=(5, 2, 1)) -> DataFrame:
    """(source, weight): sources by code point, null last, weigh the cycle's values."""
    ranked = numbered(sources.select("source").distinct(), F.col("source").asc_nulls_last())
    values = F.array(*[F.lit(float(w)) for w in cycle])
    return ranked.select("source", F.get(values, (F.col("rank") % len(cycle)).cast("int")).alias("weight"))


def seeded_bin(doc_id: Column, source: Column, size: Column, seed: int, bins: int) -> Column:
    """A bin from 0 to ``bins`` - 1 by hash."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in (doc_id, source, size)])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % bins


def sized(docs: DataFrame, seed: int, bins: int, id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """(doc_id, source, size, bin) of every document."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return named.withColumn("bin", seeded_bin(F.col("doc_id"), F.col("source"), F.col("size"), seed, bins))


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which least(cap, weight * level) over (weight, cap) rows sums to
    ``total``; infinite where all caps together are not above it."""
    level, last = 0.0, None
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        row = sources.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(~over, F.col("weight")).otherwise(0.0)).alias("weights")).first()
        now = (row["caps"] or 0.0, row["weights"] or 0.0)
        if now[1] <= 0:
            return math.inf
        if now == last:
            return level
        level, last = (total - now[0]) / now[1], now


def mixing_plan(rows: DataFrame, weights: DataFrame | None = None, ratio: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, target, whole, cut, at, share) from the rows of ``sized``: every
    document is taken ``whole`` times, those in bins below ``cut`` once more. The target falls
    into bin ``at``, of which it takes ``share``."""
    bins = stored(rows.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    sources = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    weights = cycled_weights(sources) if weights is None else weights.select("source", F.col("weight").cast("double").alias("weight"))
    w = weights.withColumnRenamed("source", "_source")
    sources = stored(
        sources.join(w, F.col("source").eqNullSafe(F.col("_source")), "left")
        .select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"), (F.col("source_size") * float(epochs)).alias("cap"))
    )
    total = ratio * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(sources, total)
    share = F.col("cap") if math.isinf(level) else F.least(F.col("cap"), F.col("weight") * F.lit(level))
    target = F.when(F.col("weight") > 0, share).otherwise(0.0)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    sources = sources.select("source", "source_size", target.alias("target")).withColumn("whole", whole)
    sources = sources.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    filled = bins.withColumn("middle", F.sum("words").over(upto) - F.col("words") / 2)
    b = filled.withColumnRenamed("source", "_source")
    # a source at its cap takes no document once more, an empty one takes all once
    more = (F.col("extra") > 0) | (F.col("source_size") == 0)
    cut = F.coalesce(F.max(F.when(more & (F.col("middle") <= F.col("extra")), F.col("bin") + 1)), F.lit(0).cast("long"))
    joined = sources.join(b, F.col("source").eqNullSafe(F.col("_source")), "left")
    over = F.col("middle") + F.col("words") / 2 > F.col("extra")
    first = F.min(F.when(over, F.struct("bin", F.try_divide(F.col("extra") - (F.col("middle") - F.col("words") / 2), F.col("words")).alias("share"))))
    plan = joined.groupBy("source", "source_size", "target", "whole").agg(cut.alias("cut"), first.alias("first"))
    return stored(plan.select("*", F.col("first.bin").alias("at"), F.col("first.share").alias("share")).drop("first"))


def _copies() -> Column:
    return F.coalesce(F.col("whole"), F.lit(0)) + F.when(F.col("bin") < F.col("cut"), 1).otherwise(0)


def _with_copies(rows: DataFrame) -> DataFrame:
    """``rows (doc_id, source, size, bin)`` beside their source's plan, with ``copies``. Equal
    rows in the bin where the target falls are told apart by their number."""
    names = [*rows.columns, "copies"]
    keyed = rows.withColumn("_key", F.when(F.col("bin") == F.col("at"), F.to_json(F.struct("doc_id", "source", "size"))))
    equal = keyed.where("_key is not null").groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1")
    equal = stored(equal)
    if equal.isEmpty():
        return rows.withColumn("copies", _copies())
    told = keyed.join(equal, "_key", "left")
    single = told.where("_n is null").withColumn("copies", _copies())
    # stored with the part each row lies in, which no later run of a task can change
    tail = stored(told.where("_n is not null").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = tail.groupBy("_key", "_part").agg(F.count("*").alias("_m"))
    counts = counts.select("_key", "_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("size"))
    wanted = F.floor(F.col("_n") * F.col("share") + 0.5)
    tail = tail.join(counts, ["_key", "_part"]).withColumn("_number", F.col("_before") + number)
    tail = tail.withColumn("copies", F.coalesce("whole", F.lit(0)) + F.when(F.col("_number") <= wanted, 1).otherwise(0))
    return single.select(names).unionByName(tail.select(names))


def mix_sizes(docs: DataFrame, weights: DataFrame | None = None, ratio=1.5, epochs=2, seed=0, bins=4096, **columns) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    rows = stored(sized(docs, seed, bins, **columns))
    plan = mixing_plan(rows, weights, ratio, epochs).withColumnRenamed("source", "_source")
    joined = _with_copies(rows.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left"))
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: DataFrame | None = None, ratio=1.5, epochs=2, seed=0, bins=4096, id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.
    Texts are joined to the small plan and don't move."""
    columns = {"id_col": id_col, "source_col": source_col, "text_col": text_col}
    plan = mixing_plan(stored(sized(docs, seed, bins, **columns)), weights, ratio, epochs).withColumnRenamed("source", "_source")
    doc = docs.select(F.struct("*").alias("doc"))
    doc = doc.select("doc", F.col(f"doc.{id_col}").alias("doc_id"), F.col(f"doc.{source_col}").alias("source"), word_count(F.col(f"doc.{text_col}")).alias("size"))
    doc = doc.withColumn("bin", seeded_bin(F.col("doc_id"), F.col("source"), F.col("size"), seed, bins))
    joined = _with_copies(doc.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left"))
    taken = joined.select("doc", F.col("copies").cast("int").alias("copies")).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")
