"""Sharding by sampled splitters.

The key of a record is (hash of its text, hash of its id). A seeded sample, in which a
record counts by its size, gives quantile boundaries that cut the key space into many
ranges of about equal bytes. Exact bytes per range are counted; ranges that came out
overfull are sampled again and subdivided until each is small or holds one key. Adjacent
ranges then fill the shards in order, so a shard misses the mean by about half a range.

Copies of a text share the first part of the key: boundaries fall between texts, and only
a text whose copies outweigh a range is cut, by id. The numbering within a shard is a sort
per range plus the exact counts of the ranges before it; no task sees a whole shard.

The sample and the ranges are bounded by parameters (``ranges`` and ``picks`` for each
range), so what the driver holds does not grow with the input.

Defined cases: a null text has size 1 and CRC 0; rows with equal id and text are
interchangeable and get different slots; null ids are allowed; an empty table gives an
empty result; a very long text is one row and never cut. Columns other than id and text may
have any name and are carried only by ``shard_documents``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optlake.llm.common import stored

LOW = -(2**63)


def _keyed(docs: DataFrame, id_col: str, text_col: str, extra=()) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.xxhash64(F.col(id_col), F.lit(1)).alias("tie"),
        *extra,
    )


def _boundaries(rows: list, ranges: int) -> list[tuple[int, int]]:
    """Quantile boundaries of (key, tie, weight) rows; between two texts where possible,
    and on both sides of a row that fills half a range by itself."""
    rows = sorted((r["key"], r["tie"], r["weight"]) for r in rows)
    total, upto, cuts, heavy = sum(r[2] for r in rows), 0.0, [], False
    for key, tie, weight in rows:
        crosses = int(upto * ranges / total) != int((upto + weight) * ranges / total)
        if crosses or heavy or not cuts:
            cuts.append((key, tie))
        upto, heavy = upto + weight, 2 * weight * ranges >= total
    texts = {}
    for key, tie in cuts:
        texts.setdefault(key, []).append(tie)
    return [(key, LOW) for key in texts] + [(key, tie) for key, ties in texts.items() for tie in ties[1:]]


def _ranged(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with ``range``: the number of boundaries not above the key."""
    keys, ties = (np.array([c[i] for c in cuts], dtype=np.int64) for i in (0, 1))

    def run(batches):
        for batch in batches:
            key, tie = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("key", "tie"))
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            at = low.copy()
            for first in np.unique(low[high > low]):
                same = (low == first) & (high > low)
                at[same] = first + np.searchsorted(ties[first : high[same][0]], tie[same], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "range"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType())]))


def splitters(rows: DataFrame, ranges: int, picks: int, seed: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Boundaries, and (range, bytes, rows) of the ranges between them, from (key, tie,
    size) rows."""
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return [], []

    def sample(df, rate, *more):
        chance = F.col("size") * F.lit(rate)
        draw = F.xxhash64("key", "tie", F.lit(seed)).bitwiseAND(2**30 - 1) / float(2**30)
        return df.where(draw < chance).select("key", "tie", F.greatest(chance, F.lit(1.0)).alias("weight"), *more).collect()

    fair, rate = total / ranges, picks * ranges / total
    cuts = set(_boundaries(sample(rows, rate), ranges))
    while True:
        order = sorted(cuts)
        ranged = _ranged(rows, order)
        extent = [f(c).alias(f"{f.__name__}_{c}") for c in ("key", "tie") for f in (F.min, F.max)]
        counted = sorted(map(tuple, ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *extent).collect()))
        over = {r[0]: r[1] for r in counted if r[1] > 1.5 * fair and (r[3] != r[4] or r[5] != r[6])}
        rate *= 16
        found: dict[int, list] = {}
        for r in sample(ranged.where(F.col("range").isin(list(over))), rate, "range") if over else []:
            found.setdefault(r["range"], []).append(r)
        for at, part in found.items():
            cuts |= set(_boundaries(part, 1 + int(over[at] / fair)))
        if len(cuts) == len(order) and (not over or rate >= 1):
            return order, [r[:3] for r in counted]


def _placed(rows: DataFrame, cuts, counted, shards: int) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``."""
    total, upto, inside, table = sum(c[1] for c in counted), 0, [0] * shards, []
    for at, size, n in counted:
        shard = min(shards - 1, int((upto + size / 2) * shards / total))
        table.append((at, shard, inside[shard]))
        upto, inside[shard] = upto + size, inside[shard] + n
    places = rows.sparkSession.createDataFrame(table, "range int, shard int, before long")
    order = Window.partitionBy("range").orderBy("key", "tie", "doc_id", "text_crc32", "size")
    numbered = _ranged(rows, cuts).withColumn("at", F.row_number().over(order))
    # bounded: one row for each range
    return numbered.join(F.broadcast(places), "range").withColumn("slot", (F.col("before") + F.col("at") - 1).cast("long"))


def shard_sizes(docs: DataFrame, shards: int = 8, ranges: int = 4096, picks: int = 8, seed: int = 0, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document: shards
    of near equal bytes, slots from 0 without gaps."""
    rows = stored(_keyed(docs, id_col, text_col))
    placed = _placed(rows, *splitters(rows, ranges, picks, seed), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = 8, ranges: int = 4096, picks: int = 8, seed: int = 0, id_col="doc_id", text_col="text") -> DataFrame:
    """The columns of ``docs`` (those named like the added ones are replaced) with size,
    text_crc32, law, shard, slot and grown_shard; records move once, to their range."""
    rows = stored(_keyed(docs, id_col, text_col))
    wide = _keyed(docs, id_col, text_col, [F.struct("*").alias("doc")])
    placed = _placed(wide, *splitters(rows, ranges, picks, seed), shards)
    added = {"size": F.col("size"), "text_crc32": F.col("text_crc32"), "law": F.lit("bytes"), "shard": F.col("shard"), "slot": F.col("slot"), "grown_shard": F.lit(None).cast("int")}
    kept = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in added]
    return placed.select(*kept, *[c.alias(n) for n, c in added.items()])
