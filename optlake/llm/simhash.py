"""SimHash near-duplicates, compared bit-sliced.

A fingerprint is the majority of the bits of the XXH64 hashes of a text's word shingles.
Equal fingerprints become one node. Two fingerprints within ``radius`` bits agree on all
but ``radius`` of any ``blocks`` blocks of bits, so each node goes into one bucket for each
choice of ``blocks - radius`` blocks; more nodes take more blocks, which keeps random
buckets small at any size without losing a pair. Buckets of more than ``TILE`` nodes are
counted beforehand and dealt out as pairs of tiles, so no task holds a hot bucket.

Inside a bucket the fingerprints stand vertically: plane b holds bit b of 64 neighbours in
one machine word. A query's distances to 64 fingerprints grow plane by plane in bitwise
counters with carry-save additions; words in which every lane is beyond the radius are
abandoned. Hits are joined to a forest in the task, and only its edges leave it, so a group
of copies costs one row for each member and never all pairs.

Defined cases: null and empty texts, and texts of blanks, have fingerprint zero and link
like any other; a text of fewer words than the shingle is one shingle; null ids are
ignored when a component's smallest id is taken (null if it has no other); repeated rows
give repeated rows; an empty table gives an empty result; a bit set in just half
the hashes is 0; very long texts count whole; columns not named are not read and may have any name.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optlake.llm.common import stored
from optlake.llm.components import components

TILE = 4096
#: Rows compared at once, and words of 64 lanes in one step.
ROWS, STEP = 100_000, 32_768


def simhash(text: bytes | None, width: int) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: -width]] if len(words) > width else [0]
    stops = ends[width - 1 :] if len(words) > width else ends[-1:]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65_536):
        hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts[at : at + 65_536], stops[at : at + 65_536])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", width: int = 4, keep: bool = False) -> DataFrame:
    """(doc_id, fp) of every document; with ``keep``, (doc, fp), doc being the whole row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            fps = np.fromiter((simhash(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(fps.view(np.int64))], names=[batch.schema.names[1], "fp"])

    name, what = ("doc", F.struct("*")) if keep else ("doc_id", F.col(id_col))
    rows = docs.select(F.col(text_col).alias("_text"), what.alias(name))
    return rows.mapInArrow(run, T.StructType([rows.schema[1], T.StructField("fp", T.LongType())]))


def block_masks(n: int, radius: int) -> list[int]:
    """One mask for each choice of blocks that may agree; more and smaller choices as the
    number of fingerprints grows, so that 64 random ones meet in a bucket at most."""
    blocks = radius + 1
    while n / 2 ** (64 * (blocks - radius) / blocks) > 64 and blocks < 2 * radius + 4:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _beyond(counters: list, over, radius: int):
    """Lanes whose count is above ``radius``: the comparison, from the highest bit down."""
    more, equal = over.copy(), ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            more |= equal & counters[k]
            equal &= ~counters[k]
    return more


def close_pairs(fps: np.ndarray, last: np.ndarray, radius: int):
    """Yields (i, j) arrays of rows i < j < last[i] within ``radius`` bits."""
    n, ones = len(fps), np.uint64(0xFFFFFFFFFFFFFFFF)
    wide = np.zeros(-(-n // 64) * 64, np.uint64)
    wide[:n] = fps
    bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    row = np.arange(n)
    row = row[last > row + 1]
    first_word, last_word = (row + 1) // 64, (last[row] - 1) // 64
    spans = last_word - first_word + 1
    ends = np.cumsum(spans)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, STEP):
        pair = np.arange(at, min(total, at + STEP))
        k = np.searchsorted(ends, pair, "right")
        q, w = row[k], first_word[k] + pair - (ends[k] - spans[k])
        alive = np.full(len(q), ones)
        head, tail = w == first_word[k], w == last_word[k]
        alive[head] &= ones << ((q[head] + 1) % 64).astype(np.uint64)
        alive[tail] &= ones >> (63 - (last[q[tail]] - 1) % 64).astype(np.uint64)
        counters = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
        over, value = np.zeros(len(q), np.uint64), fps[q]
        for b in range(64):
            carry = planes[b][w] ^ (np.uint64(0) - (value >> np.uint64(b) & np.uint64(1)))
            for c in counters:
                up = c & carry
                c ^= carry
                carry = up
            over |= carry
            if b % 8 == 7:
                alive &= ~_beyond(counters, over, radius)
                left = np.flatnonzero(alive)
                if not len(left):
                    break
                if 2 * len(left) < len(alive):
                    q, w, alive, over, value = q[left], w[left], alive[left], over[left], value[left]
                    counters = [c[left] for c in counters]
        if alive.any():
            lanes = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            hit, lane = np.nonzero(lanes)
            yield q[hit], w[hit] * 64 + lane


def _join(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The forest ``roots`` with the trees of i and j joined, every node at its root."""
    while True:
        a, b = roots[i], roots[j]
        apart = a != b
        if not apart.any():
            return roots
        i, j = i[apart], j[apart]
        np.minimum.at(roots, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while not np.array_equal(up := roots[roots], roots):
            roots = up


def _linked(fps: np.ndarray, buckets: np.ndarray, radius: int) -> pa.RecordBatch:
    """The edges of a forest over rows that are sorted by bucket."""
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    last = np.repeat(np.r_[starts[1:], len(fps)], np.diff(np.r_[starts, len(fps)]))
    roots = np.arange(len(fps))
    for i, j in close_pairs(fps, last, radius):
        roots = _join(roots, i, j)
    child = np.flatnonzero((roots != np.arange(len(fps))) & (fps != fps[roots]))
    signed = fps.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[roots[child]])], names=["src", "dst"])


def close_links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(src, dst) edges over distinct fingerprints ``fp`` whose components are those of
    all pairs within ``radius`` bits."""
    masks = block_masks(nodes.count(), radius)
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    big = stored(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > TILE))
    rows = rows.join(big, "bucket", "left").withColumn("tiles", F.coalesce(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tile = F.when(F.col("tiles") > 1, F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("bucket"))
    rows = rows.select("fp", tile.alias("bucket"))

    def run(batches):
        held = []
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            if sum(len(h[0]) for h in held) >= ROWS:
                fps, buckets = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(buckets, buckets[-1], "left"))
                if cut:
                    yield _linked(fps[:cut], buckets[:cut], radius)
                held = [(fps[cut:], buckets[cut:])]
        if held:
            yield _linked(*(np.concatenate(x) for x in zip(*held)), radius)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "src long, dst long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _labelled(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of (doc_id, fp) rows."""
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = stored(components(close_links(nodes.select("fp"), radius)))
    firsts = roots.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("least"))
    least = roots.join(firsts, "root").select(F.col("node").alias("fp"), "root", "least")
    named = nodes.join(least, "fp", "left")
    return stored(named.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id")))


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    marked = stored(fingerprints(docs, id_col, text_col, width))
    return marked.join(_labelled(marked, radius), "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, id_col="doc_id", text_col="text") -> DataFrame:
    """One row of each component, with the columns of ``docs``: of the rows with its
    smallest id (with no id, where none has one) one with the smallest fingerprint."""
    wide = stored(fingerprints(docs, id_col, text_col, width, keep=True))
    named = wide.withColumn("doc_id", F.col(f"doc.`{id_col}`"))
    first = named.select("doc_id", "fp").join(_labelled(named.select("doc_id", "fp"), radius), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    counted = first.groupBy("root", "fp", "component_id").agg(F.count("*").alias("n"))
    best = stored(counted.groupBy("root").agg(F.min(F.struct("fp", "component_id", "n")).alias("best")).select("best.*"))
    kept = named.join(best.withColumnRenamed("fp", "_fp"), (F.col("fp") == F.col("_fp")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    if best.where("n > 1").isEmpty():
        return kept.select("doc.*")
    repeated = kept.where("n > 1").dropDuplicates(["fp"])
    return kept.where("n = 1").select("doc.*").unionAll(repeated.select("doc.*"))
