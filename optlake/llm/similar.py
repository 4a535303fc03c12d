"""Near-duplicate texts by SimHash, decided by exact similarity.

Texts of one set of word shingles (``width`` words, A-Z lower-cased) are one node. SimHash
at similarity 0.8 differs in some ten of 64 bits, too many for buckets of equal bits, so
nodes meet in buckets of ``BANDS`` bands of ``PER_BAND`` shingle minima (a pair of
similarity 0.8 shares one with a chance of 99.7%). Inside a bucket the fingerprints are
compared bit-sliced, as in ``simhash``, with a radius (18 bits) that a pair of similarity
0.8 exceeds once in a thousand times. Only nodes with a close partner go on: their shingle
sets join them, and exact Jaccard similarity decides close pairs, nearest first, leaving
out those that are joined already. Only the edges of a forest leave the task.

The first two bands are decided first; the others only where a bucket holds nodes not
joined yet.
Buckets of more than ``TILE`` nodes are counted beforehand and dealt out as pairs of tiles.
A task holds the shingle sets of two tiles at most.

Defined cases: null and empty texts and texts of blanks are one node and link to nothing
else; a text of fewer words than a shingle is one shingle; very long texts are read whole,
in pieces; of a component the row with the smallest id stays, null ids last, then the
smallest node; repeated rows leave one; columns of any name are carried along; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optlake.llm.common import stored
from optlake.llm.components import components
from optlake.llm.simhash import TILE, close_pairs

BANDS, PER_BAND, RADIUS = 8, 3, 18
#: Hashes handled at once, and rows of buckets compared at once.
PIECE, ROWS = 65_536, 8_192
ORDERS = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(BANDS * PER_BAND)], np.uint64)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-width]] if len(words) > width else [0]
    stops = ends[width - 1 :] if len(words) > width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts, stops)), np.uint64, len(starts))


def sketch(text: bytes | None, width: int) -> tuple[str, int, list[int]]:
    """Node, fingerprint and bucket keys of a text."""
    hashes = shingle_hashes(text, width)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        counts += np.unpackbits(hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    fp = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0]
    unique = np.unique(hashes)
    least = np.full(len(ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(unique), PIECE):
        least = np.minimum(least, (unique[at : at + PIECE, None] * ORDERS).min(0))
    keys = [xxhash.xxh64_intdigest(least[b * PER_BAND : (b + 1) * PER_BAND].tobytes(), b) - 2**63 for b in range(BANDS)]
    return xxhash.xxh3_128_hexdigest(unique.tobytes()), int(fp), keys


def _sketched(docs: DataFrame, width: int, text_col: str) -> DataFrame:
    """(doc, node, fp, keys), doc being the whole row."""

    def run(batches):
        for batch in batches:
            found = [sketch(t.as_py(), width) for t in batch.column(0).cast(pa.binary())]
            node, fp, keys = zip(*found) if found else ((), (), ())
            arrays = [pa.array(node, pa.string()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *arrays], names=["doc", "node", "fp", "keys"])

    rows = docs.select(F.col(text_col).alias("_text"), F.struct("*").alias("doc"))
    more = T._parse_datatype_string("node string, fp long, keys array<long>")
    return rows.mapInArrow(run, T.StructType([rows.schema[1], *more.fields]))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of (node, text): the different hashes in order."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                unique = np.unique(shingle_hashes(batch.column(1)[i].cast(pa.binary()).as_py(), width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([unique.view(np.int64)], pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node string, shingles array<long>")


def _whole_buckets(batches):
    """Tables of about ``ROWS`` rows that hold whole buckets; rows are sorted by bucket."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            rows = pa.Table.from_batches(held)
            buckets = rows["bucket"].to_numpy()
            cut = int(np.searchsorted(buckets, buckets[-1], "left"))
            if cut:
                yield rows.slice(0, cut)
            held, n = rows.slice(cut).to_batches(), len(rows) - cut
    if n:
        yield pa.Table.from_batches(held)


def _close(rows: pa.Table, radius: int):
    """Yields (i, j) arrays of close rows of one bucket."""
    buckets = rows["bucket"].to_numpy()
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    last = np.repeat(np.r_[starts[1:], len(buckets)], np.diff(np.r_[starts, len(buckets)]))
    return close_pairs(rows["fp"].to_numpy().view(np.uint64), last, radius)


def _roots(rows: pa.Table) -> np.ndarray:
    """For each row the first one of its component."""
    _, first, inverse = np.unique(rows["root"].to_numpy(), return_index=True, return_inverse=True)
    return first[inverse]


def _partnered(radius: int):
    def run(batches):
        for rows in _whole_buckets(batches):
            found = np.zeros(len(rows), bool)
            for i, j in _close(rows, radius):
                found[i] = found[j] = True
            yield from rows.filter(pa.array(found)).to_batches()

    return run


def _decided(radius: int, similarity: float):
    def run(batches):
        for rows in _whole_buckets(batches):
            root, fps = _roots(rows), rows["fp"].to_numpy().view(np.uint64)
            sets = [s.values.to_numpy() for s in rows["shingles"]]
            size = np.array([len(s) for s in sets])
            src, dst = [], []
            for i, j in _close(rows, radius):
                # sets of too different sizes can't be similar
                fits = (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
                i, j = i[fits], j[fits]
                order = np.argsort(np.bitwise_count(fps[i] ^ fps[j]), kind="stable")
                i, j = i[order], j[order]
                while len(i):
                    for k in range(min(len(i), 512)):
                        a, b = int(i[k]), int(j[k])
                        if root[a] == root[b]:
                            continue
                        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if common >= similarity * (size[a] + size[b] - common):
                            src.append(a)
                            dst.append(b)
                            root[root == root[b]] = root[a]
                    i, j = i[512:], j[512:]
                    apart = root[i] != root[j]
                    i, j = i[apart], j[apart]
            node = rows["node"].combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(src, pa.int64())), node.take(pa.array(dst, pa.int64()))], names=["src", "dst"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Buckets of several nodes, the large ones as pairs of tiles."""
    sized = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sized.select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "bucket")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tile = F.when(F.col("tiles") > 1, F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("bucket"))
    return rows.select("node", "fp", "band", tile.alias("bucket"))


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def similar_nodes(sketched: DataFrame, width: int, similarity: float, radius: int, text_col: str) -> DataFrame:
    """(node, root) of every node that is similar to another."""
    nodes = stored(sketched.dropDuplicates(["node"]).select("node", "fp", "keys"))
    rows = nodes.select("node", "fp", F.posexplode("keys").alias("band", "bucket"))
    close = stored(_by_bucket(_dealt(rows)).mapInArrow(_partnered(radius), "node string, fp long, band int, bucket long"))
    # texts move once, for all bands
    needed = sketched.join(close.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first(F.col(f"doc.`{text_col}`")).alias("text"))
    sets = stored(_sets(needed, width))
    edges = stored(_by_bucket(close.where("band < 2").withColumn("root", F.col("node")).join(sets, "node")).mapInArrow(_decided(radius, similarity), "src string, dst string"))
    roots = stored(components(edges))
    rest = close.where("band >= 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rest.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    rest = rest.join(apart, "bucket", "left_semi").join(sets, "node")
    more = stored(_by_bucket(rest).mapInArrow(_decided(radius, similarity), "src string, dst string"))
    return stored(components(edges.unionAll(more)))


def drop_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = RADIUS, id_col="doc_id", text_col="text") -> DataFrame:
    """One row of each component of similar texts, with the columns of ``docs``."""
    sketched = stored(_sketched(docs, width, text_col))
    roots = similar_nodes(sketched, width, similarity, radius, text_col)
    named = sketched.select("node", F.col(f"doc.`{id_col}`").alias("id"))
    counted = named.groupBy("node", "id").agg(F.count("*").alias("n")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = counted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "node", "n")).alias("best"))
    best = stored(best.select(F.col("best.node").alias("_node"), F.col("best.id").alias("_id"), F.col("best.n").alias("n")))
    rows = sketched.select("doc", "node").join(best, (F.col("node") == F.col("_node")) & F.col(f"doc.`{id_col}`").eqNullSafe(F.col("_id")))
    if best.where("n > 1").isEmpty():
        return rows.select("doc.*")
    return rows.where("n = 1").select("doc.*").unionAll(rows.where("n > 1").dropDuplicates(["node"]).select("doc.*"))
