"""Benchmark decontamination by Wu-Manber search over words.

The patterns are all windows of ``width`` consecutive words of the benchmark items, and
whole items that are shorter. For each pattern length a shift table tells, for a block of
two words, how far the search may jump before that block can stand at a window's place:
most blocks occur in no window, so most positions of a text are never looked at. A shift of
zero leads to the bucket of windows that end in this block; only those are compared word
by word. Every occurrence marks its words and its items.

Windows go to the tasks in blocks of at most ``block`` windows (a documented bound on what
is broadcast); all documents are searched for each block and the hits of a text are joined.
The usual benchmark is one block, searched in one pass without a shuffle.

Defined cases: null and empty texts have no words and are clean; items without words are no
pattern; equal item ids are one item, null ids one item written as an empty string;
repeated rows give repeated rows; empty tables give clean or no rows; very long texts are
searched whole; windows that overlap or are equal hit a word once; other columns may have any
name.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optlake.llm.common import fold, stored

#: Fixed value: what separates words, as a byte pattern.
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Searcher:
    """Wu-Manber tables over windows of one length each."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        """``windows``: (space-joined words, item ids)."""
        lengths: dict[int, list] = {}
        for text, items in windows:
            words = tuple(text.encode().split(b" "))
            lengths.setdefault(len(words), []).append((words, items))
        self.tables = []
        for m, patterns in lengths.items():
            block = min(2, m)
            shift: dict = {}
            buckets: dict = {}
            for words, items in patterns:
                for end in range(block, m + 1):
                    key = words[end - block : end]
                    shift[key] = min(shift.get(key, m), m - end)
                buckets.setdefault(words[m - block :], {}).setdefault(words, set()).update(items)
            self.tables.append((m, block, shift, m - block + 1, buckets))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans of the words inside occurrences, and the items that occur."""
        found, items = [], set()
        n = len(words)
        for m, block, shift, most, buckets in self.tables:
            end = m
            while end <= n:
                key = tuple(words[end - block : end])
                step = shift.get(key, most)
                if step:
                    end += step
                    continue
                named = buckets[key].get(tuple(words[end - m : end]))
                if named is not None:
                    found.append((end - m, end))
                    items |= named
                end += 1
        spans: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        return spans, items


def words_of(text: bytes | None) -> list[bytes]:
    return re.findall(WORD, text.lower()) if text else []


def windows(benchmark: DataFrame, width: int, item_col="item_id", text_col="text") -> DataFrame:
    """(window, items): the distinct windows of the items with the items they stand in."""
    words = F.filter(F.split(fold(F.col(text_col)), SEPARATOR), lambda w: w != "")
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words.alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, width), " "))).alias("window"))
    return rows.groupBy("window").agg(F.collect_set("item").alias("items"))


def _blocks(benchmark: DataFrame, width: int, block: int, **columns):
    """Broadcasts of at most about ``block`` windows."""
    table = stored(windows(benchmark, width, **columns))
    parts = max(1, -(-table.count() // block))
    for part in range(parts):
        rows = table.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part).collect()
        yield parts, benchmark.sparkSession.sparkContext.broadcast([(r["window"], r["items"]) for r in rows])


SPANS = "array<struct<first: int, last: int>>"


def _searched(rows: DataFrame, block, joins: bool) -> DataFrame:
    """(text, doc) rows with n_words, spans and items; those of earlier blocks are joined."""
    schema = T.StructType([f for f in rows.schema if f.name not in ("n_words", "spans", "items")] + T.StructType.fromDDL(f"n_words long, spans {SPANS}, items array<string>").fields)
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches):
        searcher = Searcher(block.value)
        for batch in batches:
            counts, spans, items = [], [], []
            earlier = zip(*(batch.column(n).to_pylist() for n in ("spans", "items"))) if joins else None
            for text in batch.column(0).cast(pa.binary()):
                words = words_of(text.as_py())
                found, named = searcher.hits(words)
                if earlier:
                    old, more = next(earlier)
                    found, named = _union(found, [(s["first"], s["last"]) for s in old]), named | set(more)
                counts.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in found])
                items.append(sorted(named))
            columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def _union(a, b):
    out = []
    for first, last in sorted([*a, *b]):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, block: int = 200_000, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", keep: bool = False) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document: the spans of words (from first,
    up to last) inside benchmark windows and the items they come from. With ``keep``, the
    whole row as ``doc`` instead of doc_id."""
    name, what = ("doc", F.struct("*")) if keep else ("doc_id", F.col(id_col))
    rows, late = docs.select(F.col(text_col).alias("_text"), what.alias(name)), False
    for parts, held in _blocks(benchmark, width, block, item_col=item_col, text_col=item_text_col):
        rows = _searched(rows, held, late)
        late = True
        if parts > 1:
            rows = stored(rows)
    return rows.drop("_text")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = find_benchmark(docs, benchmark, width, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, **options) -> DataFrame:
    """The documents in which no benchmark window occurs, with the columns of ``docs``."""
    found = find_benchmark(docs, benchmark, width, keep=True, **options)
    return found.where(F.size("spans") == 0).select("doc.*")
