"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio.

Byte n-grams of every text are hashed into ``buckets``. Over all documents two multinomials
are counted in one pass: the raw corpus, and the trusted target, which are the documents
that the plain counts find spotless. A document's score is the mean over its n-grams of
log p_target - log p_raw; documents below ``threshold`` are not kept. Counts are summed in
each task before they are shuffled (at most ``buckets`` rows a task), and the table of
log ratios, whose size is fixed by ``buckets``, is all that is broadcast.

Defined cases: a null text has no words, lines or n-grams, score 0 and fails the base
rules; texts shorter than an n-gram have score 0; repeated rows give repeated rows; an
empty table gives an empty result; where no document is spotless, every ratio is 0; a
ratio equal to the threshold is kept; very long texts count whole; columns not named are not read and may have any name.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
STARTS = (np.arange(256) & 0xC0) != 0x80
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: An odd multiplier, for hashing.
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 20


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, lines equal to an earlier one, and words in
    three-word windows that occur more than once."""
    words = text.split()
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    windows = Counter(zip(words, words[1:], words[2:]))
    if len(windows) < len(words) - 2:
        upto = 0
        for i, w in enumerate(zip(words, words[1:], words[2:])):
            if windows[w] > 1:
                repeated += i + 3 - max(upto, i)
                upto = i + 3
    return len(words), int(n[STARTS].sum() - n[BLANKS].sum()), int(n[SYMBOLS].sum()), len(lines) - len(set(lines)), repeated


def spotless(counts: tuple) -> bool:
    n, chars, symbols, lines, repeated = counts
    return n >= 50 and not symbols and not lines and not repeated


def hashed_ngrams(text: bytes, sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    """How many n-grams of each size fall into each bucket; long texts go in pieces."""
    counts = np.zeros(buckets, np.int64)
    most = max(sizes) - 1
    for a in range(0, len(text), PIECE):
        data = np.frombuffer(text, np.uint8)[a : a + PIECE + most].astype(np.uint64)
        for size in sizes:
            n = min(len(data) - size + 1, PIECE)
            if n > 0:
                code = np.full(n, size, np.uint64)
                for k in range(size):
                    code = code << np.uint64(8) | data[k : k + n]
                counts += np.bincount((code * MULTIPLY >> np.uint64(40)) % np.uint64(buckets), minlength=buckets)
    return counts


def log_ratios(docs: DataFrame, sizes=(3,), buckets: int = 1 << 14, text_col="text") -> np.ndarray:
    """log p_target - log p_raw of each bucket over all documents, with add-one smoothing."""

    def run(batches):
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                text = text.as_py() or b""
                grams = hashed_ngrams(text, sizes, buckets)
                sums[0] += grams
                if spotless(base_counts(text)):
                    sums[1] += grams
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(s[used]) for s in sums)], names=["bucket", "raw", "target"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, raw long, target long")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def judge_quality(docs: DataFrame, sizes=(3,), buckets: int = 1 << 14, threshold: float = -0.25, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, the five counts, base_failed, llr, kept) of every document."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, sizes, buckets, text_col))

    def run(batches):
        for batch in batches:
            counts, scores = [], []
            for text in batch.column(0).cast(pa.binary()):
                text = text.as_py() or b""
                grams = hashed_ngrams(text, sizes, buckets)
                counts.append(base_counts(text))
                scores.append(float(grams @ ratios.value) / max(1, int(grams.sum())))
            columns = np.array(counts, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, columns), pa.array(scores, pa.float64())], names=["doc_id", *NAMES, "llr"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    kind = dict(rows.dtypes)["doc_id"]
    judged = rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in NAMES) + ", llr double")
    judged = judged.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
