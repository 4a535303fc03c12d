"""Quality classifier: a regularised quadratic discriminant over document statistics.

One pass over the texts writes each document's transformed statistics; everything after it
works on those narrow rows. The labelled rows are joined to them (narrow on both sides) and
give each class its count, sum and matrix of products, added up in the tasks and then by
Spark, so all labelled rows are used and the driver holds a few matrices. Covariances are
shrunk towards the pooled covariance and its diagonal. With the Cholesky factors kept, a
document's score is the logistic of the difference of the two log-densities (squared
Mahalanobis lengths by triangular solves, and log-determinants) and log priors.

Defined cases: null and empty texts have the statistics of no text and a score; a null or
unlabelled id teaches nothing; several labels of an id count as their mean, from 0.5 on as
1; with no rows of a class, all scores are the share of the other (0.5 without any);
repeated rows give repeated rows; an empty table gives an empty result; a score of 0.5 counts as
1; very long texts count whole; columns not named are not read and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optlake.llm.common import bucket_of, stored

ASCII = np.arange(256)
UPPER = (ASCII >= 65) & (ASCII <= 90)
DIGITS = (ASCII >= 48) & (ASCII <= 57)
STOPS = np.isin(ASCII, list(b".,;:?'\"()-"))
SHOUTS = ASCII == 33
OTHERS = (ASCII > 32) & (ASCII < 127) & ~UPPER & ~DIGITS & ~STOPS & ~SHOUTS & ~((ASCII >= 97) & (ASCII <= 122))
HIGH = ASCII >= 128


def statistics(text: bytes) -> list[float]:
    """Shares are square roots of smoothed shares, amounts are logarithms: short texts
    stay near the usual value and long tails become shorter."""
    words = text.split()
    n, c = len(words), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(c[33:].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    first: dict = {}
    for w in words:
        first[w] = first.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    same = sum(a == b for a, b in zip(words, words[1:]))

    def share(k, of, usual, weight):
        return ((k + usual * weight) / (of + weight)) ** 0.5

    return [
        np.log1p(n),
        share(int(c[UPPER].sum()), chars, 0.02, 200),
        share(int(c[DIGITS].sum()), chars, 0.0, 200),
        share(int(c[STOPS].sum()), chars, 0.03, 200),
        share(int(c[SHOUTS].sum()), chars, 0.0, 100),
        share(int(c[OTHERS].sum()), chars, 0.0, 100),
        share(int(c[HIGH].sum()), chars, 0.03, 100),
        np.log((chars + 250) / (n + 50)),
        np.log((max(map(len, words), default=0) + 20) / 30),
        share(n - len(first), n, 0.2, 100),
        share(max(first.values(), default=0), n, 0.05, 100),
        share(max(0, n - 1 - pairs), n, 0.03, 50),
        share(same, n, 0.0, 50),
        share(len(lines) - len(set(lines)), len(lines), 0.0, 4),
        np.log((chars + 500) / (len(lines) + 5)),
    ]


WIDTH = 15


def document_statistics(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, x) of every document."""

    def run(batches):
        for batch in batches:
            x = [statistics(t.as_py() or b"") for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, x array<double>")


def class_moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of ``x`` for each ``label`` of (label, x) rows."""

    def run(batches):
        sums = {}
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist(), float).reshape(len(label), -1)
            x = np.hstack([np.ones((len(x), 1)), x])
            for k in np.unique(label):
                part = x[label == k]
                sums[k] = sums.get(k, 0) + part.T @ part
        for k, m in sums.items():
            i, j = np.triu_indices(len(m))
            names = ["label", "i", "j", "value"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], names=names)

    added = rows.select(F.col("label").cast("int").alias("label"), "x").mapInArrow(run, "label int, i int, j int, value double").groupBy("label", "i", "j").agg(F.sum("value").alias("value")).collect()
    found: dict[int, np.ndarray] = {}
    for r in added:
        m = found.setdefault(r["label"], np.zeros((WIDTH + 1, WIDTH + 1)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["value"]
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in found.items()}


class Discriminant:
    """Two Gaussian classes with shrunk covariances and cached Cholesky factors."""

    def __init__(self, moments: dict, pooled: float = 0.05, diagonal: float = 0.05):
        self.share = {k: m[0] / sum(v[0] for v in moments.values()) for k, m in moments.items()}
        self.parts = []
        if len(moments) < 2:
            return
        mean = {k: s / n for k, (n, s, _) in moments.items()}
        scatter = {k: p - np.outer(mean[k], mean[k]) * n for k, (n, _, p) in moments.items()}
        within = sum(scatter.values()) / sum(n for n, _, _ in moments.values())
        within = (1 - diagonal) * within + diagonal * np.diag(np.diag(within)) + 1e-6 * np.eye(len(within))
        for k in (0, 1):
            cov = (1 - pooled) * scatter[k] / moments[k][0] + pooled * within
            factor = np.linalg.cholesky(cov)
            self.parts.append((mean[k], np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(self.share[k])))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        if not self.parts:
            return np.full(len(x), self.share.get(1, 0.0) if self.share else 0.5)
        dense = [prior - logdet - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, logdet, prior in self.parts]
        return 1 / (1 + np.exp(np.clip(dense[0] - dense[1], -500, 500)))


def mean_labels(labels: DataFrame, column: str, id_col="doc_id") -> DataFrame:
    """(label_id, label): one row for each id with a label."""
    named = labels.where(F.col(id_col).isNotNull() & F.col(column).isNotNull())
    return named.groupBy(F.col(id_col).alias("label_id")).agg((F.avg(F.col(column)) >= 0.5).cast("int").alias("label"))


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learnt from the labelled
    rows that are not held out."""
    rows = stored(document_statistics(docs, id_col, text_col).withColumn("held_out", F.coalesce(bucket_of(F.col("doc_id"), folds) == held, F.lit(False))))
    taught = rows.where(~F.col("held_out")).join(mean_labels(labels, label_col), F.col("doc_id") == F.col("label_id"))
    model = rows.sparkSession.sparkContext.broadcast(Discriminant(class_moments(taught.select("label", "x"))))

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(model.value.score(x))], names=["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
