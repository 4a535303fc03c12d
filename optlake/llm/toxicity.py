"""Toxicity by weak supervision.

Voters. Five word lists, three patterns and eight lists of word stems look at a text and
fire or don't. The stems are mined from labelled rows outside the held-out fold: prefixes
that begin one or several words of toxic and hardly of clean texts, taken greedily while
they cover toxic texts not covered yet. Mining uses at most ``sample`` labelled texts of each class, a documented
bound; everything after it covers all documents.

Label model. One pass over the texts writes each document's votes and features. Documents
are counted by vote pattern (at most 2^16 of them) and training label. Expectation
maximisation over these counts, with the labelled ones held at their class, gives each
voter's rate of firing in each class. A voter that doesn't fire abstains; that none fires
is a vote of its own. The correlations of the voters within the classes
then damp votes that say the same thing twice, and the prior is set so that the expected
number of toxic documents stays.

Classifier. A logistic regression learns the label model's posterior from the features of
all documents by Newton steps, each one sum over the narrow rows.

Defined cases: null and empty texts have no votes and a score; a null or unlabelled id
teaches nothing; with no toxic label no stem is mined and the word lists and patterns vote
alone; a score of 0.5 counts as toxic; very long texts are read whole; repeated rows give
repeated rows; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optlake.llm.common import bucket_of, stored
from optlake.llm.quality import mean_labels

#: General insults in four languages, by what they say.
WORDS = (
    "dumb fool foolish idiot idiotic imbecile moron moronic stupid stupidity",
    "failure loser nobody pathetic useless worthless",
    "disgusting filth filthy garbage scum trash vermin",
    "clown coward creep freak jerk joke pig",
    "abschaum depp dumm idioten trottel widerlich crétin dégoûtant imbécile ordure basura estúpido estúpida idiota imbécil asqueroso",
)
PATTERNS = (
    r"\b(?:you|they)(?:'re| are)? (?:all )?(?:an? |such an? )?(?:idiot|moron|loser|clown|scum|trash|stupid|pathetic|worthless|disgusting)",
    r"\b(?:kill|hurt|destroy|hate) (?:you|him|her|them|yourself)\b|\bshut up\b|\bgo to hell\b",
    r"!{3,}|[?!]{4,}",
)
LISTS = 8
VOTERS = len(WORDS) + len(PATTERNS) + LISTS
SHORTEST, LONGEST, TIMES = 3, 10, 4


def words_in(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def mined_stems(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, most: int = 64, cost: float = 2.0) -> list[tuple[str, int]]:
    """(stem, k) signs of toxic texts, the most covering first, from (label_id, label)
    rows: a sign is seen in a text where k words begin with the stem. Signs are taken while
    they add toxic texts that outweigh ``cost`` times the clean texts they add."""
    order = F.xxhash64("label_id")
    chosen = labels.where("label = 1").orderBy(order, "label_id").limit(sample).unionAll(labels.where("label = 0").orderBy(order, "label_id").limit(sample))
    # bounded: two samples of ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(stored(chosen)), F.col("id") == F.col("label_id")).select("text", "label", "id")

    def prefixes(batches):
        for batch in batches:
            stems, times, labels_, ids = [], [], [], []
            for text, label, i in zip(*(c.to_pylist() for c in batch.columns)):
                tally = Counter(w[:n] for w in words_in(text or "") for n in range(SHORTEST, min(len(w), LONGEST) + 1))
                stems += tally.keys()
                times += [min(n, TIMES) for n in tally.values()]
                labels_ += [label] * len(tally)
                ids += [i] * len(tally)
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(times, pa.int32()), pa.array(labels_, pa.int32()), pa.array(ids, batch.column(2).type)], names=["stem", "times", "label", "id"])

    seen = texts.mapInArrow(prefixes, f"stem string, times int, label int, id {dict(texts.dtypes)['id']}")
    toxic, n = F.sum("label").alias("toxic"), F.count("*").alias("n")
    counts = seen.groupBy("stem", "times").agg(toxic, n)
    each = counts.select("stem", "toxic", "n", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("k")).groupBy("stem", "k").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    gain = F.col("toxic") - cost * (F.col("n") - F.col("toxic"))
    telling = each.where((F.col("toxic") >= 5) & (gain > 0)).orderBy(gain.desc(), "stem", "k").limit(4000).collect()
    alike: dict = {}
    for r in telling:
        key = (r["k"], r["toxic"], r["n"])
        longer = [t for t in alike.get(key, ()) if not r["stem"].startswith(t) and not t.startswith(r["stem"])]
        alike[key] = longer + [max([r["stem"], *(t for t in alike.get(key, ()) if t not in longer)], key=len)]
    signs = [(r["stem"], r["k"]) for r in telling if r["stem"] in alike[(r["k"], r["toxic"], r["n"])]][:400]
    # bounded: at most 400 signs of the sampled texts
    wanted = docs.sparkSession.createDataFrame(signs, "stem string, k int")
    rows = seen.join(F.broadcast(wanted), "stem").where("times >= k").groupBy("stem", "k").agg(F.collect_set(F.when(F.col("label") == 1, F.col("id"))).alias("toxic"), F.collect_set(F.when(F.col("label") == 0, F.col("id"))).alias("clean")).collect()
    covers = {(r["stem"], r["k"]): (set(r["toxic"]), set(r["clean"])) for r in rows}
    got, spoilt, picked = set(), set(), []

    def worth(sign):
        return len(covers[sign][0] - got) - cost * len(covers[sign][1] - spoilt)

    while covers and len(picked) < most:
        best = max(covers, key=lambda s: (worth(s), -s[1], len(s[0]), s[0]))
        if worth(best) < 3:
            break
        picked.append(best)
        got |= covers[best][0]
        spoilt |= covers[best][1]
    return picked


class Features:
    """Votes and features of a text."""

    def __init__(self, signs: list[tuple[str, int]]):
        self.words = {w: k for k, line in enumerate(WORDS) for w in line.split()}
        self.signs: dict[str, list[tuple[int, int]]] = {}
        for i, (stem, k) in enumerate(signs):
            self.signs.setdefault(stem, []).append((k, len(WORDS) + len(PATTERNS) + i % LISTS))
        self.lengths = sorted({len(s) for s in self.signs})
        self.patterns = [re.compile(p) for p in PATTERNS]

    def __call__(self, text: str) -> tuple[int, list[float]]:
        low = text.lower()
        tally = Counter(re.findall(r"\w+", low))
        counts, stems = [0] * VOTERS, Counter()
        for w, n in tally.items():
            if w in self.words:
                counts[self.words[w]] += n
            for k in self.lengths:
                if w[:k] in self.signs and len(w) >= k:
                    stems[w[:k]] += n
        for stem, n in stems.items():
            for k, voter in self.signs[stem]:
                if n >= k:
                    counts[voter] += n
        for k, pattern in enumerate(self.patterns):
            counts[len(WORDS) + k] = sum(1 for _ in pattern.finditer(low))
        mask = sum(1 << v for v, n in enumerate(counts) if n)
        words, hits, fired = tally.total(), sum(counts), bin(mask).count("1")
        return mask, [float(n > 0) for n in counts] + [np.log1p(hits), np.log1p(fired), float(hits > 0), 10 * hits / (words + 20), np.log1p(words) / 5]


def scored_rows(docs: DataFrame, stems: list[tuple[str, int]], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mask, x) of every document."""

    def run(batches):
        features = Features(stems)
        for batch in batches:
            made = [features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([m for m, _ in made], pa.int32()), pa.array([x for _, x in made], pa.list_(pa.float64()))], names=["doc_id", "mask", "x"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, mask int, x array<double>")


class LabelModel:
    """Posterior of each vote pattern, from (mask, label or None, n) counts."""

    def __init__(self, counted: list[tuple], steps: int = 60):
        masks = sorted({m for m, _, _ in counted})
        at = {m: i for i, m in enumerate(masks)}
        n = np.zeros((len(masks), 3))
        for m, label, k in counted:
            n[at[m], 2 if label is None else label] += k
        votes = (np.array(masks, np.int64)[:, None] >> np.arange(VOTERS) & 1).astype(float).reshape(len(masks), VOTERS)
        votes = np.hstack([votes, ~votes.any(1, keepdims=True)])
        told = n[:, :2].sum(0)
        p = np.where(votes[:, -1] == 0, 0.9, 0.02) if told.min(initial=0) == 0 else (n[:, 1] + 0.5 * told[1] / told.sum()) / (n[:, :2].sum(1) + 0.5)
        for _ in range(steps):
            one, zero = n[:, 1] + n[:, 2] * p, n[:, 0] + n[:, 2] * (1 - p)
            self.prior = (one.sum() + 1) / (one.sum() + zero.sum() + 2)
            self.rates = np.array([(zero @ votes + 0.05) / (zero.sum() + 1), (one @ votes + 0.05) / (one.sum() + 1)]).clip(1e-6, 1 - 1e-6)
            evidence = votes * np.log(self.rates[1] / self.rates[0])
            p = 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + evidence.sum(1), -40, 40)))
        one, zero = n[:, 1] + n[:, 2] * p, n[:, 0] + n[:, 2] * (1 - p)
        together = np.zeros((VOTERS + 1, VOTERS + 1))
        for rate, weight in zip(self.rates, (zero, one)):
            apart = votes - rate
            cov = (apart * weight[:, None]).T @ apart / max(weight.sum(), 1)
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            together += cov / np.outer(spread, spread) / 2
        self.correlations = together
        self.damping = 1 / (1 + np.maximum(together - np.diag(np.diag(together)), 0).sum(1))
        logit, expected = evidence @ self.damping, one.sum()
        low, high = -60.0, 60.0
        for _ in range(80):
            shift = (low + high) / 2
            total = (n.sum(1) / (1 + np.exp(-np.clip(logit + shift, -60, 60)))).sum()
            low, high = (shift, high) if total < expected else (low, shift)
        self.posterior = dict(zip(masks, (1 / (1 + np.exp(-np.clip(logit + shift, -60, 60)))).tolist()))


def logistic(rows: DataFrame, posterior: dict[int, float], width: int, steps: int = 12, ridge: float = 1e-4) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression of the posterior of
    ``mask`` on ``x``: Newton steps, each a sum over all rows."""
    weights = np.zeros(width + 1)
    soft = rows.sparkSession.sparkContext.broadcast(posterior)  # bounded: 2^VOTERS patterns
    for _ in range(steps):

        def run(batches, weights=weights):
            total = np.zeros((width + 2, width + 1))
            for batch in batches:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, width)
                x = np.hstack([x, np.ones((len(x), 1))])
                p = np.fromiter(map(soft.value.__getitem__, batch.column(0).to_pylist()), float, len(x))
                now = 1 / (1 + np.exp(-np.clip(x @ weights, -40, 40)))
                total[:-1] += (x * (now * (1 - now))[:, None]).T @ x
                total[-1] += x.T @ (p - now)
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "value"])

        sums = np.zeros((width + 2, width + 1))
        for r in rows.select("mask", "x").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
            sums[r["i"], r["j"]] = r["value"]
        n = max(sums[-2, -1], 1.0)
        keep = np.full(width + 1, ridge * 1000)
        step = np.linalg.solve(sums[:-1] + np.diag(keep), sums[-1] - keep * weights)
        weights = weights + step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-3 or n <= 0:
            break
    return weights


class ToxicityModel:
    def __init__(self, stems: list[tuple[str, int]], weights: np.ndarray):
        self.stems, self.weights = stems, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = 4_000, id_col="doc_id", text_col="text", label_col="toxic") -> tuple[ToxicityModel, DataFrame]:
    """The model, and the (doc_id, held_out, mask, x) rows it was made from."""
    known = mean_labels(labels.where(bucket_of(F.col("doc_id"), folds) != held), label_col)
    stems = mined_stems(docs, known, sample, id_col, text_col)
    rows = stored(scored_rows(docs, stems, id_col, text_col).withColumn("held_out", F.coalesce(bucket_of(F.col("doc_id"), folds) == held, F.lit(False))))
    counted = rows.join(known, F.col("doc_id") == F.col("label_id"), "left").groupBy("mask", "label").agg(F.count("*").alias("n")).collect()
    width = VOTERS + 5
    model = LabelModel([(r["mask"], r["label"], r["n"]) for r in counted])
    return ToxicityModel(stems, logistic(rows, model.posterior, width)), rows


def classify_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model, rows = train(docs, labels, **options)

    def run(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], names=["doc_id", "held_out", "score"])

    kind = dict(rows.dtypes)["doc_id"]
    scored = rows.select("doc_id", "held_out", "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col="text", **options) -> DataFrame:
    """The documents with a score below 0.5, with the columns of ``docs``."""
    model, _ = train(docs, labels, text_col=text_col, **options)
    at = docs.columns.index(text_col)

    def run(batches):
        features = Features(model.stems)
        for batch in batches:
            x = np.array([features(t or "")[1] for t in batch.column(at).to_pylist()]).reshape(batch.num_rows, -1)
            yield batch.filter(pa.array(model.score(x) < 0.5))

    return docs.mapInArrow(run, docs.schema)
