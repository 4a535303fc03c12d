"""Token counts of a byte-level BPE by rank-synchronous merging.

A text is cut at special tokens and into pre-tokens. The distinct pre-tokens that a batch
has not met yet are held as one ragged array of byte symbols. In every step each sequence
finds its lowest-ranked adjacent pair, all sequences merge all places of their pair at
once, and sequences without a mergeable pair leave with the number of their symbols. A
pair made by a merge always ranks behind it, so this equals merging one place at a time.

The vocabulary's arrays are the only broadcast; their size is that of the file. Counts of
pre-tokens are remembered within a task up to ``REMEMBERED`` entries.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a special token's string in
a text is that token; very long texts count whole, cut as a stream; a count equal to the limit
is not over it; null ids stay; repeated rows give repeated rows; an empty table gives an empty
result; columns not named are not read and may have any name.
"""

from __future__ import annotations

import json
from collections import Counter
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of this kind of vocabulary, as its published files state it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 400_000
#: Characters of short texts cut together; longer texts are cut as a stream.
CHUNK = 1_000_000
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others
    for the letters from code point 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """Arrays of a byte-level BPE file: the symbol of each byte, and for each mergeable
    pair (as one number, sorted) its rank and the symbol it becomes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, kind = spec["model"], spec["pre_tokenizer"] or {}
    if spec["normalizer"] or model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"] or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("only plain byte-level BPE files are counted")
    ids = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    return {
        "bytes": np.array([ids[c] for c in byte_letters()], np.int64),
        "keys": keys[order],
        "ranks": order.astype(np.int64),
        "made": np.array([ids[a + b] for a, b in pairs], np.int64)[order],
        "special": [t["content"] for t in spec["added_tokens"]],
    }


def symbol_counts(vocabulary: dict, pieces: list[bytes]) -> np.ndarray:
    """How many symbols are left of each piece when nothing can be merged any more."""
    keys, ranks, made = vocabulary["keys"], vocabulary["ranks"], vocabulary["made"]
    counts = np.array([len(p) for p in pieces], np.int64)
    flat = vocabulary["bytes"][np.frombuffer(b"".join(pieces), np.uint8)]
    seq = np.repeat(np.arange(len(pieces)), counts)
    while len(flat):
        at = np.flatnonzero(seq[1:] == seq[:-1])
        key = flat[at] << 32 | flat[at + 1]
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        rank = np.where(keys[place] == key, ranks[place], NONE)
        lowest = np.full(len(pieces), NONE)
        np.minimum.at(lowest, seq[at], rank)
        use = np.flatnonzero((rank == lowest[seq[at]]) & (rank != NONE))
        # in a run of the same symbol every other place is merged, from the left
        spot, index = at[use], np.arange(len(use))
        start = np.r_[True, spot[1:] != spot[:-1] + 1][: len(use)]
        use = use[(index - np.maximum.accumulate(np.where(start, index, 0))) % 2 == 0]
        flat[at[use]] = made[place[use]]
        counts -= np.bincount(seq[at[use]], minlength=len(pieces))
        left = lowest[seq] != NONE
        left[at[use] + 1] = False
        flat, seq = flat[left], seq[left]
    return counts


class TokenCounter:
    def __init__(self, vocabulary: dict):
        self.vocabulary, self.known = vocabulary, {}
        self.cut = regex.compile(PATTERN)
        special = vocabulary["special"]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def _learn(self, pieces: set) -> None:
        new = list(pieces)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            self.known.update(zip(part, symbol_counts(self.vocabulary, [p.encode() for p in part]).tolist()))

    def _long(self, part: str) -> int:
        tally: Counter = Counter()
        total = 0
        for found in self.cut.finditer(part):
            tally[found.group()] += 1
            if len(tally) >= 50_000:
                total, tally = total + self._sum(tally), Counter()
        return total + self._sum(tally)

    def _sum(self, tally: Counter) -> int:
        self._learn(tally.keys() - self.known.keys() if len(self.known) + len(tally) <= REMEMBERED else tally.keys())
        known = self.known
        return sum(known[p] * n for p, n in tally.items())

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the texts together should be short."""
        parts = [self.special.split(t) if self.special else [t] for t in texts]
        if sum(map(len, texts)) > 2 * CHUNK:
            return [len(p) - 1 + sum(map(self._long, p)) for p in parts]
        cuts = [[x for p in ps for x in self.cut.findall(p)] for ps in parts]
        seen = set().union(*cuts)
        self._learn(seen - self.known.keys() if len(self.known) + len(seen) <= REMEMBERED else seen)
        known = self.known
        return [len(ps) - 1 + sum([known[x] for x in c]) for ps, c in zip(parts, cuts)]


def _groups(texts: list[str]):
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document under the vocabulary file
    at ``path``, which the driver reads."""
    held = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        counter = TokenCounter(held.value)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(0).to_pylist()]
            counts = [n for group in _groups(texts) for n in counter.count(group)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), size.alias("n_bytes"))
    kind = dict(rows.dtypes)["doc_id"]
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
