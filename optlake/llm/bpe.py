"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut into pieces by the vocabulary's pattern. A piece that is a token itself is
that token. Any other piece starts as single bytes; leaf ``i`` of a segment tree holds the
rank of the pair that begins at byte ``i`` together with ``i``, so that the root is the
lowest rank and, among equal ranks, the leftmost place. A merge takes the root's pair,
links the live neighbours and sets three leaves anew (the merged part, the part it
swallowed, and its left neighbour), each in a logarithmic walk to the root. A piece of n
bytes, however long, costs n log n. The trees of short pieces lie side by side in one array
and take their steps together; a piece above ``WIDEST`` bytes has its tree to itself.

The published pattern never joins what stands on both sides of a space between two other
marks, so words are looked up before they are cut into pieces.

Documents are independent rows: nothing is shuffled, and memory is a batch of texts, its ids and
two generations of ``REMEMBERED`` words that a worker has met (they live beside the ranks
in the worker's copy of the broadcast, so that later tasks find them). The ranks are the only broadcast; their size
is that of the file, which the driver reads.

Defined cases: null and empty texts have no ids and decode to no bytes; a very long text or
piece is cut as a stream; no string is special; ties of rank are merged from the left;
repeated rows give repeated rows; an empty table gives an empty one; columns not named, and
columns named like those made here, are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of the published rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of one generation of a memo.
REMEMBERED = 400_000
#: Characters, and pieces of a part without spaces, that are looked up together.
GROUP = 1_000_000
STRIDE = 100_000
#: Bytes of the longest piece whose tree is kept among others.
WIDEST = 64
#: Bits of a place beside a rank.
PLACE = 31
#: All characters that the pattern's blanks may match.
BLANKS = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() or regex.match(r"\s", c))
NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that together are a token, as sorted numbers, and its rank."""
    pairs = {left << 32 | right: rank for token, rank in ranks.items() for k in range(1, len(token)) if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None}
    keys = np.array(sorted(pairs), np.int64)
    return keys, np.array([pairs[k] for k in keys.tolist()], np.int64)


def merge_piece(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Ids of one piece of any length after all merges."""
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    tree = [NONE] * (2 * n)

    def pair(i: int) -> int:
        """Rank and place of the pair of live parts that begins at byte ``i``."""
        j = after[i]
        rank = ranks.get(piece[i : after[j]]) if j < n else None
        return NONE if rank is None else rank << PLACE | i

    def put(i: int, value: int) -> None:
        k = n + i
        tree[k] = value
        while k > 1:
            value, k = min(tree[k], tree[k ^ 1]), k >> 1
            if tree[k] == value:
                break
            tree[k] = value

    for i in range(n - 1):
        tree[n + i] = pair(i)
    for k in range(n - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    while n > 1 and (best := tree[1]) != NONE:
        i = best & (1 << PLACE) - 1
        j = after[i]
        after[i] = after[j]
        before[after[i]] = i
        put(j, NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def merge_pieces(table: tuple[np.ndarray, np.ndarray], letters: np.ndarray, pieces: list[bytes], width: int) -> list[bytes]:
    """Ids, as int32 bytes, of many pieces of at most ``width`` bytes, a power of two. Each
    piece has its own tree; every step merges the root's pair of each piece that has one."""
    (keys, made), n = table, len(pieces)
    sizes = np.array([len(p) for p in pieces])
    ids = np.full((n, width + 1), -1, np.int64)
    ids[:, :width][np.arange(width) < sizes[:, None]] = letters[np.frombuffer(b"".join(pieces), np.uint8)]
    tree = np.full((n, 2 * width), NONE, np.int64)
    after = np.tile(np.arange(1, width + 3), (n, 1))
    before = np.tile(np.arange(-1, width + 1), (n, 1))

    def pairs(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank and place of pairs of ids; -1 stands for no part."""
        key = left << 32 | right
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[found] == key) & (left >= 0) & (right >= 0), made[found] << PLACE | at, NONE)

    tree[:, width:] = pairs(ids[:, :-1], ids[:, 1:], np.arange(width))
    half = width
    while half > 1:
        tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
        half //= 2
    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        best = tree[rows, 1]
        i = best & (1 << PLACE) - 1
        j = after[rows, i]
        end, last = after[rows, j], before[rows, i]
        ids[rows, i], ids[rows, j] = best >> PLACE, -1
        after[rows, i], before[rows, end] = end, i
        tree[rows, width + j] = NONE
        tree[rows, width + i] = pairs(ids[rows, i], ids[rows, np.minimum(end, width)], i)
        some = np.flatnonzero(last >= 0)
        at = last[some]
        tree[rows[some], width + at] = pairs(ids[rows[some], at], ids[rows[some], i[some]], at)
        paths = [(rows, width + i), (rows, width + j), (rows[some], width + at)]
        for _ in range(width.bit_length() - 1):
            for k, (row, node) in enumerate(paths):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                paths[k] = row, node
        rows = rows[tree[rows, 1] != NONE]
    live = ids >= 0
    flat, ends = ids[live].astype(np.int32).tobytes(), 4 * np.cumsum(live.sum(axis=1))
    return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


class Memo:
    """Two generations of remembered values: what is not used while one fills is forgotten."""

    def __init__(self):
        self.young, self.old = {}, {}

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that must be made; the others are now young."""
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        keys = {k for k in keys if k not in young}
        again = {k for k in keys if k in old}
        young.update((k, old[k]) for k in again)
        return keys - again


class Encoder:
    """Ids of texts, as int32 bytes. Words that were met are remembered; the memo may be
    handed on from task to task of a worker."""

    def __init__(self, ranks: dict[bytes, int], table: tuple, pattern: str, memos: dict | None = None):
        self.ranks, self.table, self.cut = ranks, table, regex.compile(pattern)
        self.letters = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.by_words = pattern == PATTERN
        self.words = ({} if memos is None else memos).setdefault("words", Memo())

    def _ids(self, pieces: set) -> dict[str, bytes]:
        """Ids of pieces."""
        found, trees = {}, {}
        for piece in pieces:
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                found[piece] = whole.to_bytes(4, "little")
            elif len(data) > WIDEST:
                found[piece] = np.array(merge_piece(self.ranks, data), "<i4").tobytes()
            else:
                trees.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
        for width, some in trees.items():
            for k in range(0, len(some), 4_000):
                part = some[k : k + 4_000]
                found.update(zip((p for p, _ in part), merge_pieces(self.table, self.letters, [d for _, d in part], width)))
        return found

    def _learn_words(self, words: list[str]) -> None:
        """Words without spaces, cut as they are after a space: only the first piece of
        each has one."""
        pieces = self.cut.findall("".join([" " + w for w in words]))
        ids = list(map(self._ids(set(pieces)).__getitem__, pieces))
        starts = [k for k, p in enumerate(pieces) if p[0] == " "]
        self.words.young.update((w, b"".join(ids[a:b])) for w, a, b in zip(words, starts, [*starts[1:], len(ids)]))

    def _stream(self, part: str) -> bytes:
        """A part cut by the pattern, its pieces met as a stream."""
        found, ids = map(regex.Match.group, self.cut.finditer(part)), []
        while pieces := list(islice(found, STRIDE)):
            ids.append(b"".join(map(self._ids(set(pieces)).__getitem__, pieces)))
        return b"".join(ids)

    def _odd(self, words: list[str]) -> bytes:
        """Words of which some begin or end with a blank or are empty: what stands around
        such a space is cut together."""
        joined: list[str] = []
        open_ = False
        for word in words:
            if joined and (open_ or not word or word[0] in BLANKS):
                joined[-1] += " " + word
            else:
                joined.append(word)
            open_ = not word or word[-1] in BLANKS
        known = self.words.young
        return b"".join([known[w] if w in known and w in words else self._stream(" " + w) for w in joined])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the texts together should be short or one."""
        if not self.by_words:
            return [self._stream(t) for t in texts]
        if len(texts) == 1 and len(texts[0]) > 2 * GROUP:
            ids, start, text = [], 0, texts[0]
            while start < len(text):
                end = boundary(text, start + GROUP)
                ids += self._heads([text[start:end]]) if not start else self._spaced([text[start:end]])
                start = end
            return [b"".join(ids)]
        return self._heads(texts)

    def _heads(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that begin without a space of their own."""
        ends = [boundary(t, 1) for t in texts]
        heads = [self.cut.findall(t[:e]) if e <= GROUP else t[:e] for t, e in zip(texts, ends)]
        known = self._ids({p for h in heads if isinstance(h, list) for p in h})
        first = [b"".join(map(known.__getitem__, h)) if isinstance(h, list) else h for h in heads]
        first = [self._stream(h) if isinstance(h, str) else h for h in first]
        return [a + b for a, b in zip(first, self._spaced([t[e:] for t, e in zip(texts, ends)]))]

    def _spaced(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that begin with a space after and before other marks."""
        cuts = [p[1:].split(" ") if p else [] for p in parts]
        new = self.words.missing(set().union(*cuts))
        odd = {w for w in new if not w or w[0] in BLANKS or w[-1] in BLANKS}
        self._learn_words(list(new - odd))
        known = self.words.young
        return [b"".join(map(known.__getitem__, c)) if not odd or odd.isdisjoint(c) else self._odd(c) for c in cuts]


def boundary(text: str, start: int) -> int:
    """The first space from ``start`` on that stands between two other marks: no piece of
    the published pattern reaches across it. The end where there is none."""
    at = text.find(" ", start)
    while 0 < at < len(text) - 1 and (text[at - 1] in BLANKS or text[at + 1] in BLANKS):
        at = text.find(" ", at + 1)
    return at if 0 < at < len(text) - 1 else len(text)


def grouped(texts: Iterable[str]):
    """Consecutive texts of about ``GROUP`` characters; a longer one stands by itself."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > GROUP:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, ids): the token ids of every text under the ranks of the file at ``path``,
    each match of ``pattern`` encoded by itself."""
    ranks = load_ranks(path)
    held = docs.sparkSession.sparkContext.broadcast((ranks, pair_table(ranks), {}))

    def run(batches):
        ranks, table, memos = held.value
        encoder = Encoder(ranks, table, pattern, memos)
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(0))
            found = [ids for group in grouped(texts) for ids in encoder.encode(group)]
            ends = np.cumsum([0, *(len(f) // 4 for f in found)])
            flat = pa.array(np.frombuffer(b"".join(found), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "ids"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, ids_col="ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes its ids stand for, null for null ids. An id
    that the vocabulary lacks is an error."""
    tokens = {rank: token for token, rank in load_ranks(path).items()}
    held = encoded.sparkSession.sparkContext.broadcast([tokens.get(i) for i in range(max(tokens) + 1)])
    others = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        tokens = pa.array(held.value, pa.binary())
        for batch in batches:
            ids = batch.column(ids_col)
            taken = tokens.take(ids.values.slice(ids.offsets[0].as_py(), ids.offsets[-1].as_py() - ids.offsets[0].as_py()))
            if taken.null_count:
                raise ValueError("an id is not in the vocabulary")
            # the bytes of a row's tokens lie side by side in the taken array
            ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
            starts = pa.array(ends[np.asarray(ids.offsets) - ids.offsets[0].as_py()])
            decoded = pa.Array.from_buffers(pa.binary(), len(ids), [None, starts.buffers()[1], taken.buffers()[2]])
            decoded = pc.if_else(ids.is_valid(), decoded, None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), decoded], names=[*others, "decoded"])

    kept = encoded.drop("decoded").schema
    return encoded.mapInArrow(run, kept.add("decoded", "binary"))


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, ids, decoded)."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
