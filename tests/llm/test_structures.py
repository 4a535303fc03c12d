"""Merkle manifests, conversation repair and byte-level BPE against brute force, the
tokenizer library, and odd inputs."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from optlake.llm import bpe, conversations, merkle
from optlake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    ranks = bpe.load_ranks(RANKS)
    return bpe.Encoder(ranks, bpe.pair_table(ranks), public_tokenizers.PATTERN)


def ids(encoder, text):
    return [i for part in bpe.grouped([text]) for found in encoder.encode(part) for i in np.frombuffer(found, np.int32).tolist()]


# ------------------------------------------------------------------ byte-level BPE


def test_bpe_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_byte_bpe"](spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        want = library.encode_ordinary(text)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(want), sha(" ".join(map(str, want))), sha(text))


def test_bpe_characters(encoder, library):
    marks = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x110000, 31)]]
    for form in ("a{0} 1", "  {0}{0} x"):
        texts = [".".join(map(form.format, marks[k : k + 500])) for k in range(0, len(marks), 500)]
        got = [np.frombuffer(f, np.int32).tolist() for g in bpe.grouped(texts) for f in encoder.encode(g)]
        assert got == library.encode_ordinary_batch(texts)


@pytest.mark.parametrize("group, stride", [(1_000_000, 100_000), (3, 2)])
def test_bpe_odd_spacing(encoder, library, monkeypatch, group, stride):
    monkeypatch.setattr(bpe, "GROUP", group)
    monkeypatch.setattr(bpe, "STRIDE", stride)
    rng = random.Random(group)
    parts = ["a", " ", "\n", "é", "'s", "1", "!", "  ", "　", "\x1c", " ", "\t", "日", "ll", " '"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_bpe_long_pieces(encoder, library):
    rng = random.Random(3)
    for text in ("a" * 30_000, "ab" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(30_000)), "é日" * 10_000, " " * 30_000 + "x"):
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_bpe_tables(spark, odd_docs, no_docs, library):
    decoded = bpe.decode_documents(bpe.encode_documents(odd_docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in decoded.collect()) == Counter((r.doc_id, r.text or "") for r in odd_docs.collect())
    assert bpe.encode_documents(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    other = bpe.encode_documents(odd_docs.where("doc_id = 0"), RANKS, r"\S+|\s+").first()
    whole = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    assert list(other.ids) == whole.encode_ordinary(odd_docs.where("doc_id = 0").first().text)
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [64])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded if r.decoded is None else bytes(r.decoded) for r in bpe.decode_documents(nulls, RANKS).collect()} == {1: None, 2: b"", 3: next(t for t, i in bpe.load_ranks(RANKS).items() if i == 64)}


# ------------------------------------------------------------------ conversations


def cheapest(symbols):
    """Least cost and first audit, by always extending the best audit so far."""
    import heapq

    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, place = heapq.heappop(heap)
        if i > len(symbols):
            return cost, audit
        if (i, place) in done:
            continue
        done.add((i, place))
        for role in "ua":
            if role in conversations.NEXT[place]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, conversations.NEXT[place][role]))
        if i == len(symbols):
            if place in (0, 3):
                heapq.heappush(heap, (cost, audit, i + 1, place))
            continue
        initial, fault = symbols[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, place))
        if fault in "-t":
            stay = 3 * (fault == "t")
            if initial in conversations.NEXT[place]:
                heapq.heappush(heap, (cost + stay, audit + "K", i + 1, conversations.NEXT[place][initial]))
            for role in "ua":
                if role in conversations.NEXT[place]:
                    heapq.heappush(heap, (cost + stay + 3, audit + "R", i + 1, conversations.NEXT[place][role]))


def test_repairs():
    rng, steps = random.Random(3), conversations.Steps()
    for _ in range(4000):
        symbols = [rng.choice("suau-") + rng.choice("bd--t-") for _ in range(rng.randint(0, 9)) for _ in range(rng.choice((1, 1, 2, 3)))]
        runs = [(k, len(list(found))) for k, found in itertools.groupby(symbols)]
        assert steps.repair(runs) == cheapest(symbols)
    cost, audit = steps.repair([("u-", 100_000), ("ub", 5_000)])
    assert cost == 3 * 50_000 + 4 * 5_000 and len(audit) == 105_000


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 3, "assistant", "Yes!"), (1, 3, "assistant", "Yes"),
        (2, None, "system", "Be kind."), (2, 1, None, "x."), (None, 1, "user", "a."), (None, 2, "assistant", "b. \t"),
        (3, 5, "user", " \n"), (4, 0, "assistant", "z" * 200_000 + "?"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS copies", "2 AS fault", "3 AS audit", "4 AS again")
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_conversations(conversations.whole(df.repartition(4))).collect()}
    assert got[1] == (2, 0, 1, 1, 2, 8, "KDDK", sha("user:Hi.\nassistant:Yes!"))
    assert got[2] == (0, 0, 0, 0, 1, 6, "KIR", sha("system:Be kind.\nuser:\nassistant:x."))
    assert got[None] == (0, 0, 0, 0, 0, 0, "KK", sha("user:a.\nassistant:b. \t"))
    assert got[3] == (0, 1, 0, 0, 0, 4, "D", sha("")) and got[4] == (0, 0, 0, 0, 0, 3, "IK", sha("user:\nassistant:" + "z" * 200_000 + "?"))
    dropped = conversations.whole(df).withColumn("copies", df.turn * 0).na.fill(0, ["copies"])
    assert {tuple(r)[1:] for r in conversations.repair_conversations(dropped.selectExpr("conv_id", "turn", "role", "text", "int(copies) AS copies")).collect()} == {(0, 0, 0, 0, 0, 0, "", sha(""))}
    assert conversations.repair_conversations(conversations.damage(df.where("false"))).count() == 0


# ------------------------------------------------------------------ manifests


def tree(digests):
    """Levels from the leaves up."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def path(levels, at):
    """(before, after) of each level from a leaf up."""
    for level in levels[:-1]:
        start = at // 8 * 8
        yield "".join(level[start:at]), "".join(level[at + 1 : start + 8])
        at //= 8


@pytest.mark.parametrize("sizes", [(1,), (8,), (1, 9, 700), tuple([1] * 70), (65, 3, 1)])
def test_manifest(spark, sizes):
    rows = [(i * 10 + g, f"s{i}" if i % 3 else None, None if g == 0 else f"l{g:03d}", i if i % 4 else None, f"Text {i} É" if i % 5 else None) for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS leaf", "2 AS tree", "3 AS pos", "4 AS rank", "5 AS run").repartition(5)
    got = {(r.doc_id, r.leaf): r for r in merkle.tampered_manifest(docs).collect()}
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[1], r[2], r[3], text))))
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[0])):
        groups.setdefault(r[2], []).append(r)
    trees = [tree([leaf(r, r[4]) for r in group]) for group in groups.values()]
    top = tree([t[-1][0] for t in trees])
    assert len(got) == len(rows)
    for g, group in enumerate(groups.values()):
        for i, r in enumerate(group):
            lower = zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            folded, proof = leaf(r, r[4].replace("T", "t") if lower else r[4]), ""
            for before, after in [*path(trees[g], i), *path(top, g)]:
                folded, proof = sha(before + folded + after), proof + before + after
            row = got[r[0], leaf(r, r[4])]
            assert (row.subroot, row.root, row.proof_sha256) == (trees[g][-1][0], top[-1][0], sha(proof))
            assert (row.folded_root, row.verified) == (folded, folded == top[-1][0]) and row.verified == (not lower)


def test_manifest_of_odd_tables(spark, odd_docs, no_docs, monkeypatch):
    got = merkle.tampered_manifest(odd_docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd_docs.collect()) and len({r.root for r in got}) == 1
    assert all(r.verified or r.doc_id is not None for r in got)
    assert merkle.tampered_manifest(no_docs).count() == 0
    monkeypatch.setattr(merkle, "SHARE", 2)  # every node above a run is salted
    assert sorted(map(str, merkle.tampered_manifest(odd_docs).collect())) == sorted(map(str, got))
