"""The registered queries over the smallest tables, against SQL, brute force, the
tokenizer library and held-out labels."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from optlake.llm import components, simhash
from optlake.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "pages", "conversations")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(sql):
    return dict(sql.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def rows(spark):
    kept = {}

    def get(name):
        if name not in kept:
            kept[name] = QUERIES[name](spark, FOLDER).collect()
        return kept[name]

    return get


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, rows, sql):
    got, want = rows(name), sql.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    near = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert Counter(near(r[c] for c in columns) for r in got) == Counter(map(near, want.fetchall()))


def folded(text):
    return (text or "").encode().lower()


def reach(items, linked):
    """Smallest item reachable, by trying all pairs."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(items)
    for a in order:
        for b in order:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in items}


def fingerprint(text):
    words = folded(text).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(rows, docs):
    got = {r["doc_id"]: r for r in rows("op3_simhash_near_duplicates")}
    prints = {i: fingerprint(t) for i, t in docs.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == reach(docs, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.array([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, radius + 2).astype(np.uint64)) for b in np.repeat(base, 25)])
    starts = np.sort(rng.choice(300, 7, replace=False))
    last = np.array([min([s for s in starts if s > i], default=300) for i in range(300)])
    got = {(int(a), int(b)) for i, j in simhash.close_pairs(fps, last, radius) for a, b in zip(i, j)}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, last[i]) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12])
def test_block_masks_lose_no_pair(n):
    masks, rng = simhash.block_masks(n, 4), random.Random(n)
    for _ in range(500):
        flipped = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & flipped == 0 for m in masks)


def test_tiles_of_hot_buckets(spark, monkeypatch):
    """One bucket that holds nearly everything is dealt out as tiles and loses nothing."""
    rng = random.Random(5)
    prints = sorted({(1 << 40) ^ sum(1 << b for b in rng.sample(range(8), 3)) ^ (rng.randrange(4) << 50) for _ in range(400)})
    monkeypatch.setattr(simhash, "TILE", 16)
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(3)
    roots = {r["node"]: r["root"] for r in components.components(simhash.close_links(nodes, 4)).collect()}
    assert {p: roots.get(p, p) for p in prints} == reach(prints, lambda a, b: (a ^ b).bit_count() <= 4)


def test_components_of_random_graphs_and_a_chain(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    pairs = set(edges) | {(b, a) for a, b in edges}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == reach({x for a, b in edges if a != b for x in (a, b)}, lambda a, b: (a, b) in pairs)


def test_shards(rows, docs):
    got = rows("op5_shard_by_splitters")
    assert {r["doc_id"]: r["size"] for r in got} == {i: len((t or "").encode()) + 1 for i, t in docs.items()}
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for k in range(8):
        part = [r for r in got if r["shard"] == k]
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 8) <= largest


def test_quality_rules(rows, docs):
    for r in rows("op8_quality_rules"):
        text = docs[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"]) and (r["kept"] or r["base_failed"] or r["llr"] < -0.25)


def test_likelihood_ratio_of_one_document(rows, docs):
    """The score of a few documents, from counts by plain Python."""
    def grams(text):
        data = folded_not(text)
        return Counter(((3 << 24 | data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % 2**14 for i in range(len(data) - 2))

    def folded_not(text):
        return (text or "").encode()

    got = {r["doc_id"]: r for r in rows("op8_quality_rules")}
    raw, target = Counter(), Counter()
    for i, t in docs.items():
        raw.update(grams(t))
        r = got[i]
        if r["n_words"] >= 50 and not (r["n_symbols"] or r["n_dup_lines"] or r["n_repeat_words"]):
            target.update(grams(t))
    a, b = sum(raw.values()) + 2**14, sum(target.values()) + 2**14
    for i in list(docs)[:20]:
        mine = grams(docs[i])
        score = sum(n * (np.log((target[g] + 1) / b) - np.log((raw[g] + 1) / a)) for g, n in mine.items()) / max(1, mine.total())
        assert abs(score - got[i]["llr"]) < 1e-9


def test_token_counts(rows, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from optlake.llm.tokens import TokenCounter, load_vocabulary

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in rows("op9_token_counts"):
        text = docs[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n := count(text), n > 1024)
    odd = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 3000, "ab" * 999 + "  " * 500, "\n\n\n x 　y", "日本語" * 300, "it's I'LL we'd", "\x1c\x1f \x85 x", "word " * 450_000]
    odd += ["".join(map(chr, [c, 97, c, 32, c])) for c in range(0, 0x3000, 7)]
    assert TokenCounter(load_vocabulary(path)).count(odd) == [count(t) for t in odd]


def test_line_dedup(rows, docs):
    got = rows("op6_line_dedup")
    line = {(i, k): x for i, t in docs.items() if t is not None for k, x in enumerate(t.split("\n"))}
    assert {(r["doc_id"], r["line_no"]) for r in got} == set(line)
    text = {r["line_id"]: line[r["doc_id"], r["line_no"]] for r in got if r["line_id"] is not None}
    sets = {i: {x[k : k + 5] for k in range(max(1, len(x) - 4))} for i, x in text.items()}
    component = {r["line_id"]: r["component_id"] for r in got}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = reach(text, alike)
    joined = sum(component[i] == component[want[i]] for i in want)
    assert joined >= 0.98 * len(want)
    assert all(want[component[i]] == want[i] for i in want)
    assert Counter(r["component_id"] for r in got if r["kept"] and r["line_id"] is not None) == Counter(set(component.values()) - {None})


@pytest.mark.parametrize("name, label, least", [("op2_quality_classifier", "quality", 0.95), ("op10_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{folder}/labels.parquet'").fetchall())
    got = [r for r in QUERIES[name](spark, folder).collect() if r["held_out"] and r["doc_id"] in truth]
    assert got and sum(r["predicted"] == truth[r["doc_id"]] for r in got) >= least * len(got)
    marked = {r["doc_id"]: r["score"] for r in got}
    good, bad = ([s for i, s in marked.items() if truth[i] == k] for k in (1, 0))
    assert np.mean(good) > np.mean(bad) + 0.4


def word_shingles(text, width=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(a, b, similarity=0.8):
    return a == b or len(a & b) >= similarity * len(a | b)


def test_similar_texts_against_brute_force(spark):
    """Random copies from light to heavy changes, short and empty texts, exact copies."""
    import random

    from optlake.llm import similar

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = ["", None, "one", "One", "a b c d e", " "]
    for size in (6, 12, 40, 300):
        for _ in range(12):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for rate in (0, 0.005, 0.01, 0.02, 0.03, 0.05):
                texts.append(" ".join(word() if rng.random() < rate else w for w in base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: word_shingles(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    kept = {r["doc_id"] for r in similar.drop_similar(docs).collect()}
    want = set(reach(sets, lambda a, b: alike(sets[a], sets[b])).values())
    assert len(links) > 300 and want <= kept and len(kept - want) <= 0.02 * len(texts)


def test_similar_hot_bucket_in_tiles(spark, monkeypatch):
    """One bucket of copies of one text, changed at different places, over several tiles."""
    from optlake.llm import similar

    monkeypatch.setattr(similar, "TILE", 40)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in similar.drop_similar(docs).collect()] == [0]


def test_pipeline(spark, docs, rows):
    """Each stage against what its operator's query says of its input."""
    kept = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = kept.collect()
        kept = stage(spark, kept, FOLDER)
        after = kept.collect()
        ids = Counter(r["doc_id"] for r in after)
        if name == "toxicity":
            toxic = {r["doc_id"] for r in rows("op10_toxicity") if r["predicted"]}
            assert ids == Counter(r["doc_id"] for r in before if r["doc_id"] not in toxic)
        elif name == "near_duplicates":
            sets = {r["doc_id"]: word_shingles(r["text"]) for r in before}
            assert ids == Counter(set(reach(sets, lambda a, b: alike(sets[a], sets[b])).values()))
        elif name == "decontamination":
            dirty = {r["doc_id"] for r in rows("op4_benchmark_contamination") if r["contaminated"]}
            assert ids == Counter(r["doc_id"] for r in before if r["doc_id"] not in dirty)
        elif name == "mixing":
            words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
            assert max(ids.values()) <= 2 and abs(sum(map(words, after)) - 1.5 * sum(map(words, before))) < 0.05 * sum(map(words, before))
        else:
            assert ids == Counter(r["doc_id"] for r in before)
            assert {hashlib.md5((r["text"] or "").encode()).digest() for r in after} == {hashlib.md5((r["text"] or "").encode()).digest() for r in before}
        if name != "sharding":
            assert kept.columns == spark.read.parquet(f"{FOLDER}/documents.parquet").columns
        kept = spark.createDataFrame(after, kept.schema)
