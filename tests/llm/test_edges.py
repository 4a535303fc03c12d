"""Odd inputs: every operator gives one row for each row, and a defined result."""

import inspect
import itertools
import os
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from optlake.llm import decontaminate, lines, mixing, quality, rules, sharding, similar, simhash, tokens, toxicity, urls
from optlake.llm.common import stored
from optlake.llm.components import components
from optlake.session import run_folder, stored_by

BLANK = "[^\x20\x09-\x0d]+"


def both(spark_rows, docs):
    return Counter(r["doc_id"] for r in spark_rows) == Counter(r["doc_id"] for r in docs.collect())


def test_mixing(odd_docs, no_docs):
    got = mixing.mix_sizes(odd_docs).collect()
    assert both(got, odd_docs)
    sizes = Counter()
    for r in odd_docs.collect():
        sizes[r["source"]] += len(re.findall(BLANK, r["text"] or ""))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
        taken[r["source"]] += r["taken"]
    targets = {r["source"]: r["target"] for r in got}
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sizes(odd_docs.repartition(5)).collect()), key=str)
    assert mixing.mix_sizes(no_docs).collect() == []
    texts = mixing.mix_documents(odd_docs)
    assert texts.columns == odd_docs.columns and texts.count() == sum(r["copies"] for r in got)
    assert mixing.mix_documents(no_docs).count() == 0


def test_no_document_above_the_cap(spark):
    """Empty documents of a source at its cap are taken as often as all others."""
    rows = [(i, None if i % 2 else "a b c", "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sizes(docs, ratio=5.0).collect()
    assert {r["copies"] for r in got} == {2} and mixing.mix_documents(docs, ratio=5.0).count() == 400


def test_sources_of_equal_rows(spark):
    """A source of one repeated row is near its target too, however the rows are dealt."""
    rows = [(5, "a b c d e f g h", "same", i) for i in range(1000)] + [(i, "x y " * (i % 7), None, i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _key long")
    got = mixing.mix_sizes(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_sizes(docs.coalesce(1)).collect()))
    for source, near in (("same", 8), (None, 15)):
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= near
    assert {r["copies"] for r in got if r["source"] == "same"} == {1, 2}
    texts = Counter(tuple(r) for r in mixing.mix_documents(docs).collect())
    assert sum(n for r, n in texts.items() if r[0] == 5 and r[2] == "same") == sum(r["copies"] for r in got if r["source"] == "same")
    assert max(texts.values()) <= 2


def test_water_level_of_given_weights(spark, odd_docs):
    weights = spark.createDataFrame([("s1", 1.0), ("s2", 0.0)], "source string, weight double")
    got = {r["source"]: r["target"] for r in mixing.mix_sizes(odd_docs, weights).collect()}
    size = {r["source"]: r["source_size"] for r in mixing.mix_sizes(odd_docs, weights).collect()}
    assert got["s1"] == 2 * size["s1"] and got["s2"] == got["s3"] == got[None] == 0


def test_sharding(odd_docs, no_docs):
    got = sharding.shard_sizes(odd_docs, shards=4, ranges=64).collect()
    assert both(got, odd_docs)
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is not None:
            data = (texts[r["doc_id"]] or "").encode()
            assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_sizes(no_docs).collect() == []
    wide = sharding.shard_documents(odd_docs, shards=4, ranges=64)
    assert set(odd_docs.columns) <= set(wide.columns) and wide.count() == len(got)
    assert sharding.shard_documents(no_docs).count() == 0


def test_simhash(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert both(got, odd_docs)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == by[5]["fingerprint"] == "0" * 16 and by[5]["component_id"] == 3
    assert by[0]["component_id"] == by[1]["component_id"] == 0 and by[50]["component_id"] == 11
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.drop_near_duplicates(odd_docs)
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted({r["component_id"] for r in got}) and kept.columns == odd_docs.columns
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def test_similar(odd_docs, no_docs):
    kept = similar.drop_similar(odd_docs).collect()
    # blanks and no text are one node; the two long texts and the first two texts are copies
    assert sorted(r["doc_id"] for r in kept) == [0, 2, 3, 6, 7, 8, 9, 10, 11]
    assert similar.drop_similar(odd_docs).columns == odd_docs.columns
    nameless = similar.drop_similar(odd_docs.where("doc_id IS NULL")).collect()
    assert len(nameless) == 2 and similar.drop_similar(no_docs).count() == 0


def test_decontamination(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(7, "Fox jumps, over the lazy dog and runs far away!"), (8, "one"), (9, None), (10, ""), (None, "second line"), (8, "one")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(odd_docs, bench).collect() if r["doc_id"] is not None}
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["n_items"]) == (16, 10, 1) and not got[3]["contaminated"] and not got[5]["n_words"]
    assert got[6]["n_hit"] == 1 and got[7]["n_hit"] == 4 and got[11]["n_words"] == 120_000
    assert both(decontaminate.contamination(odd_docs, bench).collect(), odd_docs)
    empty = decontaminate.contamination(odd_docs, bench.where("false")).collect()
    assert both(empty, odd_docs) and not any(r["contaminated"] for r in empty)
    assert decontaminate.contamination(no_docs, bench).collect() == []
    clean = decontaminate.drop_contaminated(odd_docs, bench)
    assert clean.columns == odd_docs.columns and 0 not in {r["doc_id"] for r in clean.collect()} and clean.where("doc_id = 5").count() == 1
    # many blocks of windows give what one gives
    split = decontaminate.contamination(odd_docs, bench, block=1).collect()
    assert sorted(map(tuple, split), key=str) == sorted(map(tuple, decontaminate.contamination(odd_docs, bench).collect()), key=str)


def test_tokens(odd_docs, no_docs):
    """Null ids and texts, repeated rows and very long texts, against the library itself."""
    library = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    loaded = library.Tokenizer.from_file(str(path))
    loaded.no_truncation()
    loaded.no_padding()
    got = tokens.token_counts(odd_docs, path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    known = {t: len(loaded.encode(t, add_special_tokens=False).ids) for t in {r["text"] or "" for r in odd_docs.collect()}}
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), known[r["text"] or ""], known[r["text"] or ""] > 1024) for r in odd_docs.collect())
    assert Counter(map(tuple, got.collect())) == want
    at = known[odd_docs.where("doc_id = 0").first()["text"]]
    assert not any(r["over_limit"] for r in tokens.token_counts(odd_docs.where("doc_id = 0"), path, limit=at).collect())
    assert tokens.token_counts(no_docs, path).collect() == []


def test_lines(odd_docs, no_docs):
    got = lines.mark_lines(odd_docs).collect()
    expected = Counter((r["doc_id"], i) for r in odd_docs.collect() if r["text"] is not None for i in range(len(r["text"].split("\n"))))
    assert Counter((r["doc_id"], r["line_no"]) for r in got) == expected
    kept = {(r["doc_id"], r["line_no"]) for r in got if r["kept"]}
    assert (0, 0) in kept and (1, 0) not in kept and (7, 1) in kept and (7, 2) not in kept and (7, 3) in kept and (None, 0) not in kept
    assert lines.mark_lines(no_docs).collect() == []
    texts = {r["doc_id"]: r["text"] for r in lines.dedup_lines(odd_docs.where("doc_id in (1, 5, 7, 8)")).collect()}
    assert texts[7] == "un été à la plage, l'après-midi; 日本語 テキスト 🙂 fin\nsecond line\n\n" and texts[5] is None


def test_lines_of_crowded_buckets(spark):
    """Every two lines that share a bucket and are alike end up in one component, as in a
    chain in which the middle line has matched already and in a family of one template."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(60):
        words = [word() for _ in range(14)]
        for k in range(3):
            texts.append(" ".join(words[:10] + ["tail%d" % (i < k) for i in range(2)] + words[10:]))
            words[12 - k] = word()
    head = "connection to the server of the northern region was closed after "
    texts += [head + f"{rng.choice(['idle', 'busy', 'open'])} {word()} seconds {rng.choice('xyz') * 3}{i % 7}" for i in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_id long, line string")
    buckets = {r["line_id"]: set(r["buckets"]) for r in lines.signatures(rows, 5, 6, 4).collect()}
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if buckets[i] & buckets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root[max(top(i), top(j))] = min(top(i), top(j))
    want = {i: top(i) for i in range(len(texts))}
    got = dict(map(tuple, components(lines.similar_lines(rows, bands=6, rows=4)).collect()))
    assert {i: got.get(i, i) for i in want} == want
    tiled, lines.TILE = lines.TILE, 16
    try:
        got = dict(map(tuple, components(lines.similar_lines(rows, bands=6, rows=4)).collect()))
    finally:
        lines.TILE = tiled
    assert {i: got.get(i, i) for i in want} == want


def test_signatures_by_part(spark):
    """What is found by parts of the hashes, of long lines, is what all positions give; short and
    uniform lines are among them."""
    rng = random.Random(7)
    texts = ["x", "ab " * 400, "x" * 900, *("".join(rng.choice("abcdefgh é日🙂") for _ in range(n)) for n in [3, 30, 47, 48, 49, 60, 90, 300, 2000] * 4)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_id long, line string")
    texts = stored_by(rows.groupBy("line_id").agg(F.first("line").alias("line")), "line_id", dealt=True)
    for bands, each in ((8, 3), (2, 1)):
        want, got = lines.signatures(rows, 5, bands, each), lines._stored_signatures(texts, 5, bands, each)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_similar_lines_leave_only_links(spark):
    """Texts, signatures and candidates are gone when the links are there; a stored table keeps no
    shuffle files."""
    rng = random.Random(9)
    rows = spark.createDataFrame([(i, " ".join(rng.choice("abc") * 6 for _ in range(30))) for i in range(200)], "line_id long, line string")
    folder, local = run_folder(spark), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f"{d}/{x}" for d, _, names in os.walk(folder) for x in names if x.endswith(".parquet")}
    wait = lambda f: any(f() or time.sleep(0.1) for _ in range(50))
    shuffled = lambda: {x for at in local for _, _, names in os.walk(at.getPath()) for x in names if x.startswith("shuffle_")}
    kept = shuffled()
    stored(rows.groupBy("line").agg(F.min("line_id").alias("line_id")))
    assert wait(lambda: not shuffled() - kept)
    before = files()
    links = lines.similar_lines(rows)
    links.collect()
    assert {tuple(spark.read.parquet(x).columns) for x in files() - before} <= {("src", "dst"), ("u", "v")}


def test_line_bands():
    """A pair at the wanted similarity shares a bucket with a chance of at least 99.5%."""
    for f in (lines.similar_lines, lines.mark_lines):
        given = {k: p.default for k, p in inspect.signature(f).parameters.items()}
        assert 1 - (1 - given["similarity"] ** given["rows"]) ** given["bands"] > 0.995


def test_urls(spark):
    rules_ = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("a.b", "/x", "allow"), ("a.b", "/x", "block")]
    pages = spark.createDataFrame(
        [(1, "https://WWW.Example.org/en/12?x"), (2, "http://example.org/en/2#y"), (3, "http://badexample.org/es/"), (4, "http://example.org"), (5, None), (6, "no scheme/es/"), (7, "x://a.b/xy"), (8, "x://a.b?/x"), (None, "http://m.example.org/es/a/b"), (9, ""), (1, "https://WWW.Example.org/en/12?x")],
        "page_id long, url string",
    ).selectExpr("*", "1 AS host", "2 AS verdict")
    want = [(1, "www.example.org", "/en/12", "example.org/en/1", "block")] * 2 + [
        (2, "example.org", "/en/2", "org/", "allow"), (3, "badexample.org", "/es/", "org/", "allow"), (4, "example.org", "", None, "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
        (7, "a.b", "/xy", "a.b/x", "block"), (8, "a.b", "", None, "allow"), (None, "m.example.org", "/es/a/b", "example.org/es/", "block"), (9, "", "", None, "allow"),
    ]
    for block in (100, 1):
        assert sorted(map(tuple, urls.judge_urls(pages, rules_, block=block).collect()), key=str) == sorted(want, key=str)
    assert {r["verdict"] for r in urls.judge_urls(pages, [], default="block").collect()} == {"block"}
    long = spark.createDataFrame([(1, "s" * 200_000 + "://a.b/x" + "/y\n" * 200_000 + "?z")], "page_id long, url string")
    got = urls.judge_urls(long, rules_).first()
    assert (got["host"], len(got["path"]), got["verdict"]) == ("a.b", 600_002, "block")
    assert urls.judge_urls(pages.where("false"), rules_).collect() == []


def test_quality_rules(odd_docs, no_docs):
    got = rules.judge_quality(odd_docs).collect()
    assert both(got, odd_docs)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["base_failed"] and by[3]["llr"] == 0 and by[10]["n_symbols"] == 480 and by[7]["n_dup_lines"] == 1 and by[11]["n_words"] == 120_000
    assert rules.judge_quality(no_docs).collect() == []


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers(odd_docs, no_docs, labels, which):
    run = quality.classify_quality if which == "quality" else toxicity.classify_toxicity
    for given in (labels, labels.where("false"), labels.where(f"{which} = 1")):
        got = run(odd_docs, given).collect()
        assert both(got, odd_docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert run(no_docs, labels).collect() == []


def test_dropping_toxic_documents(odd_docs, no_docs, labels):
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert toxicity.drop_toxic(no_docs, labels).count() == 0
