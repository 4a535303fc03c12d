import pytest

TEXTS = [
    "the quick brown fox jumps over the lazy dog and runs far away from here today",
    "The Quick brown fox jumps over the lazy dog and runs far away from here today",
    "the quick brown fox jumps over the lazy dog and runs far away from there today",
    "",
    " \t\n\r\x0b\x0c ",
    None,
    "one",
    "un été à la plage, l'après-midi; 日本語 テキスト 🙂 fin\nsecond line\nsecond line\n\n",
    "a b c\x1cd\u00a0e\u2003f g",
    "you are such a stupid idiot and a pathetic loser, scum " * 3,
    "### *** $$$ %%% " * 40,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a null id, and
    columns whose names the operators use inside."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(120_000))
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, 1) for i, t in enumerate([*TEXTS, long])]
    rows += [rows[0], rows[0], (None, TEXTS[0], None, None, None), (None, None, None, "s1", None), (50, long, "en", "s1", 2)]
    clash = ["size", "bin", "bucket", "fp", "range", "key", "tie", "label", "x", "mask", "u", "v", "node", "root", "spans", "items", "doc", "shard", "held_out", "score", "line", "copies", "_text", "_id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(-7).alias(c) for c in clash]).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(12)] + [(0, None, 1), (None, 1, 1), (9, 1, 1), (9, 1, 1), (400, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
