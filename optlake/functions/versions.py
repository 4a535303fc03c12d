"""Debian version order as a sortable key built from expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part_key(text: Column) -> Column:
    """Alternating text and number runs. Text: ``~`` sorts before the end, the end before
    letters, letters before other signs. A number is its length and digits, so runs of
    any length up to 9999 digits compare by value."""
    runs = F.regexp_extract_all(text, F.lit(r"(\D*\d+|\D+)"), 1)

    def one(run):
        word = F.translate(F.regexp_extract(run, r"^\D*", 0), "~+-.:", " {|}\x7f")
        digits = F.regexp_replace(F.regexp_extract(run, r"\d*$", 0), "^0+", "")
        return F.concat(word, F.lit("!"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)

    body = F.array_join(F.transform(runs, one), "")
    return F.concat(F.when(body == "!0000", "").otherwise(body), F.lit("!0000"))


def debian_key(version: Column) -> Column:
    """Struct that orders versions: epoch, upstream part, revision."""
    epoch = F.coalesce(F.regexp_extract(version, r"^(\d+):", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    rest = F.regexp_replace(version, r"^\d+:", "")
    revision = F.when(rest.contains("-"), F.substring_index(rest, "-", -1)).otherwise("")
    upstream = F.regexp_replace(rest, r"-[^-]*$", "")
    return F.struct(epoch.alias("epoch"), _part_key(upstream).alias("upstream"), _part_key(revision).alias("revision"))
