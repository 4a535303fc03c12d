"""Option values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_quotes(value: Column) -> Column:
    v = F.trim(value)
    quoted = v.startswith('"') & v.endswith('"') & (F.length(v) >= 2)
    return F.when(quoted, v.substr(F.lit(2), F.length(v) - 2)).otherwise(v)


def normalize(value: Column) -> Column:
    """Form for comparison: switches as they are, text without its quotes."""
    return strip_quotes(value)


def or_off(value: Column) -> Column:
    """Missing or empty is n."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("n"))


def switch(value: Column) -> Column:
    """n unless the value is y or m: numbers and texts count as off."""
    return F.when(value.isin("y", "m"), value).otherwise(F.lit("n"))


def as_number(value: Column) -> Column:
    """Decimal or 0x number as BIGINT, else null."""
    v = F.trim(value)
    hexa = F.conv(F.regexp_extract(v, "^0[xX]([0-9a-fA-F]+)$", 1), 16, 10).try_cast("bigint")
    return F.when(v.rlike("^0[xX][0-9a-fA-F]+$"), hexa).when(v.rlike(r"^[+-]?[0-9]+$"), v.try_cast("bigint"))


def config_line(symbol: Column, value: Column) -> Column:
    """Line of a merged config: n as comment, switches and numbers bare, else quoted."""
    bare = value.isin("y", "m") | value.rlike("^[0-9]+$") | value.startswith("0x")
    return (
        F.when(value == "n", F.concat(F.lit("# "), symbol, F.lit(" is not set")))
        .when(bare, F.concat(symbol, F.lit("="), value))
        .otherwise(F.concat(symbol, F.lit('="'), value, F.lit('"')))
    )


def proposal_line(symbol: Column, value: Column) -> Column:
    """Line of a fragment for a proposed value: a choice option named by its own symbol
    is switched on, numbers and quoted text stay as they are."""
    v = F.trim(value)
    own = F.regexp_replace(symbol, "^CONFIG_", "")
    bare = v.rlike("^-*[0-9]+$") | v.rlike("^0x[0-9a-fA-F]*$") | (v.startswith('"') & v.endswith('"'))
    return (
        F.when(v == own, F.concat(symbol, F.lit("=y")))
        .when(v == "n", F.concat(F.lit("# "), symbol, F.lit(" is not set")))
        .when(v.isin("y", "m") | bare, F.concat(symbol, F.lit("="), v))
        .otherwise(F.concat(symbol, F.lit('="'), v, F.lit('"')))
    )
