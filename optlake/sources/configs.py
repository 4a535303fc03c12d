"""Option configurations: text to rows and rows to text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optlake.functions.values import config_line, strip_quotes


def read_texts(spark: SparkSession, path: str, key: str = "config_id") -> DataFrame:
    """Whole text files as ``(key, text)``; the key is the file path. For files of
    configuration size: one file is one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias(key), F.col("value").alias("text"))


def text_lines(texts: DataFrame) -> DataFrame:
    """Numbered lines: every column of ``texts`` but ``text``, plus ``line_no, line``."""
    keys = [c for c in texts.columns if c != "text"]
    body = F.regexp_replace("text", r"\r?\n\z", "")
    return texts.select(*keys, F.posexplode(F.split(body, r"\r?\n")).alias("pos", "line")).select(
        *keys, (F.col("pos") + 1).alias("line_no"), "line"
    )


def config_rows(texts: DataFrame, dialect: str = "positions") -> DataFrame:
    """Assignments of ``(…, text)`` rows as ``(…, line_no, symbol, value, kind)``.

    ``raw`` keeps set lines with quotes as written; ``values`` reads "is not set" as n
    and drops quotes; ``positions`` keeps every assignment and also non-comment lines it
    cannot read (kind ``unparsed``, the line in ``value``).
    """
    lines = text_lines(texts)
    keys = [c for c in lines.columns if c != "line"]
    line = F.col("line")
    bare = F.trim(line)
    set_re, unset_re = r"^(CONFIG_[A-Za-z0-9_]+)=(.*)$", r"^#\s*(CONFIG_[A-Za-z0-9_]+)\s+is not set"
    if dialect == "raw":
        hit = line.startswith("CONFIG_") & line.contains("=")
        return lines.where(hit).select(
            *keys, F.regexp_extract(line, "^([^=]*)=(.*)$", 1).alias("symbol"),
            F.regexp_extract(line, "^([^=]*)=(.*)$", 2).alias("value"), F.lit("set").alias("kind"),
        )
    unset = bare.rlike(unset_re if dialect == "values" else r"^#\s+CONFIG_[A-Za-z0-9_]+ is not set\s*$")
    if dialect == "values":
        assigned = ~bare.startswith("#") & bare.contains("=")
        return lines.where(unset | assigned).select(
            *keys,
            F.when(unset, F.regexp_extract(bare, unset_re, 1)).otherwise(F.trim(F.regexp_extract(bare, "^([^=]*)=(.*)$", 1))).alias("symbol"),
            F.when(unset, "n").otherwise(strip_quotes(F.regexp_extract(bare, "^([^=]*)=(.*)$", 2))).alias("value"),
            F.when(unset, "unset").otherwise("set").alias("kind"),
        )
    assigned = bare.rlike(set_re)
    return lines.where(assigned | unset | ((bare != "") & ~bare.startswith("#"))).select(
        *keys,
        F.when(assigned, F.regexp_extract(bare, set_re, 1)).when(unset, F.regexp_extract(bare, unset_re, 1)).alias("symbol"),
        F.when(assigned, F.trim(F.regexp_extract(bare, set_re, 2))).when(unset, "n").otherwise(line).alias("value"),
        F.when(assigned, "set").when(unset, "unset").otherwise("unparsed").alias("kind"),
    )


def rejected_lines(texts: DataFrame) -> DataFrame:
    """Lines that are neither blank, comment nor assignment, as ``(…, line_no, line,
    reason)``: the second output of ``config_rows``, in the same pass over the text."""
    rows = config_rows(texts).where("kind = 'unparsed'")
    bare, name = F.trim("value"), F.substring_index(F.trim("value"), "=", 1)
    reason = (
        F.when(~bare.contains("="), "no assignment")
        .when(~name.startswith("CONFIG_"), "no option prefix")
        .otherwise("bad option name")
    )
    return rows.withColumn("reason", reason).withColumnRenamed("value", "line").drop("symbol", "kind")


def fragment_rows(texts: DataFrame) -> DataFrame:
    """Change fragments as ``(…, line_no, kind, symbol, value)``: header, disable, assign."""
    lines = text_lines(texts)
    keys = [c for c in lines.columns if c != "line"]
    s = F.rtrim("line")
    off, on = r"^#\s*(CONFIG_[A-Z0-9_]+)\s+is not set\s*$", r"^(CONFIG_[A-Z0-9_]+)=(.*)$"
    kind = F.when(s.rlike(off), "disable").when(s.startswith("#"), "header").when(s.rlike(on), "assign")
    return lines.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        *keys, "kind",
        F.when(F.col("kind") == "disable", F.regexp_extract(s, off, 1)).when(F.col("kind") == "assign", F.regexp_extract(s, on, 1)).alias("symbol"),
        F.when(F.col("kind") == "disable", "n")
        .when(F.col("kind") == "assign", F.regexp_replace(F.trim(F.regexp_extract(s, on, 2)), '^"+|"+$', ""))
        .otherwise(s)
        .alias("value"),
    )


def fragment_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Effective fragment: assignments beat disables, the last assignment of a symbol wins."""
    rank = F.struct((F.col("kind") == "assign").alias("a"), "line_no")
    return rows.where("kind <> 'header'").groupBy(*keys, "symbol").agg(F.max_by("value", rank).alias("value"))


def config_texts(values: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """One text per configuration; a configuration is bounded by the option count of its
    tree, so its lines fit one row."""
    line = config_line(F.col("symbol"), F.col("value"))
    return values.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("text")
    )


def write_config_texts(texts: DataFrame, path: str, partition: str | None = None) -> None:
    """JSON lines of ``(keys, text)``; one file per configuration would not scale."""
    writer = texts.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).json(path)
