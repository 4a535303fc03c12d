"""URL filter: a trie over reversed host labels, then path segments, with the longest match.

A rule has a host, a path and a verdict, and fits its host and all subdomains where the
url's path starts with the rule's path. The walk goes down the labels from the right; at
every host with rules it walks the path's segments, the last piece of a rule's path being
a prefix of the next segment. The rule with most host labels and then the longest path
wins; of two rules for the same place, the blocking one. Urls without a rule get the
default verdict.

Tries are broadcast in blocks of at most ``block`` rules, a documented bound; with more
rules, every block is a pass over the narrow (id, url, best so far) rows.

Defined cases: a null url, or one without ``://``, has empty host and path and the default
verdict; repeated rows give repeated rows; an empty list of rules gives the default
everywhere; columns not named are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optlake.llm.common import fold, stored

#: In a node of hosts: the tree of paths. In a node of paths: rules by last piece.
PATHS, PREFIXES = "paths", "prefixes"
NO_RULE = (None,) * 5


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nested dicts over (host, path, verdict) rules."""
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(("label", label), {})
        node = node.setdefault(PATHS, {})
        *whole, piece = path.split("/")
        for segment in whole:
            node = node.setdefault(("segment", segment), {})
        rule = (len(host.split(".")), len(path), verdict == "block", host + path, verdict)
        prefixes = node.setdefault(PREFIXES, {})
        prefixes[piece] = max(prefixes.get(piece, rule), rule)
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple | None:
    """(labels, path length, blocks, rule, verdict) of the winning rule."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(("label", label))
        if node is None:
            break
        here = node.get(PATHS)
        for segment in path.split("/") if here else ():
            prefixes = here.get(PREFIXES)
            if prefixes:
                few = len(prefixes) <= len(segment)
                for piece in filter(segment.startswith, prefixes) if few else (segment[:n] for n in range(len(segment) + 1)):
                    rule = prefixes.get(piece)
                    if rule and (best is None or rule > best):
                        best = rule
            here = here.get(("segment", segment))
            if here is None:
                break
    return best


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(fold(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


BEST = "labels int, length int, blocks boolean, rule string, verdict string"


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", block: int = 500_000, id_col="page_id", url_col="url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    kind, blocks = dict(rows.dtypes)["page_id"], [rules[a : a + block] for a in range(0, len(rules), block)]
    for part in blocks:
        rows = _matched(rows, pages.sparkSession.sparkContext.broadcast(part), f"page_id {kind}, host string, path string, {BEST}")
        if len(blocks) > 1:
            rows = stored(rows)
    if not blocks:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _matched(rows: DataFrame, rules, schema: str) -> DataFrame:
    """``rows`` with the best of these rules and of those that they already carry."""
    earlier = "verdict" in rows.columns

    def run(batches):
        trie = build_trie(rules.value)
        for batch in batches:
            ids, *columns = batch.columns
            hosts, paths, *old = (c.to_pylist() for c in columns)
            best = [longest_match(trie, h, p) or NO_RULE for h, p in zip(hosts, paths)]
            if earlier:
                best = [max(b, o, key=lambda r: (r[0] or -1, r[1] or 0, r[2] or False)) for b, o in zip(best, zip(*old))]
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string())
            found = [pa.array(values, k) for values, k in zip(zip(*best) if best else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([ids, columns[0], columns[1], *found], names=["page_id", "host", "path", "labels", "length", "blocks", "rule", "verdict"])

    return rows.mapInArrow(run, schema)
