"""Registered queries of the operators, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optlake.llm import bpe, conversations, decontaminate, lines, merkle, mixing, quality, rules, sharding, simhash, tokens, toxicity, urls
from optlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
binned AS (
  SELECT *, ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '-') || '|' || coalesce(source, '-') || '|' || size::VARCHAR), 1, 8))::BIGINT % 4096 AS bin,
         count(*) OVER (PARTITION BY doc_id, source, size) AS n, row_number() OVER (PARTITION BY doc_id, source, size) AS number FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_size * 2 / weight, source) AS n FROM sources),
levels AS (
  SELECT o.*, ((SELECT sum(source_size)::DOUBLE * 1.5 FROM sources) - coalesce((SELECT sum(source_size * 2)::DOUBLE FROM ordered p WHERE p.n < o.n), 0.0))
              / (SELECT sum(weight) FROM ordered p WHERE p.n >= o.n) AS level
  FROM ordered o),
level AS (SELECT min_by(level, n) AS level FROM levels WHERE weight * level <= source_size * 2),
targets AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, weight * coalesce((SELECT level FROM level), 1e300)) AS target FROM sources),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
bins AS (
  SELECT source, bin, sum(size)::BIGINT AS words FROM binned GROUP BY ALL),
filled AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bin) - words / 2::DOUBLE AS middle FROM bins),
cuts AS (
  SELECT p.source, p.source_size, p.target, p.whole,
         coalesce(max(CASE WHEN middle <= target - whole * source_size AND (target - whole * source_size > 0 OR source_size = 0) THEN bin + 1 END), 0) AS cut,
         min(CASE WHEN middle + words / 2::DOUBLE > target - whole * source_size THEN bin END) AS edge,
         min_by((target - whole * source_size - (middle - words / 2::DOUBLE)) / words, bin) FILTER (middle + words / 2::DOUBLE > target - whole * source_size) AS share
  FROM plan p LEFT JOIN filled f ON p.source IS NOT DISTINCT FROM f.source GROUP BY ALL),
taken AS (
  SELECT b.*, source_size, target, whole + CASE WHEN CASE WHEN bin = edge AND n > 1 THEN number <= floor(n * share + 0.5) ELSE bin < cut END THEN 1 ELSE 0 END AS copies
  FROM binned b JOIN cuts c ON b.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, size, source_size, target, copies, (size * copies)::BIGINT AS taken FROM taken
"""


@query("op1_mix_sources", MIX_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Words each document gives to a mix of 150% of all words, weights 5, 2, 1 repeating."""
    return mixing.mix_sizes(table(spark, folder, "documents"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document for quality, learnt from labels outside the held-out third."""
    return quality.classify_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_simhash_near_duplicates")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document; fingerprints link at 4 bits or fewer."""
    return simhash.near_duplicates(table(spark, folder, "documents"), radius=4, width=4)


LEAK_SQL = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS n, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
patterns AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, least(len(w), 10) AS m, array_to_string(w[i : i + 9], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM patterns),
spots AS (
  SELECT n, i, m, array_to_string(w[i : i + m - 1], ' ') AS p
  FROM (SELECT n, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, lengths WHERE len(w) >= m)),
hits AS (SELECT n, i, s.m, item FROM spots s JOIN patterns p ON s.m = p.m AND s.p = p.p),
covered AS (
  SELECT n, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT n, unnest(range(i, i + m)) AS x FROM (SELECT DISTINCT n, i, m FROM hits)) GROUP BY n),
named AS (
  SELECT n, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item FROM hits) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc_words LEFT JOIN covered USING (n) LEFT JOIN named USING (n)
"""


@query("op4_benchmark_contamination", LEAK_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside windows of ten benchmark words, and their items."""
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), width=10)


@query("op5_shard_by_splitters")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard and slot in 8 shards of near equal bytes."""
    return sharding.shard_sizes(table(spark, folder, "documents"), shards=8)


@query("op6_line_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every line of every document, and whether it is the one that stays."""
    return lines.mark_lines(table(spark, folder, "documents"))


#: (host, path, verdict), as the query's rules are given.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

URL_SQL = r"""
WITH parsed AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parsed),
rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT s.page_id, s.host, s.path, max_by(r.host || r.path, length(r.host) * 1000 + length(r.path)) AS rule,
         max_by(r.verdict, length(r.host) * 1000 + length(r.path)) AS verdict
  FROM (SELECT DISTINCT * FROM split) s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  GROUP BY ALL)
SELECT s.page_id, s.host, s.path, rule, coalesce(verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON s.page_id IS NOT DISTINCT FROM f.page_id AND s.host = f.host AND s.path = f.path
"""


@query("op7_url_filter", URL_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page's url."""
    return urls.judge_urls(table(spark, folder, "pages"), URL_RULES, default="allow")


@query("op9_token_counts")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document under the public 50k byte-level vocabulary."""
    import public_tokenizers

    return tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query("op8_quality_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Plain counts of every document, its log-likelihood ratio, and whether it is kept."""
    return rules.judge_quality(table(spark, folder, "documents"))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document for toxicity, learnt from labels outside the held-out fifth."""
    return toxicity.classify_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


#: CRC-32 of an ASCII text, for the checks: a table of 256 steps, then one step a letter.
CRC_SQL = r"""
bits AS (
  SELECT i AS n, 0 AS k, i AS c FROM range(256) r(i)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS steps FROM bits WHERE k = 8),
"""


def crc_sql(text: str) -> str:
    """SQL of the CRC-32 of an ASCII text beside ``crc_table``."""
    letters = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


MANIFEST_SQL = (
    "WITH RECURSIVE" + CRC_SQL + r"""
changed AS (
  SELECT *, CASE WHEN """
    + crc_sql("doc_id::VARCHAR")
    + r""" % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS new_text
  FROM documents, crc_table),
leaves AS (
  SELECT doc_id, lang,
         sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || coalesce(strlen(new_text) || ':' || new_text, '-')) AS claimed
  FROM changed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM leaves),
levels AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 7) // 8) FROM levels WHERE n > 1 GROUP BY tree, level, pos // 8),
subroots AS (SELECT tree, digest, count(*) OVER () AS trees FROM levels WHERE n = 1),
tops AS (
  SELECT 0 AS level, tree AS pos, digest, trees AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 7) // 8) FROM tops WHERE n > 1 GROUP BY level, pos // 8),
nodes AS (
  SELECT tree, level, pos, digest, n FROM levels WHERE n > 1 UNION ALL SELECT -1, level, pos, digest, n FROM tops WHERE n > 1),
sides AS (
  SELECT a.tree, a.level, a.pos, a.n, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS behind
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 GROUP BY a.tree, a.level, a.pos, a.n),
climb AS (
  SELECT tree AS own, pos AS leaf_pos, CASE WHEN n = 1 THEN -1 ELSE tree END AS tree, 0 AS level, CASE WHEN n = 1 THEN tree ELSE pos END AS pos, claimed AS folded, '' AS siblings, 0 AS steps FROM placed
  UNION ALL
  SELECT own, leaf_pos, CASE WHEN s.n <= 8 THEN -1 ELSE s.tree END, CASE WHEN s.n <= 8 AND s.tree >= 0 THEN 0 ELSE s.level + 1 END, CASE WHEN s.n <= 8 AND s.tree >= 0 THEN s.tree ELSE s.pos // 8 END,
         sha256(before || folded || behind), siblings || before || behind, steps + 1
  FROM climb c JOIN sides s ON c.tree = s.tree AND c.level = s.level AND c.pos = s.pos),
finished AS (SELECT own, leaf_pos, max_by(folded, steps) AS folded, max_by(siblings, steps) AS siblings FROM climb GROUP BY own, leaf_pos),
root AS (SELECT digest AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, s.digest AS subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed p JOIN finished f ON f.own = p.tree AND f.leaf_pos = p.pos JOIN subroots s ON s.tree = p.tree, root
""")


@query("op11_merkle_manifest", MANIFEST_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, proof and roots, and whether it still verifies where tampered."""
    return merkle.tampered_manifest(table(spark, folder, "documents"))


REPAIR_SQL = (
    "WITH RECURSIVE" + CRC_SQL + r"""
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, """
    + crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    + r""" % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE kind <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS said,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS cut
  FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
         CASE WHEN cut = '' THEN 'b' WHEN said > 1 THEN 'd' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault
  FROM ordered),
counts AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count_if(fault = 'b')::BIGINT AS blank, count_if(fault = 'd')::BIGINT AS duplicate, count_if(fault = 't')::BIGINT AS truncated,
         count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM marked GROUP BY conv_id),
step(place, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
grow(place, after, cost, audit) AS (
  VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
best AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS place, {'cost': 0, 'audit': ''} AS found FROM counts
  UNION ALL
  SELECT conv_id, n, place, min(found) FROM (
    SELECT m.conv_id, m.n, moves.place, {'cost': b.found.cost + g.cost + moves.cost + CASE WHEN m.fault = 't' AND moves.letter <> 'D' THEN 3 ELSE 0 END, 'audit': b.found.audit || g.audit || moves.letter} AS found
    FROM best b JOIN grow g ON g.place = b.place
    JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.n = b.n + 1
    JOIN (SELECT place AS from_place, '*' AS initial, place, 4 AS cost, 'D' AS letter FROM (VALUES (0), (1), (2), (3)) p(place)
          UNION ALL SELECT place, initial, after, 0, 'K' FROM step
          UNION ALL SELECT place, '*', after, 3, 'R' FROM step WHERE initial <> 's') moves ON moves.from_place = g.after AND (moves.initial = '*' OR moves.initial = m.initial) AND (moves.letter = 'D' OR m.fault IN ('t', '-')))
  GROUP BY conv_id, n, place),
chosen AS (
  SELECT b.conv_id, min({'cost': b.found.cost + g.cost, 'audit': b.found.audit || g.audit}) AS found
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.rows = b.n
  JOIN grow g ON g.place = b.place AND g.after IN (0, 3) GROUP BY b.conv_id),
letters AS (
  SELECT conv_id, found.audit AS audit, unnest(range(1, length(found.audit) + 1)) AS pos FROM chosen),
placed AS (
  SELECT conv_id, pos, audit[pos] AS letter, length(replace(audit[1:pos], 'I', '')) AS n, length(replace(audit[1:pos], 'D', '')) AS spot, length(replace(audit, 'D', '')) AS size
  FROM letters),
repaired AS (
  SELECT p.conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN m.role ELSE CASE WHEN (spot - size % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END END
         || ':' || CASE letter WHEN 'I' THEN '' ELSE m.text END, chr(10) ORDER BY pos)) AS digest
  FROM placed p LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.n = p.n
  WHERE letter <> 'D' GROUP BY p.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(found.cost, 0)::BIGINT AS cost, coalesce(found.audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
""")


@query("op12_conversation_repair", REPAIR_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair and the repaired rows' hash."""
    return conversations.repair_conversations(conversations.damage(table(spark, folder, "conversations")))


@query("op13_byte_bpe")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document under the public 50k ranks, and what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_documents(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode_documents(encoded, path))
