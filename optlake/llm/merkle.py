"""A Merkle manifest of a dataset, and proofs by a recursive climb.

Every row is a leaf: the hash of its fields, each with its length. The leaves of a group
ascend by key; while a group has several nodes, every ``FAN`` consecutive ones become the hash of
their digests. What remains is the group's subroot, and the subroots are hashed likewise
up to the root. Levels are built one by one, each from the one below by one grouping, and
stored as link rows: a node's place, its parent's place, and the digests before and after
it in its run. Digests of 64 letters are kept as 32 bytes and hashed as letters.

Proofs come from one recursive query: every leaf ascends over the links, appends the
siblings it meets and folds its claimed digest with them up to the root. The leaves of a
run share their path, so they climb in one row that holds a fold for each and the common
siblings once. A node above very many leaves has its link row in as many salted copies as
keep the rows that meet one copy below ``SHARE``; all copies together are fewer than one
in ``SHARE`` leaves a level, besides the nodes.

Positions come from a range sort and one count per task; no group, level or proof
passes through one task or the driver, only the counts of levels and the root do.

Defined cases: a null field is "-"; null groups and null keys come first; rows of equal key
follow their leaf; repeated rows are leaves of their own; a lone leaf is its group's subroot
and a lone subroot the root, and what has no siblings folds to itself; empty and very long
texts are hashed like any other; an empty table gives an empty one; columns not named, and
columns named like those made here, are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optlake.llm.common import bucket_of, fold, numbered, stored
from optlake.session import Rounds

FAN = 8
#: Rows of a climb that meet one copy of a link, about.
SHARE = 4096
#: The tree of subroots; groups are trees from 0 on.
TOP = -1

LINKS = "tree long, level int, pos long, salt long, before binary, after binary, p_tree long, p_level int, p_pos long, p_salts long"

CLIMB = """
WITH RECURSIVE climb(tree, run, a_tree, a_level, a_pos, a_salt, folds, siblings) AS (
  SELECT tree, run, a_tree, a_level, a_pos, pmod(run, a_salts), folds, X'' FROM {starts}
  UNION ALL
  SELECT c.tree, c.run, l.p_tree, l.p_level, l.p_pos, pmod(c.run, l.p_salts),
         transform(c.folds, f -> unhex(sha2(lower(hex(concat(l.before, f, l.after))), 256))),
         concat(c.siblings, l.before, l.after)
  FROM climb c JOIN {links} l
  ON c.a_tree = l.tree AND c.a_level = l.level AND c.a_pos = l.pos AND c.a_salt = l.salt
)
SELECT tree, run, folds, siblings FROM climb WHERE a_tree = {top} AND a_level = {height}
"""


def letters(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def hashed(digests: Column) -> Column:
    """Hash of concatenated digests, written as letters."""
    return F.unhex(F.sha2(letters(digests), 256))


def leaf_of(*fields: Column) -> Column:
    """Digest of a row's fields, each with its length in bytes."""
    text = lambda f: f.cast("string")
    parts = [F.coalesce(F.concat(F.octet_length(text(f)).cast("string"), F.lit(":"), text(f)), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def joined(digests: Column) -> Column:
    """Digests one after another, as bytes; none give no bytes."""
    return F.unhex(F.array_join(F.transform(digests, F.hex), ""))


def _salts(weight: Column) -> Column:
    return F.ceil(weight / SHARE).cast("long")


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, pos, digest, weight, count) as runs of siblings with their parent's
    digest and weight."""
    runs = nodes.groupBy("tree", F.expr(f"pos div {FAN}").alias("run"), "count").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "weight"))).alias("members"), F.sum("weight").alias("weight")
    )
    return stored(runs.withColumn("digest", hashed(joined(F.col("members.digest")))))


def _parent(level: int, tree: Column, run: Column, count: Column) -> list[Column]:
    """Place above a run of nodes of ``level``: the only node of a group's level is a node
    of the tree of subroots."""
    over = (count <= FAN) & (tree != TOP)
    return [F.when(over, TOP).otherwise(tree).cast("long").alias("p_tree"), F.when(over, 0).otherwise(level + 1).alias("p_level"), F.when(over, tree).otherwise(run).alias("p_pos")]


def _links(runs: DataFrame, level: int) -> DataFrame:
    each = runs.select("tree", "run", "count", "members.digest", "weight", F.posexplode("members").alias("i", "member"))
    side = lambda start, n: joined(F.slice("digest", start, n))
    salts = F.sequence(F.lit(0).cast("long"), _salts(F.col("member.weight")) - 1)
    return each.select(
        "tree",
        F.lit(level).alias("level"),
        F.col("member.pos").alias("pos"),
        F.explode(salts).alias("salt"),
        side(F.lit(1), F.col("i")).alias("before"),
        side(F.col("i") + 2, F.lit(FAN)).alias("after"),
        *_parent(level, F.col("tree"), F.col("run"), F.col("count")),
        _salts(F.col("weight")).alias("p_salts"),
    )


class Manifest:
    """Stored levels of a dataset: ``runs`` of leaves, ``links`` of all nodes above them,
    ``subroots`` and the root's digest and height."""

    def __init__(self, leaves: DataFrame):
        """``leaves`` are rows (key, group, leaf, ...); further columns stay with them."""
        spark = leaves.sparkSession
        others = [c for c in leaves.columns if c not in ("key", "group", "leaf")]
        salted = stored(leaves.withColumn("_salt", F.monotonically_increasing_id()))
        ordered = numbered(salted, F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("_salt"))
        groups = ordered.groupBy("group").agg(F.min("rank").alias("first"), F.count("*").alias("count"))
        groups = stored(numbered(groups, F.col("group").asc_nulls_first()).select(F.col("group").alias("_group"), F.col("rank").alias("tree"), "first", "count"))
        placed = ordered.join(groups, F.col("group").eqNullSafe(F.col("_group"))).withColumn("pos", F.col("rank") - F.col("first"))
        members = F.array_sort(F.collect_list(F.struct("pos", "key", "leaf", *others))).alias("members")
        self.runs = stored(placed.groupBy("tree", "count", F.expr(f"pos div {FAN}").alias("run")).agg(members))
        sizes = groups.agg(F.max("count"), F.count("*")).first()
        self._links, tops = Rounds(spark, LINKS), Rounds(spark, "tree long, digest binary, weight long")

        first = self.runs.withColumn("weight", F.size("members").cast("long"))
        lone = F.col("count") == 1
        tops.add(0, first.where(lone).select("tree", F.col("members")[0]["leaf"].alias("digest"), "weight"))
        nodes = first.where(~lone).select("tree", F.col("run").alias("pos"), hashed(joined(F.col("members.leaf"))).alias("digest"), "weight", F.expr(f"(count + {FAN - 1}) div {FAN}").alias("count"))
        nodes, most, level = stored(nodes), sizes[0] or 0, 1
        while most > 1:
            tops.add(level, nodes.where("count = 1").select("tree", "digest", "weight"))
            most = -(-most // FAN)
            nodes = self._grow(nodes.where("count > 1"), level) if most > 1 else nodes
            level += 1
        self.subroots = stored(tops.read("_level").drop("_level"))
        nodes = self.subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", "weight", F.lit(sizes[1]).cast("long").alias("count"))
        self.height, most = 0, sizes[1]
        while most > 1:
            nodes = self._grow(nodes, self.height)
            self.height, most = self.height + 1, -(-most // FAN)
        found = nodes.select(letters(F.col("digest"))).first()
        self.root = found[0] if found else None

    def _grow(self, nodes: DataFrame, level: int) -> DataFrame:
        """Store the links of one level; the nodes of the next."""
        runs = _runs(nodes)
        self._links.add(self._links.last + 1, _links(runs, level))
        return runs.select("tree", F.col("run").alias("pos"), "digest", "weight", F.expr(f"(count + {FAN - 1}) div {FAN}").alias("count"))

    def climb(self, claimed: str) -> DataFrame:
        """(tree, run, folds, siblings): for every run of leaves, the digest each leaf's
        column ``claimed`` folds to at the root, and the siblings above the run."""
        spark = self.runs.sparkSession
        own = F.transform("members", lambda m, i: hashed(joined(F.transform("members", lambda o, k: F.when(k == i, o[claimed]).otherwise(o["leaf"])))))
        folds = F.when(F.col("count") == 1, F.col(f"members.{claimed}")).otherwise(own)
        parents = [F.when(F.col("count") == 1, a).otherwise(b) for a, b in zip((F.lit(TOP), F.lit(0), F.col("tree")), _parent(0, F.col("tree"), F.col("run"), F.col("count")))]
        names, kinds = ("a_tree", "a_level", "a_pos"), ("long", "int", "long")
        above = [p.cast(kind).alias(name) for p, name, kind in zip(parents, names, kinds)]
        weights = self.subroots.select(F.col("tree").alias("_tree"), "weight")
        starts = self.runs.join(weights, F.col("tree") == F.col("_tree")).select("tree", "run", *above, _salts(F.when(F.col("count") <= FAN, F.col("weight")).otherwise(FAN)).alias("a_salts"), folds.alias("folds"))
        names = {n: f"{n}_{uuid.uuid4().hex}" for n in ("starts", "links")}
        stored(starts).createOrReplaceTempView(names["starts"])
        self._links.read("_round").drop("_round").createOrReplaceTempView(names["links"])
        limit = "spark.sql.cteRecursionRowLimit"
        before = spark.conf.get(limit)
        spark.conf.set(limit, "-1")
        try:
            return stored(spark.sql(CLIMB.format(**names, top=TOP, height=self.height)))
        finally:
            spark.conf.set(limit, before)
            for name in names.values():
                spark.catalog.dropTempView(name)


def prove(leaves: DataFrame, claimed: str) -> DataFrame:
    """(key, leaf, subroot, root, proof, folded) of every row of ``leaves`` (key, group,
    leaf, claimed): its digests, its siblings up to the root as letters, and what its
    claimed digest folds to."""
    manifest = Manifest(leaves)
    climbed = manifest.climb(claimed).withColumnRenamed("tree", "_tree").withColumnRenamed("run", "_run")
    tops = manifest.subroots.select(F.col("tree").alias("_top"), letters(F.col("digest")).alias("subroot"))
    rows = manifest.runs.join(climbed, (F.col("tree") == F.col("_tree")) & (F.col("run") == F.col("_run"))).join(tops, F.col("tree") == F.col("_top"))
    each = rows.select("subroot", "siblings", "folds", F.col("members.leaf").alias("digests"), F.posexplode("members").alias("i", "member"))
    others = F.concat(joined(F.slice("digests", F.lit(1), F.col("i"))), joined(F.slice("digests", F.col("i") + 2, F.lit(FAN))))
    return each.select(
        F.col("member.key").alias("key"),
        letters(F.col("member.leaf")).alias("leaf"),
        "subroot",
        F.lit(manifest.root).cast("string").alias("root"),
        letters(F.concat(others, "siblings")).alias("proof"),
        letters(F.expr("folds[i]")).alias("folded"),
    )


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, and for every document whether its proof holds where the
    letters of every third text were lower-cased."""
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    changed = F.when(bucket_of(F.col("doc_id"), 3) == 0, fold(F.col("text"))).otherwise(F.col("text"))
    leaves = docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("group"), leaf_of(*fields(F.col("text"))).alias("leaf"), leaf_of(*fields(changed)).alias("claimed"))
    return prove(leaves, "claimed").select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2("proof", 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
