"""A Merkle manifest of a dataset: digests of rows, of runs of them, and a proof for each row.

Bottom-up build: the leaves of a source ascend by ``doc_id``; every ``fanout``
consecutive nodes of a level become one node of the next, whose digest is that of
their digests joined as hex text, while more than one remains. What remains of a
source, its subroot, is a leaf of a last tree whose leaves are ordered by source.
Each level is a table in the shared folder.

Top-down proof push: from the root down, children join their parent's row, and each
child prepends its siblings to the proof that the parent inherited. A row's proof is
then all that has to be hashed with its leaf to get to the root, and nothing has to
walk upwards row by row.

Positions come from a range partitioning and the sizes of the sources' parts in each
partition, so no source is sorted in one task. A join key is one parent, so at most
``fanout`` rows share it, whatever the size of a source. A proof has as many steps
as the logarithm of the number of rows; it is kept for nodes above the leaves, and
made for a leaf where it is used.

Defined results: null fields are ``-`` in a leaf, empty ones ``0:``; a null source is
a source of its own, before all others; null ids come first in their source; rows that
repeat an id are leaves each, ordered by their digest; an empty table has no root.
Other columns have no part in a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.text import ascii_lower, crc_mod
from lodestone.llm.workspace import hinted, materialise, settled, table

#: Columns that a leaf covers, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
#: A step of a proof: what stands left and right of the digest in its run.
STEPS = "array<struct<left: string, right: string>>"


def _told(value: Column) -> Column:
    """A value with its length before it, so that no two lists of values are told alike."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """Digest of a row's ``FIELDS``; ``changed`` replaces some of them."""
    return F.sha2(F.concat(*[_told(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf's level to the root's, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``idx``, the place in the order of their ``tree`` from 0, and ``n``, how many the tree has."""
    order = [F.col("tree").asc(), *order]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "placed")
    parts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    tree = Window.partitionBy("tree")  # a row a partition that holds some of the tree
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("tree", "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(tree).alias("n"))
    joined = placed.join(hinted(materialise(shifts, "shifts"), 96), ["tree", "part"])
    return joined.withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _levels(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """Tables of the levels above ``leaves``, which have ``tree, idx, n, digest``.

    Each has ``tree, idx, n, digest, kids``: the digests of the run below, and in n how
    many nodes the tree has on this level.
    """
    levels, below = [], leaves
    while (below.agg(F.max("n")).first()[0] or 0) > 1:
        up = F.floor(F.col("idx") / fanout).cast("long").alias("idx")
        run = below.where("n > 1").groupBy("tree", up, F.ceil(F.col("n") / fanout).cast("long").alias("n"))
        run = run.agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))  # fanout nodes at most
        kids = run.select("tree", "idx", "n", F.col("run.digest").alias("kids"))
        below = materialise(kids.withColumn("digest", F.sha2(F.array_join("kids", ""), 256)), "level")
        levels.append(below)
    return levels


def _step(kids: Column, at: Column) -> Column:
    left, right = F.slice(kids, F.lit(1), at), F.slice(kids, at + 2, F.size(kids))
    return F.array(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))


def _pushed(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The nodes of the lowest of ``levels``, each with ``proof`` and the columns that its tree has in ``tops``.

    ``tops`` has ``tree, proof`` and other columns; ``levels`` begin with the leaves.
    """
    handed = [c for c in tops.columns if c not in ("tree", "proof")]
    above = None
    for depth, level in reversed(list(enumerate(levels))):
        here = level.where("n = 1").join(tops, "tree")
        if above is not None:
            parent = above.select("tree", F.col("idx").alias("parent"), F.col("kids").alias("run"), F.col("proof").alias("inherited"), *handed)
            inner = level.where("n > 1").withColumn("parent", F.floor(F.col("idx") / fanout).cast("long")).join(parent, ["tree", "parent"])
            proof = F.concat(_step(F.col("run"), (F.col("idx") % fanout).cast("int")), F.col("inherited"))
            here = here.unionByName(inner.withColumn("proof", proof).drop("parent", "run", "inherited"))
        above = materialise(here, "pushed") if depth > 1 else here
    return above


@dataclass
class Manifest:
    """The tables of a build. ``levels[0]`` holds the leaves, ``top[0]`` the subroots; root is None without rows."""

    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    fanout: int = FANOUT


def build(leaves: DataFrame, fanout: int = FANOUT) -> Manifest:
    """The manifest of ``leaves``, with the columns ``doc_id, source, leaf``; other columns stay with their leaf."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))  # sorts as the source, null first
    named = leaves.withColumnRenamed("leaf", "digest").withColumn("tree", tree)
    base = materialise(_ranked(named, [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()]), "leaves")
    levels = [base, *_levels(base.select("tree", "idx", "n", "digest"), fanout)]
    ends = [level.where("n = 1").select(F.col("tree").alias("of"), "digest", F.lit("").alias("tree")) for level in levels]
    subroots = ends[0]
    for end in ends[1:]:
        subroots = subroots.unionByName(end)
    base = materialise(_ranked(subroots, [F.col("of").asc()]), "subroots")
    top = [base, *_levels(base.select("tree", "idx", "n", "digest"), fanout)]
    root = top[-1].select("digest").first()
    return Manifest(levels, top, root[0] if root else None, fanout)


def prove(manifest: Manifest) -> DataFrame:
    """The leaves with ``leaf, subroot, root, proof`` and their own columns; proof is an array of ``left, right``, from the leaf up."""
    spark = manifest.levels[0].sparkSession
    whole = spark.range(1).select(F.lit("").alias("tree"), F.expr(f"cast(array() as {STEPS})").alias("proof"))
    of_sources = _pushed(manifest.top, whole, manifest.fanout).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "proof")
    proofs = _pushed(manifest.levels, materialise(of_sources, "of_sources"), manifest.fanout)
    return proofs.withColumnRenamed("digest", "leaf").withColumn("root", F.lit(manifest.root)).drop("tree", "idx", "n")


def op11_merkle(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, and whether the proof holds after some texts were tampered with.

    A null id counts as an empty one where tampering is decided.
    """
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc_mod(F.col("doc_id"), 5) == 0, leaf_of(text=ascii_lower(F.col("text")))).otherwise(leaf_of())

    def whole() -> DataFrame:
        proofs = prove(build(docs.select("doc_id", "source", leaf_of().alias("leaf"), tampered.alias("found"))))
        folded = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), fold(F.col("found"), F.col("proof")).alias("folded_root"))
        return folded.withColumn("verified", F.col("folded_root") == F.col("root"))

    return settled(spark, "merkle", whole)


ORACLE = r"""
WITH RECURSIVE told AS (
  SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         -- one step for each bit of the id's bytes: the remainder of the cyclic code
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
           lambda acc, e: xor(xor(acc, e) >> 1, (xor(acc, e) & 1) * 3988292384))) % 5 = 0 AS changed
  FROM documents
), leaves AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || CASE WHEN changed THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS found FROM told
), placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), levels AS (
  SELECT tree, 0 AS lvl, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM levels WHERE n > 1 GROUP BY tree, lvl, idx // 16, n
), subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM levels WHERE n = 1
), top AS (
  SELECT 0 AS lvl, idx, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 16, n
), steps AS (
  SELECT a.tree, a.lvl, a.idx, string_agg(CASE WHEN b.idx < a.idx THEN b.digest ELSE '' END, '' ORDER BY b.idx) AS l, string_agg(CASE WHEN b.idx > a.idx THEN b.digest ELSE '' END, '' ORDER BY b.idx) AS r
  FROM levels a JOIN levels b ON a.tree = b.tree AND a.lvl = b.lvl AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY 1, 2, 3
), top_steps AS (
  SELECT a.lvl, a.idx, string_agg(CASE WHEN b.idx < a.idx THEN b.digest ELSE '' END, '' ORDER BY b.idx) AS l, string_agg(CASE WHEN b.idx > a.idx THEN b.digest ELSE '' END, '' ORDER BY b.idx) AS r
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY 1, 2
), walk AS (
  SELECT tree, idx AS row, 0 AS lvl, idx, found AS digest, '' AS proof, false AS over FROM placed
  UNION ALL
  SELECT w.tree, w.row, CASE WHEN NOT w.over AND s.l IS NULL THEN 0 ELSE w.lvl + 1 END, CASE WHEN w.over OR s.l IS NOT NULL THEN w.idx // 16 ELSE r.idx END,
         CASE WHEN w.over THEN sha256(t.l || w.digest || t.r) WHEN s.l IS NOT NULL THEN sha256(s.l || w.digest || s.r) ELSE w.digest END,
         w.proof || CASE WHEN w.over THEN t.l || t.r WHEN s.l IS NOT NULL THEN s.l || s.r ELSE '' END, w.over OR s.l IS NULL
  FROM walk w LEFT JOIN steps s ON NOT w.over AND s.tree = w.tree AND s.lvl = w.lvl AND s.idx = w.idx
       LEFT JOIN top_steps t ON w.over AND t.lvl = w.lvl AND t.idx = w.idx LEFT JOIN subroots r ON r.tree = w.tree
  WHERE NOT w.over OR t.l IS NOT NULL
), ends AS (SELECT tree, row, arg_max(digest, (over, lvl)) AS folded_root, sha256(arg_max(proof, (over, lvl))) AS proof_sha256 FROM walk GROUP BY tree, row
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM top WHERE n = 1) AS root, proof_sha256, folded_root, folded_root = (SELECT digest FROM top WHERE n = 1) AS verified
FROM placed p JOIN ends e ON e.tree = p.tree AND e.row = p.idx JOIN subroots s ON s.tree = p.tree
"""
