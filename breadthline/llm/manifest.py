"""Merkle manifest of a dataset, its levels built by sibling-shift self-joins.

Every row is a leaf; the leaves of one group ascend by id, and every run of `fanout` neighbours
becomes their hash until one node is left, the group's subroot. The subroots, ordered by group, go
the same way up to the root. A level is one table of nodes (tree, idx, size, digest). Each node
computes the index of its siblings (idx XOR 1 where runs are pairs, otherwise every slot of its run
but its own, by offset) and is equijoined with its level on it; the rows in slot zero, which then
hold the whole run, emit the parents. Going back down, each row takes over its parent's proof and
puts its own siblings in front. Both ways a level has at most half the rows of the one below it, and
no key of a join is more than one node, however large a group is.

The hash is lowercase hex sha256 over texts laid end to end, digests as hex.

Rows: one per document. A null field counts as `-`, an empty text as `0:`; a null group is a group of
its own and comes first. Null ids come first in their group; rows that repeat an id are leaves of
their own, in the order of their digests (equal rows in any order, which no result shows). Texts of
any length are hashed in place and never moved. Extra columns are left out, also those named like
the result's; an empty table gives an empty result. Native: SQL functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from breadthline.llm.common import partitions
from breadthline.session import land

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*[p.cast("string") for p in parts]).cast("binary"), 256)


def leaf_of(values: dict[str, Column]) -> Column:
    """Each field as its UTF-8 byte count, `:` and the value; `-` if it is null."""
    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value),
                          F.lit("-"))

    return digest_of(*[field(values[name]) for name in FIELDS])


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds `idx`, the place (from 0) within the group, and `size`, the group's rows.

    Rows are dealt by range of (group, order), so a large group lies in several partitions. The
    written table fixes each row's partition; the counts by partition and group, a few rows for each
    partition, say how many rows of the group came before it.
    """
    keys = [group, *order]
    dealt = land(
        rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
        .select(*rows.columns, F.spark_partition_id().alias("at_part"),
                F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at_row")), name)
    counts = dealt.groupBy("at_part", group).agg(
        F.count("*").alias("here"), F.min("at_row").alias("first_row"))
    of_group = W.Window.partitionBy(group)
    earlier = of_group.orderBy("at_part").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select(
        "at_part", group,
        (F.coalesce(F.sum("here").over(earlier), F.lit(0)) - F.col("first_row")).alias("shift"),
        F.sum("here").over(of_group).alias("size"))
    # The starts grow with partitions and groups: they are shuffled, never broadcast.
    return dealt.join(starts.hint("merge"), ["at_part", group]).select(
        *rows.columns, (F.col("shift") + F.col("at_row")).alias("idx"), "size")


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Adds `left` and `right`: the digests of a node's siblings before and after it, end to end."""
    if fanout == 2:
        targets = [F.col("idx").bitwiseXOR(1)]
    else:
        run = F.col("idx") - F.col("idx") % fanout
        targets = [run + (F.col("idx") + shift) % fanout for shift in range(1, fanout)]
    joined = nodes
    for number, target in enumerate(targets):
        others = nodes.select(F.col("tree").alias(f"tree{number}"), F.col("idx").alias(f"idx{number}"),
                              F.col("digest").alias(f"digest{number}"))
        joined = joined.withColumn(f"target{number}", target).join(
            others, (F.col("tree") == F.col(f"tree{number}"))
            & (F.col(f"target{number}") == F.col(f"idx{number}")), "left")

    def side(before: bool) -> Column:
        # The siblings of the slots before (after) this one, in the order of the slots.
        texts = []
        for slot in range(fanout):
            own = F.col("idx") % fanout
            wanted = (F.lit(slot) < own) if before else (F.lit(slot) > own)
            found = [F.when(wanted & (F.col(f"target{n}") % fanout == slot), F.col(f"digest{n}"))
                     for n in range(len(targets))]
            texts.append(F.coalesce(*found, F.lit("")))
        return F.concat(*texts)

    return joined.select(*nodes.columns, side(True).alias("left"), side(False).alias("right"))


@dataclass
class Forest:
    """levels: from the leaves up, each node with its siblings; a tree ends at the level where its
    size is one. roots: (tree, digest), one for each tree."""
    levels: list[DataFrame]
    roots: DataFrame
    fanout: int

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """The leaves with `subroot`, the digest of their tree's root, and `proof`, the siblings
        (left, right) of each level up to it; `above` (tree, proof) has the levels beyond it."""
        done = None
        for level in reversed(self.levels):
            kept = [c for c in level.columns if c not in ("size", "left", "right")]
            found = level.where(F.col("size") == 1).select(*kept, F.col("digest").alias("subroot"))
            if above is None:
                found = found.withColumn(
                    "proof", F.array().cast("array<struct<left:string,right:string>>"))
            else:
                found = found.join(above.select("tree", "proof"), "tree")
            if done is not None:
                parents = done.select(F.col("tree").alias("of"), F.col("idx").alias("parent"),
                                      "subroot", "proof")
                inner = level.where(F.col("size") > 1).join(
                    parents, (F.col("tree") == F.col("of"))
                    & (F.expr(f"idx div {self.fanout}") == F.col("parent")))
                found = inner.select(*kept, "subroot", F.concat(
                    F.array(F.struct("left", "right")), "proof").alias("proof")).unionByName(found)
            done = found
        return done


def grow(nodes: DataFrame, fanout: int, name: str) -> Forest:
    """All levels over `nodes` (tree, idx, size, digest, and columns that only the leaves keep).

    A level is written, because the next one and the proofs read it. Only the size of the largest
    tree, one number, goes to the driver.
    """
    largest = nodes.agg(F.max("size")).first()[0] or 0
    levels = [land(with_siblings(nodes, fanout), f"{name}-0")]
    while largest > 1:
        below = levels[-1]
        parents = below.where((F.col("size") > 1) & (F.col("idx") % fanout == 0)).select(
            "tree", F.expr(f"idx div {fanout}").alias("idx"),
            F.expr(f"(size + {fanout - 1}) div {fanout}").alias("size"),
            digest_of(F.col("digest"), F.col("right")).alias("digest"))
        levels.append(land(with_siblings(parents, fanout), f"{name}-{len(levels)}"))
        largest = -(-largest // fanout)
    roots = [level.where(F.col("size") == 1).select("tree", "digest") for level in levels]
    return Forest(levels, reduce(DataFrame.unionByName, roots), fanout)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its way up lead to."""
    return F.aggregate(proof, leaf, lambda own, at: digest_of(at["left"], own, at["right"]))


def build(docs: DataFrame, group: str = "lang", fanout: int = 2,
          checked: dict[str, Column] | None = None) -> tuple[DataFrame, str | None]:
    """Leaves with their proofs, and the root (None for an empty table).

    The rows have doc_id, tree (the group as text after `=`, empty for null), leaf, subroot, proof
    and checked: the leaf of the row with its fields replaced as `checked` says. Both leaves come
    from one reading of the text.
    """
    own = {name: F.col(name) for name in FIELDS}
    leaves = land(docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        leaf_of(own).alias("digest"),
        (leaf_of(own | checked) if checked else F.lit(None).cast("string")).alias("checked"),
        F.monotonically_increasing_id().alias("row")), "leaves")
    nodes = land(numbered(leaves, "tree", ["doc_id", "digest", "row"], "ordered-leaves"), "nodes")
    groups = grow(nodes.drop("row"), fanout, "groups")
    subroots = numbered(groups.roots.withColumn("all", F.lit("")), "all", ["tree"], "subroots")
    top = grow(land(subroots.select(F.col("tree").alias("member"), F.col("all").alias("tree"), "idx",
                                    "size", "digest"), "subroot-nodes"), fanout, "top")
    above = land(top.proofs().select(F.col("member").alias("tree"), "proof"), "above")
    rows = groups.proofs(above).select(
        "doc_id", "tree", F.col("digest").alias("leaf"), "checked", "subroot", "proof")
    root = top.roots.first()
    return rows, root["digest"] if root else None


def manifest(docs: DataFrame, fanout: int = 2, every: int = 7) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows whose id's crc32 is a multiple of `every` are checked with n_chars one larger (nulls stay,
    and null ids are not tampered with), all others as they are; `verified` says whether the leaf
    found then and the untouched siblings lead to the root.
    """
    tampered = F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    rows, root = build(docs, fanout=fanout, checked={
        "n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    siblings = F.array_join(
        F.transform("proof", lambda at: F.concat(at["left"], at["right"])), "")
    return rows.select(
        "doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"),
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        fold(F.col("checked"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, source: str) -> str:
    """CTEs over `source` (tree, idx, size, digest, checked): <name>_nodes has every node, and
    <name>_up every leaf's way to its root: subroot, siblings and the digest folded on the way."""
    return f"""
{name}_nodes(tree, height, idx, size, digest) AS (
    SELECT tree, 0, idx, size, digest FROM {source}
    UNION ALL
    SELECT tree, height + 1, idx // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
    FROM {name}_nodes WHERE size > 1 GROUP BY tree, height, idx // 2, (size + 1) // 2
),
{name}_way(tree, leaf, height, idx, folded, siblings) AS (
    SELECT tree, idx, 0, idx, checked, '' FROM {source}
    UNION ALL
    SELECT w.tree, w.leaf, w.height + 1, w.idx // 2,
           sha256(CASE WHEN w.idx % 2 = 0 THEN w.folded || coalesce(s.digest, '')
                       ELSE s.digest || w.folded END),
           w.siblings || coalesce(s.digest, '')
    FROM {name}_way w
    JOIN {name}_nodes n ON n.tree = w.tree AND n.height = w.height AND n.idx = w.idx AND n.size > 1
    LEFT JOIN {name}_nodes s
      ON s.tree = w.tree AND s.height = w.height AND s.idx = xor(w.idx, 1::BIGINT)
),
{name}_up AS (
    SELECT w.tree, w.leaf, w.folded, w.siblings, n.digest AS root
    FROM {name}_way w
    JOIN {name}_nodes n ON n.tree = w.tree AND n.height = w.height AND n.size = 1
)"""


def _leaf_sql(n_chars: str) -> str:
    def field(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    return "sha256(" + " || ".join(
        field(n_chars if name == "n_chars" else name) for name in FIELDS) + ")"


#: crc32 of the decimal id, bit by bit, lowest first.
_CRC = """xor(4294967295, list_reduce(
    [4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: list_transform(range(8), lambda k: (ascii(c)::BIGINT >> k::BIGINT) & 1))),
    lambda acc, b: xor(xor(acc, b) >> 1,
                       CASE WHEN xor(acc, b) & 1 = 1 THEN 3988292384 ELSE 0 END)))"""

SQL = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("n_chars")} AS digest,
           CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")}
                ELSE {_leaf_sql("n_chars")} END AS checked
    FROM documents
),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx,
           count(*) OVER (PARTITION BY tree) AS size
    FROM hashed
),{_tree_sql("lower", "leaves")},
subroots AS (
    SELECT '' AS tree, tree AS member, root AS digest, root AS checked,
           row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS size
    FROM (SELECT DISTINCT tree, root FROM lower_up)
),{_tree_sql("upper", "subroots")},
way(tree, leaf, height, idx, folded, siblings, member) AS (
    SELECT '', l.leaf, 0, s.idx, l.folded, l.siblings, l.tree
    FROM lower_up l JOIN subroots s ON s.member = l.tree
    UNION ALL
    SELECT w.tree, w.leaf, w.height + 1, w.idx // 2,
           sha256(CASE WHEN w.idx % 2 = 0 THEN w.folded || coalesce(s.digest, '')
                       ELSE s.digest || w.folded END),
           w.siblings || coalesce(s.digest, ''), w.member
    FROM way w
    JOIN upper_nodes n ON n.height = w.height AND n.idx = w.idx AND n.size > 1
    LEFT JOIN upper_nodes s ON s.height = w.height AND s.idx = xor(w.idx, 1::BIGINT)
),
tops AS (SELECT height, digest FROM upper_nodes WHERE size = 1)
SELECT l.doc_id, l.digest AS leaf, m.digest AS subroot, t.digest AS root,
       sha256(w.siblings) AS proof_sha256, w.folded AS folded_root, w.folded = t.digest AS verified
FROM leaves l
JOIN way w ON w.member = l.tree AND w.leaf = l.idx
JOIN tops t ON t.height = w.height
JOIN subroots m ON m.member = l.tree
"""
