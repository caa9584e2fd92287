"""Merkle manifest of a table: one tree per group, and one tree over the groups' subroots.

Rows are leaves, ordered by id within their group; every ``FAN`` consecutive nodes become the SHA-256
of their concatenated hex digests, until one is left. Nodes are kept as strings, not as rows: an
aligned block of ``FAN ** LEVELS`` nodes holds each of its levels as one hex string, the parents are
hashes of its fixed-width substrings, and the siblings of a node are the two substrings beside it in
its run. What a block is reduced to is a node of the next stage, which is cut into blocks again, until
each tree has one block. (The hex strings are held as bytes, so that a substring costs its own length.)

A row's place in its group comes from a range partitioning by group and id: rows are numbered within
partitions, and the partitions' counts are summed, so a group of any size is never in one task. Only
digests are shuffled, texts are read once.

Defined results: a null is ``-`` in the leaf and any other value its UTF-8 length, a colon and its
text; null ids come first; rows of one id are ordered by their leaf (equal rows have equal leaves and
are interchangeable); the null group is a group and comes first; an altered leaf is folded like any
other; an empty table has no rows and no root; other columns are ignored and cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerfield.llm.tables import table, written

FAN, LEVELS, DIGEST = 8, 3, 64
PATH = "array<struct<left: binary, right: binary>>"


def encoded(value: Column) -> Column:
    """A value so that no two rows of values are encoded alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def ranked(spark: SparkSession, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows (tree, ...) with ``rank`` from 0 in the tree by ``order``, and the tree's size ``n``."""
    placed = written(spark, rows.repartitionByRange("tree", *order).sortWithinPartitions(
        "tree", *order).withColumn("at", F.monotonically_increasing_id()).withColumn(
        "part", F.shiftright("at", 33)), "ranked")
    parts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    # One row for each partition that holds rows of the tree.
    tree = Window.partitionBy("tree")
    before = F.sum("m").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = written(spark, parts.select(
        "tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"),
        F.sum("m").over(tree).alias("n")), "parts")
    return placed.join(parts, ["tree", "part"]).withColumn(
        "rank", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def blocks_of(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """(tree, block, n, members, depth, level0.., top) of nodes (tree, rank, n, digest, payload).

    A block of a tree with further blocks is hashed ``levels`` times, the only one until one node is left.
    """
    size, step = fan ** levels, fan * DIGEST
    out = nodes.groupBy("tree", F.expr(f"rank div {size}").alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(
            F.pmod("rank", F.lit(size)).cast("int").alias("at"), "digest", "payload"))).alias("members"))
    depth = F.lit(0)
    for j in range(levels):
        depth = F.when(F.col("n") > fan ** j, F.lit(j + 1)).otherwise(depth)
    out = out.withColumn("depth", depth).withColumn("level0", F.array_join(
        F.transform("members", lambda m: m["digest"]), "").cast("binary"))
    for j in range(levels):
        level = F.col(f"level{j}")
        last = F.ceil(F.octet_length(level) / F.lit(step)).cast("int") - 1
        parents = F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(
            F.substr(level, i * step + 1, F.lit(step)), 256)), "").cast("binary")
        out = out.withColumn(f"level{j + 1}", F.when(F.col("depth") > j, parents))
    top = reduce(lambda rest, j: F.when(F.col("depth") == j, F.col(f"level{j}")).otherwise(rest),
                 range(levels), F.col(f"level{levels}"))
    return out.select("tree", "block", "n", "depth", F.transform(
        "members", lambda m: F.struct(m["at"].alias("at"), m["payload"].alias("payload"))).alias("members"),
        *[f"level{j}" for j in range(levels)], top.alias("top"))


def climb(spark: SparkSession, nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """The blocks of each stage; the tops of one stage are the nodes of the next."""
    size, stages = fan ** levels, []
    while True:
        blocks = written(spark, blocks_of(nodes, fan, levels), "blocks")
        stages.append(blocks)
        open_trees = blocks.where(F.col("n") > size)
        if open_trees.isEmpty():
            return stages
        nodes = open_trees.select(
            "tree", F.col("block").alias("rank"), F.expr(f"(n + {size - 1}) div {size}").alias("n"),
            F.col("top").cast("string").alias("digest"), F.lit(None).cast("int").alias("payload"))


def tops(stages: list[DataFrame], size: int) -> DataFrame:
    """(tree, top) of each tree: what its only block in some stage is reduced to."""
    return reduce(DataFrame.unionByName, [
        s.where(F.col("n") <= size).select("tree", F.col("top").cast("string").alias("top"))
        for s in stages])


def siblings(fan: int, levels: int) -> Column:
    """The path of the member at ``at``: what stands left and right of it in its run, per level."""
    steps = []
    for j in range(levels):
        place = F.expr(f"at div {fan ** j}").cast("int")
        own = F.pmod(place, F.lit(fan))
        level = F.col(f"level{j}")
        steps.append(F.struct(
            F.substr(level, (place - own) * DIGEST + 1, own * DIGEST).alias("left"),
            F.substr(level, (place + 1) * DIGEST + 1, (fan - 1 - own) * DIGEST).alias("right")))
    return F.slice(F.array(*steps), F.lit(1), F.col("depth"))


def descend(stages: list[DataFrame], crowns: DataFrame, fan: int, levels: int) -> DataFrame:
    """(tree, rank, digest, payload, path, crown) of the nodes of the first stage.

    ``crowns`` (tree, path, crown) says how the tree's own top goes on, and what else is known of it.
    Every join is of a block with its one row above.
    """
    size, above = fan ** levels, None
    for blocks in reversed(stages):
        rows = blocks.where(F.col("n") <= size).join(crowns, "tree")
        if above is not None:
            rows = rows.unionByName(blocks.where(F.col("n") > size).join(above, ["tree", "block"]))
        each = rows.withColumn("member", F.explode("members")).withColumns(
            {"at": F.col("member.at"), "payload": F.col("member.payload")})
        out = each.select(
            "tree", (F.col("block") * size + F.col("at")).alias("rank"), "payload", "crown",
            F.substr("level0", F.col("at") * DIGEST + 1, F.lit(DIGEST)).cast("string").alias("digest"),
            F.concat(siblings(fan, levels), F.col("path")).alias("path"))
        above = out.select("tree", F.col("rank").alias("block"), "path", "crown")
    return out


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, digest.cast("binary"), lambda node, step: F.sha2(
        F.concat(step["left"], node, step["right"]), 256).cast("binary")).cast("string")


def joined(path: Column) -> Column:
    """All siblings of a path as one string of hex digits."""
    return F.aggregate(path, F.lit("").cast("binary"), lambda s, step: F.concat(
        s, step["left"], step["right"])).cast("string")


@dataclass
class Manifest:
    """The levels of all trees, as written tables."""

    groups: list[DataFrame]
    crown: list[DataFrame]
    fan: int
    levels: int

    def subroots(self) -> DataFrame:
        """(group, subroot); the null group is null."""
        return tops(self.groups, self.fan ** self.levels).select(
            _group(F.col("tree")).alias("group"), F.col("top").alias("subroot"))

    def root(self) -> DataFrame:
        """(root), no row for an empty table."""
        return tops(self.crown, self.fan ** self.levels).select(F.col("top").alias("root"))

    def proofs(self) -> DataFrame:
        """(group, rank, id, leaf, altered, path, subroot, root) of each row."""
        size = self.fan ** self.levels
        root = tops(self.crown, size).select(
            "tree", F.array().cast(PATH).alias("path"), F.col("top").alias("crown"))
        tree_of = descend(self.crown, root, self.fan, self.levels)
        crowns = tree_of.select(
            F.col("payload").alias("tree"), "path",
            F.struct(F.col("digest").alias("subroot"), F.col("crown").alias("root")).alias("crown"))
        rows = descend(self.groups, crowns, self.fan, self.levels)
        return rows.select(_group(F.col("tree")).alias("group"), "rank", "payload.id",
                           F.col("digest").alias("leaf"), "payload.altered", "path", "crown.*")


def _group(tree: Column) -> Column:
    return F.when(tree != "0", F.substr(tree, F.lit(2)))


def manifest(spark: SparkSession, df: DataFrame, columns: Sequence[str], group_col: str,
             id_col: str, altered: dict[str, Column] | None = None, when: Column | None = None,
             fan: int = FAN, levels: int = LEVELS) -> Manifest:
    """The manifest of the rows; a group's trees are ordered by the group as a string.

    ``altered`` replaces columns in a second leaf of the rows for which ``when`` holds; trees are made of
    the first leaves alone.
    """
    values = [F.col(c) for c in columns]
    other = leaf([(altered or {}).get(c, F.col(c)) for c in columns])
    rows = written(spark, df.select(
        # Keeps the null group apart and before all others.
        F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0")).alias("tree"),
        F.col(id_col).alias("id"), leaf(values).alias("digest"),
        F.when(F.lit(False) if when is None else when, other).alias("altered"),
        F.monotonically_increasing_id().alias("row")), "leaves")
    nodes = ranked(spark, rows, ["id", "digest", "row"]).withColumn("payload", F.struct("id", "altered"))
    groups = climb(spark, nodes, fan, levels)
    subroots = tops(groups, fan ** levels).select(
        F.lit("").alias("tree"), F.col("tree").alias("payload"), F.col("top").alias("digest"))
    return Manifest(groups, climb(spark, ranked(spark, subroots, ["payload"]), fan, levels), fan, levels)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def tampered() -> Column:
    """Rows whose id's checksum is a multiple of three."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 0


def op11_merkle_manifest(spark, root: str) -> DataFrame:
    made = manifest(spark, table(spark, root, "documents"), COLUMNS, "lang", "doc_id",
                    {"text": F.translate("text", ascii_uppercase, ascii_lowercase)}, tampered())
    out = made.proofs().withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                      F.sha2(joined(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = """
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
rows AS (
    SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
        || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
        CASE WHEN xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 3 = 0
            THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            ELSE text END AS shown
    FROM documents, crc),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM (
        SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS shown FROM rows)),
nodes(lang, level, rank, digest) AS (
    SELECT lang, 0, rank, leaf FROM leaves
    UNION ALL
    SELECT lang, level + 1, rank // 8, sha256(string_agg(digest, '' ORDER BY rank))
    FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS m FROM nodes) WHERE m > 1
    GROUP BY lang, level, rank // 8),
subroots AS (
    SELECT lang, arg_max(digest, level) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank
    FROM nodes GROUP BY lang),
crown(level, rank, digest) AS (
    SELECT 0, rank, subroot FROM subroots
    UNION ALL
    SELECT level + 1, rank // 8, sha256(string_agg(digest, '' ORDER BY rank))
    FROM (SELECT *, count(*) OVER () AS m FROM crown) WHERE m > 1 GROUP BY level, rank // 8),
sides AS (
    SELECT *, level = max(level) OVER (PARTITION BY lang) AS is_top,
        coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM nodes WINDOW w AS (PARTITION BY lang, level, rank // 8 ORDER BY rank)),
crown_sides AS (
    SELECT *, level = max(level) OVER () AS is_top,
        coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM crown WINDOW w AS (PARTITION BY level, rank // 8 ORDER BY rank)),
path(lang, leaf_rank, level, rank, proof, folded) AS (
    SELECT lang, rank, 0, rank, '', shown FROM leaves
    UNION ALL
    SELECT p.lang, p.leaf_rank, p.level + 1, p.rank // 8, p.proof || s.l || s.r, sha256(s.l || p.folded || s.r)
    FROM path p JOIN sides s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = p.level AND s.rank = p.rank
    WHERE NOT s.is_top),
reached AS (
    SELECT lang, leaf_rank, max_by(proof, level) AS proof, max_by(folded, level) AS folded
    FROM path GROUP BY lang, leaf_rank),
crown_path(lang, leaf_rank, level, rank, proof, folded) AS (
    SELECT r.lang, leaf_rank, 0, s.rank, proof, folded
    FROM reached r JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang
    UNION ALL
    SELECT p.lang, p.leaf_rank, p.level + 1, p.rank // 8, p.proof || s.l || s.r, sha256(s.l || p.folded || s.r)
    FROM crown_path p JOIN crown_sides s ON s.level = p.level AND s.rank = p.rank WHERE NOT s.is_top),
done AS (
    SELECT lang, leaf_rank, max_by(proof, level) AS proof, max_by(folded, level) AS folded
    FROM crown_path GROUP BY lang, leaf_rank),
top AS (SELECT arg_max(digest, level) AS root FROM crown)
SELECT v.doc_id, v.leaf, s.subroot, top.root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root,
       d.folded = top.root AS verified
FROM leaves v JOIN done d ON d.lang IS NOT DISTINCT FROM v.lang AND d.leaf_rank = v.rank
JOIN subroots s ON s.lang IS NOT DISTINCT FROM v.lang, top
"""
