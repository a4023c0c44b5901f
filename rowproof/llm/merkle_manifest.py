"""A Merkle manifest of a dataset, and proofs of its rows.

Every row is a leaf.  The leaves of a group stand in order; runs of ``FAN``
nodes become the digest of their digests, level by level, until one is left,
the group's subroot.  The subroots, in order of their groups, become the root
in the same way.

The manifest is content-addressed: ``nodes`` holds, for every digest of a run,
the digests of its children, once however often it occurs.  A leaf is asked for
by its rank.  Requests descend from the root: the digits of the ranks (of the
group, then in the group) choose a child of each node, the children not chosen
are collected as a path segment, and the segments, reversed, are the proof.
Requests that share digits descend as one row until they part, so the work
above the leaves' parents is a row for each node on the way.

A rank in a group needs no task that holds the group: rows are dealt by ranges
of (group, order), counted by range, and numbered within their range behind the
counts of the ranges before.  All of it is built-in functions; the tables of a
manifest are written to the shared folder, so a lost executor costs little.

Defined results: null values count as ``-``, other values as their UTF-8 byte
count, a colon and the value; a null group is a group of its own, the first.
Rows of equal id stand in order of their leaves, rows with a null id first;
repeated rows are leaves of their own with equal digests.  An empty table has
no root (null) and no proofs.  Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Children of a node; a power of two.
FAN = 16
BITS = FAN.bit_length() - 1

#: One step of a path: the digests left and right of the one that was chosen, joined.
PATH = "array<struct<left: string, right: string>>"


@dataclass
class Manifest:
    root: str | None
    #: digest, children: every node above the leaves, once.
    nodes: DataFrame
    #: tree (the group's key), depth (levels below the subroot), subroot, rank (of the group), digest.
    groups: DataFrame
    #: id, tree, depth, rank (in the group), leaf, and the columns that were asked for.
    leaves: DataFrame
    #: Levels from the root to the subroots.
    depth: int


def digest_of(*values: Column) -> Column:
    """Lower-case hex SHA-256 of values, each with its byte count (null: a dash)."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def key_of(group: Column) -> Column:
    """A group's key, never null; keys have the order of the groups, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def depth_of(n: Column) -> Column:
    """Levels above ``n`` nodes."""
    return sum((n > F.lit(FAN**k)).cast("int") for k in range(60 // BITS))


def ranked(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``df`` with rank (from 0) and depth of each row's tree."""
    ranges = written(df.repartitionByRange(tree, *order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(tree, "range").agg(F.count("*").alias("here"))
    ahead = Window.partitionBy(tree).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(tree, "range", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("before"), depth_of(F.sum("here").over(Window.partitionBy(tree))).alias("depth"))
    within = F.row_number().over(Window.partitionBy(tree, "range").orderBy(*order))
    numbered = ranges.withColumn("within", within).join(counts, [tree, "range"])
    return written(numbered.withColumn("rank", F.col("before") + F.col("within") - 1).drop("range", "before", "within"), "ranked")


def built(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From (tree, depth, rank, digest): the tables (digest, children) of all
    levels, and (tree, depth, digest) of what remains of each tree."""
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    now, levels, tops = leaves.select("tree", "depth", "rank", "digest"), [], []
    for level in range(deepest + 1):
        tops.append(now.where(F.col("depth") == level).select("tree", "depth", "digest"))
        if level < deepest:
            run = now.where(F.col("depth") > level).groupBy("tree", "depth", F.shiftright("rank", BITS).alias("rank"))
            children = run.agg(F.array_sort(F.collect_list(F.struct("rank", "digest")))["digest"].alias("children"))
            now = written(children.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), "level")
            levels.append(now.select("digest", "children"))
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return levels, top


def manifest(df: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "source", **more: Column) -> Manifest:
    """The manifest of ``df`` with a leaf for each row; ``more`` columns are kept beside the leaves."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), key_of(F.col(group_col)).alias("tree"), leaf.alias("leaf"), *[c.alias(k) for k, c in more.items()])
    leaves = ranked(rows, "tree", ["id", "leaf"])
    levels, tops = built(leaves.withColumnRenamed("leaf", "digest"))
    groups = ranked(tops.select(F.lit("").alias("all"), F.col("tree"), F.col("depth").alias("below"), "digest"), "all", ["tree"])
    above, root = built(groups.select(F.col("all").alias("tree"), "depth", "rank", "digest"))
    root = root.first()
    nodes = spark.createDataFrame([], "digest string, children array<string>")
    for level in levels + above:
        nodes = nodes.unionByName(level)
    groups = groups.select("tree", F.col("below").alias("depth"), "rank", F.col("digest").alias("subroot"))
    return Manifest(root and root.digest, written(nodes.dropDuplicates(["digest"]), "nodes"), groups, leaves, root.depth if root else 0)


def chosen(digit: Column) -> Column:
    """The segment of a node's children besides the one of number ``digit``."""
    left = F.array_join(F.slice("children", F.lit(1), digit), "")
    return F.struct(left.alias("left"), F.array_join(F.slice("children", digit + 2, F.lit(FAN)), "").alias("right"))


def descended(requests: DataFrame, starts: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """``requests`` (tree, depth, rank, ...) with the path from the root to each.

    ``starts`` (tree, depth, digest, path) are the tops of the trees asked for, with
    the paths to them."""
    digit = lambda c: F.col(c).bitwiseAND(F.lit(FAN - 1)).cast("int")
    wanted = {1: requests.where("depth > 0").select("tree", "depth", F.shiftright("rank", BITS).alias("place")).distinct()}
    for level in range(2, deepest + 1):
        wanted[level - 1] = written(wanted[level - 1], "wanted")
        wanted[level] = wanted[level - 1].where(F.col("depth") >= level).select("tree", "depth", F.shiftright("place", BITS).alias("place")).distinct()
    open_at = None
    for level in range(deepest, 0, -1):
        begun = starts.where(F.col("depth") == level).select("tree", F.lit(0).cast("long").alias("place"), "digest", "path")
        open_at = begun if open_at is None else open_at.unionByName(begun)
        open_at = open_at.join(nodes, "digest")  # fetched by content
        if level > 1:
            child = wanted[level - 1].where(F.col("depth") >= level).select("tree", F.shiftright("place", BITS).alias("place"), F.col("place").alias("next"))
            step = open_at.join(child, ["tree", "place"])
            open_at = written(step.select("tree", F.col("next").alias("place"), F.get("children", digit("next")).alias("digest"), F.array_append("path", chosen(digit("next"))).alias("path")), "descent")
    alone = requests.join(starts.where("depth = 0").select("tree", "path"), "tree")
    if open_at is None:
        return alone
    asked = requests.where("depth > 0").withColumn("place", F.shiftright("rank", BITS)).join(open_at.drop("digest"), ["tree", "place"])
    asked = asked.withColumn("path", F.array_append("path", chosen(digit("rank")))).drop("place", "children")
    return asked.unionByName(alone)


def proofs(of: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Leaves of the manifest (all, or those of ``requests``: rows of ``of.leaves``)
    with subroot and path: segments from the leaf's siblings up to the root's children."""
    requests = of.leaves if requests is None else requests
    none = F.array().cast(PATH)
    top = of.groups.limit(1).select(F.lit("").alias("tree"), F.lit(of.depth).alias("depth"), F.lit(of.root).alias("digest"), none.alias("path"))
    groups = of.groups.join(requests.select("tree").distinct(), "tree", "left_semi")
    asked = groups.select(F.lit("").alias("tree"), F.lit(of.depth).alias("depth"), "rank", F.col("tree").alias("group"), F.col("depth").alias("below"), "subroot")
    found = written(descended(asked, top, of.nodes, of.depth).select(F.col("group").alias("tree"), F.col("below").alias("depth"), F.col("subroot").alias("digest"), "path"), "groups")
    deepest = found.agg(F.max("depth")).first()[0] or 0
    out = descended(requests, found, of.nodes, deepest).join(found.select("tree", F.col("digest").alias("subroot")), "tree")
    return out.withColumn("path", F.reverse("path"))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf's to the root's children."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda now, s: F.sha2(F.concat(s["left"], now, s["right"]), 256))
