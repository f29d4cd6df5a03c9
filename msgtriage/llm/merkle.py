"""A Merkle manifest of a table, with nested-interval labels.

Every row is a leaf; its digest covers chosen columns. The leaves of a group (a
source) stand in order and are ranked from 0. A node carries the interval of leaf
ranks that it covers; ``FAN_OUT`` neighbouring nodes (the last ones may be fewer,
even one) have a parent, whose digest is that of their digests end to end and
whose interval is the union of theirs, and so on until a group has one node, its
subroot. The subroots, in the order of their groups, are the leaves of one more
tree, the crown, whose last node is the root.

Ancestors are attached by containment joins, one a level: a node's bucket at the
level above is its first rank divided by the leaves a node covers there, so group
and bucket are the key and the interval says which node it is. A parent holds the
intervals and digests of its children; what its interval has beyond the child's,
on the left and on the right, are the siblings. Paths are handed down from the
root, level by level: a node's path is its siblings and its parent's path, so only
the last join meets the leaves, and their paths never leave the task that reads
them.

Ranks come without gathering a group: rows are sorted by ranges of (group, order),
a row's place in its range is known, and the counts of the ranges, a row for each
range and group, are summed up to offsets. A group that has a third of all rows
spreads over as many ranges; no key of a join has more than ``FAN_OUT`` rows. The
text of a row is read once, for its digest. All of it is DataFrame functions; each
level is a table in the shared folder.

A null group is a group of its own and comes first; an empty one is another.
Groups and orders go by bytes, nulls first. Rows of one order value go by their
leaf digests; rows that repeat are leaves each. A group of one row has that leaf
as its subroot. An empty table has no rows, nodes or root. Null columns are told
from empty ones. Very long texts are hashed whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from msgtriage.llm.common import materialize

BITS = 4
FAN_OUT = 1 << BITS
#: The row's place in its range is in the lower bits of an increasing id, the range above them.
PLACE_BITS = 33
PATH = "array<struct<left:string,right:string>>"


def joined_digest(*texts: Column) -> Column:
    """Lower-case hexadecimal sha256 of texts end to end."""
    return F.sha2(F.concat(*texts), 256)


def field(value: Column) -> Column:
    """A value as the leaf digest takes it: its length in bytes, a colon, itself; null is a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return joined_digest(*[field(v) for v in values])


def group_key(group: Column) -> Column:
    """A text that is never null and sorts as the group does, null first."""
    return F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string")))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (group, digest and others) with ``rank`` in its group and ``size`` of the group."""
    keys = ["group", *order]
    placed = materialize(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()),
        "leaves").withColumn("range", F.shiftright("at", PLACE_BITS))
    counts = placed.groupBy("group", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("group")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "group", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("size"))
    return placed.join(offsets, ["group", "range"]).withColumn("rank", F.col("at") + F.col("shift")).drop(
        "at", "range", "shift")


def _width(level: int) -> Column:
    """The number of nodes of the row's group at a level."""
    return F.shiftright(F.col("size") + F.lit((1 << BITS * level) - 1), BITS * level)


def _between(nodes: str, inside) -> Column:
    """The digests of those nodes for which ``inside`` holds, end to end, in order."""
    return F.array_join(F.transform(F.filter(nodes, inside), lambda m: m["digest"]), "")


@dataclass
class Forest:
    """A tree for each group. ``levels[0]`` are the leaves, ``levels[i]`` the nodes with their members."""

    levels: list[DataFrame]

    @staticmethod
    def build(rows: DataFrame, order: list[str]) -> "Forest":
        """``rows`` have group, digest, the columns of ``order``, and others that are kept."""
        leaves = materialize(_ranked(rows, order).withColumn("lo", F.col("rank")).withColumn("hi", F.col("rank") + 1),
                             "ranked")
        largest = leaves.agg(F.max("size")).first()[0] or 0
        levels = [leaves]
        while largest > 1 << BITS * (len(levels) - 1):
            level = len(levels)
            below = levels[-1].where(_width(level - 1) > 1)
            member = F.struct("lo", "hi", "digest")
            nodes = below.groupBy("group", "size", F.shiftright("lo", BITS * level).alias("bucket")).agg(
                F.array_sort(F.collect_list(member)).alias("members"))
            levels.append(materialize(nodes.select(
                "group", "size", "bucket", F.array_min("members")["lo"].alias("lo"),
                F.array_max("members")["hi"].alias("hi"), "members",
                F.sha2(F.array_join(F.transform("members", lambda m: m["digest"]), ""), 256).alias("digest")), "nodes"))
        return Forest(levels)

    def _roots(self, level: int) -> DataFrame:
        return self.levels[level].where(_width(level) == 1)

    def roots(self) -> DataFrame:
        """(group, digest) of the last node of each group."""
        parts = [self._roots(level).select("group", "digest") for level in range(len(self.levels))]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def leaves(self, above: DataFrame | None = None) -> DataFrame:
        """The leaves, each with its ``path``: the siblings (left, right) of it and of its ancestors, bottom up.

        ``above`` has for each group what its last node inherits: path, subroot and root; without it the last
        node is the root.
        """
        handed: DataFrame | None = None
        for level in range(len(self.levels) - 1, -1, -1):
            paths = self._last_nodes(level, above)
            if handed is not None:
                paths = paths.unionByName(self._below(level, handed))
            handed = paths
        return handed

    def _last_nodes(self, level: int, above: DataFrame | None) -> DataFrame:
        """The last nodes of the groups that end at this level, with what they inherit."""
        nodes = self._roots(level)
        if above is not None:
            return nodes.join(above, "group")
        return nodes.withColumns({
            "path": F.array().cast(PATH), "subroot": F.lit(None).cast("string"), "root": F.col("digest")})

    def _below(self, level: int, handed: DataFrame) -> DataFrame:
        """The nodes of a level that have a parent, with its path and theirs in front."""
        nodes = self.levels[level].where(_width(level) > 1)
        parents = handed.select(
            F.col("group").alias("_group"), F.col("bucket").alias("_bucket"), F.col("lo").alias("_lo"),
            F.col("hi").alias("_hi"), F.col("members").alias("_members"), F.col("path").alias("_path"), "subroot", "root")
        contains = (
            (F.col("group") == F.col("_group")) & (F.shiftright("lo", BITS * (level + 1)) == F.col("_bucket"))
            & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
        siblings = F.struct(_between("_members", lambda m: m["hi"] <= F.col("lo")).alias("left"),
                            _between("_members", lambda m: m["lo"] >= F.col("hi")).alias("right"))
        attached = nodes.join(parents, contains).withColumn("path", F.concat(F.array(siblings), F.col("_path")))
        return attached.drop("_group", "_bucket", "_lo", "_hi", "_members", "_path")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf digest leads to along its path."""
    return F.aggregate(path, digest, lambda d, s: joined_digest(s["left"], d, s["right"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(df: DataFrame, group: Column, order: Column, leaf: Column, carry: dict[str, Column]) -> DataFrame:
    """One row per row of ``df``: leaf, subroot, root, path, and the columns ``carry`` in a struct ``carried``.

    ``fold(leaf, path)`` gives the root. The rows of a group are in the order of ``order``.
    """
    rows = materialize(df.select(
        group_key(group).alias("group"), order.alias("order"), leaf.alias("digest"),
        F.struct(*[c.alias(name) for name, c in carry.items()]).alias("carried"),
        F.monotonically_increasing_id().alias("tag")), "leaf-digests")
    trees = Forest.build(rows, ["order", "digest", "tag"])
    crowned = Forest.build(trees.roots().withColumn("source", F.col("group")).withColumn("group", F.lit("")), ["source"])
    above = materialize(crowned.leaves().select(
        F.col("source").alias("group"), "path", F.col("digest").alias("subroot"), "root"), "crown")
    return trees.leaves(above).select(F.col("digest").alias("leaf"), "subroot", "root", "path", "carried")
