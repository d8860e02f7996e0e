"""Ordered trees from flat paths, cursors over them, and what lies beneath a node.

A node's sort_path holds the natural keys and names of its components, so that the order of arrays is the order in
which the tree is walked: a node, then its children, sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafstack.functions.text import components, natural_key


def path_tree(entries: DataFrame, tree: str, path: str, keep: list[str]) -> DataFrame:
    """Nodes (tree, node, parent, name, depth, sort_path, synthetic and the kept columns) of entries' paths.

    Each prefix of a path is a node; those without an entry of their own are folders made up (kept columns null).
    """
    parts = entries.select(F.col(tree).alias("tree"), components(F.col(path)).alias("parts"), *keep)
    entry = parts.select("tree", F.array_join("parts", "/").alias("node"), F.lit(False).alias("own"), *keep)
    prefixes = parts.select("tree", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.slice("parts", F.lit(1), i))).alias("parts")).distinct()
    nodes = prefixes.select(
        "tree", F.array_join("parts", "/").alias("node"), F.when(F.size("parts") > 1, F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/")).alias("parent"), F.element_at("parts", -1).alias("name"),
        F.size("parts").alias("depth"), F.transform("parts", lambda p: F.concat(natural_key(p), F.lit("\u0001"), p)).alias("sort_path"),
    )
    return nodes.join(entry, ["tree", "node"], "left").withColumn("synthetic", F.col("own").isNull()).drop("own")


def walk(*extra: str) -> Window:
    return Window.partitionBy("tree", *extra).orderBy("sort_path")


def with_index(nodes: DataFrame, viewable: str = "viewable") -> DataFrame:
    """Zero-based place of each viewable node in its tree."""
    return nodes.filter(viewable).withColumn("view_index", F.row_number().over(walk()) - 1)


def neighbours(nodes: DataFrame, viewable: str = "viewable", wrap: bool = False) -> DataFrame:
    """next and previous viewable node of each; with wrap, the ends meet."""
    seen = nodes.filter(viewable)
    whole = walk().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    next_, before = F.lead("node").over(walk()), F.lag("node").over(walk())
    if wrap:
        next_, before = F.coalesce(next_, F.first("node").over(whole)), F.coalesce(before, F.last("node").over(whole))
    return seen.withColumn("next", next_).withColumn("previous", before)


def ends(nodes: DataFrame, viewable: str = "viewable") -> DataFrame:
    """First and last viewable node of each tree."""
    return nodes.filter(viewable).groupBy("tree").agg(F.min_by("node", "sort_path").alias("first"), F.max_by("node", "sort_path").alias("last"))


def folder_neighbours(nodes: DataFrame, viewable: str = "viewable") -> DataFrame:
    """For each folder that holds viewable nodes: its first and last one, and the first ones of the next and the previous such folder."""
    folders = nodes.filter(viewable).groupBy("tree", "parent").agg(F.min("sort_path").alias("sort_path"), F.min_by("node", "sort_path").alias("first"), F.max_by("node", "sort_path").alias("last"))
    return folders.withColumn("next_first", F.lead("first").over(walk())).withColumn("previous_first", F.lag("first").over(walk())).drop("sort_path")


def find_next(nodes: DataFrame, match: Column, viewable: str = "viewable") -> DataFrame:
    """For each viewable node the next one that matches, wrapping around to those before it; itself doesn't count.

    One pass backwards through a tree: frames that grow from the end, as those that shrink towards it are read again
    for every row. A node without a match after it gets the tree's first one, if there is one besides itself.
    """
    seen = nodes.filter(viewable).withColumn("hit", F.when(match, F.col("node")))
    back = Window.partitionBy("tree").orderBy(F.col("sort_path").desc())
    whole = back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.last("hit", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    others = F.count("hit").over(whole) - F.col("hit").isNotNull().cast("int")
    return seen.withColumn("found", F.coalesce(after, F.when(others > 0, F.last("hit", ignorenulls=True).over(whole)))).drop("hit")


def beneath(nodes: DataFrame, aggregates: list[Column], include_self: bool = True) -> DataFrame:
    """Aggregates over each node and all nodes beneath it: every row counts for its prefixes, once each, and is summed before the shuffle."""
    up = F.transform(F.sequence(F.lit(1), F.col("depth") if include_self else F.greatest(F.col("depth") - 1, F.lit(1))), lambda i: F.array_join(F.slice(components(F.col("node")), F.lit(1), i), "/"))
    rows = nodes if include_self else nodes.filter("depth > 1")
    return rows.withColumn("above", F.explode(up)).groupBy("tree", F.col("above").alias("node")).agg(*aggregates)


def counts_over(nodes: DataFrame, n: int, viewable: str = "viewable", compat: bool = False) -> DataFrame:
    """Whether each node has more than n viewable nodes beneath it or is one. compat: a child that isn't viewable and has no more than n counts for nothing.

    compat works level by level from the deepest one; trees are as deep as their longest path.
    """
    if not compat:
        return beneath(nodes, [F.count_if(F.col(viewable)).alias("n")]).withColumn("over", F.col("n") > n)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    done = None
    for depth in range(deepest, 0, -1):
        here = nodes.filter(F.col("depth") == depth).select("tree", "node", "parent", F.coalesce(F.col(viewable), F.lit(False)).alias("viewable"))
        if done is not None:
            below = done.filter(F.col("level") == depth + 1).groupBy("tree", F.col("parent").alias("node")).agg(F.sum(F.when(F.col("viewable") | F.col("over"), F.col("n")).otherwise(0)).alias("below"))
            here = here.join(below, ["tree", "node"], "left")
        else:
            here = here.withColumn("below", F.lit(0))
        here = here.withColumn("n", F.coalesce("below", F.lit(0)) + F.col("viewable").cast("long")).withColumn("over", F.col("n") > n).drop("below").withColumn("level", F.lit(depth))
        done = here if done is None else done.unionByName(here)
    return done.select("tree", "node", "n", "over") if done is not None else nodes.select("tree", "node", F.lit(0).alias("n"), F.lit(False).alias("over"))


def common_root(nodes: DataFrame, by: str, path: str) -> DataFrame:
    """The longest folder that all paths of a group share: the common prefix of the smallest and the largest path."""
    ends_ = nodes.select(by, F.expr(f"slice(filter(split({path}, '/'), x -> x <> ''), 1, greatest(size(filter(split({path}, '/'), x -> x <> '')) - 1, 0))").alias("p")).groupBy(by).agg(F.min("p").alias("a"), F.max("p").alias("b"))
    same = F.expr("filter(sequence(1, greatest(least(size(a), size(b)), 1)), i -> i <= least(size(a), size(b)) and slice(a, 1, i) = slice(b, 1, i))")
    return ends_.withColumn("root", F.array_join(F.slice("a", F.lit(1), F.coalesce(F.array_max(same), F.lit(0))), "/")).select(by, "root")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
