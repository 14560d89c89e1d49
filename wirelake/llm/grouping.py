"""Groups of near duplicates from buckets of candidates, without pairs in the square of a bucket's size.

Every two members of a bucket are candidates. First each member is compared with its bucket's least member;
what matches is joined into components. Only members of one bucket that are still in different components are
then compared with one another, all of them. So the groups are those that comparing all pairs of every bucket gives,
but a bucket of n copies costs n comparisons. Buckets of many members that don't match are given to an exact join by other keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.common import cut

#: Comparisons for each member of a bucket beyond which its members are joined by other keys.
CROWD = 64


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the undirected ``edges`` (a, b); root is the least node of the component.

    Least labels travel along edges and then along the labels themselves (pointer jumping), until nothing changes.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        heard = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        told = label.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = told.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = cut(told.join(jump, "root", "left").select("node", "old", F.coalesce("next", "root").alias("root")))
        label = new.select("node", "root")
        if new.filter(F.col("old") != F.col("root")).isEmpty():
            return label


def bucket_groups(members: DataFrame, verify: Callable[[DataFrame], DataFrame], crowded: Callable[[DataFrame], DataFrame] | None = None, crowd: int = CROWD) -> DataFrame:
    """(node, root) of every node that matches another; ``members`` has (bucket, node), ``verify`` keeps the matching (a, b).

    Where more than ``crowd`` comparisons for each of a bucket's members would be left after the first round, ``crowded`` gets the members
    (node) of all such buckets and returns the matching (a, b) among them by an exact way of its own; without it they are compared all the same.
    """
    w = Window.partitionBy("bucket")
    shared = cut(
        members.select("bucket", "node", F.min("node").over(w).alias("least"), F.max("node").over(w).alias("most"))
        .filter("least < most").select("bucket", "node", "least").distinct()
    )
    star = cut(shared.filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    found = cut(verify(star))
    label = components(found)
    at = shared.join(label, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    sizes = at.groupBy("bucket", "root").count()
    square = F.sum(F.col("count").cast("double") * F.col("count"))
    major = (
        sizes.groupBy("bucket").agg(F.max(F.struct("count", "root")).alias("top"), F.count(F.lit(1)).alias("roots"), F.sum("count").alias("n"), square.alias("square"))
        .filter("roots > 1").withColumn("crowd", F.lit(crowded is not None) & ((F.col("n").cast("double") * F.col("n") - F.col("square")) / 2 > crowd * F.col("n")))
    )
    at = cut(at.join(major.select("bucket", F.col("top.root").alias("major"), "crowd"), "bucket"))
    x = at.filter("root != major AND NOT crowd").select("bucket", F.col("node").alias("x"), F.col("root").alias("root_x"))
    y = at.select("bucket", F.col("node").alias("y"), F.col("root").alias("root_y"), "major")
    cross = (
        x.join(y, "bucket").filter("root_x != root_y AND (root_y = major OR x < y)")
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        .join(star, ["a", "b"], "left_anti")
    )
    more = verify(cut(cross))
    if crowded is not None:
        dense = cut(at.filter("crowd").select("node").distinct())
        if not dense.isEmpty():
            more = more.unionByName(crowded(dense))
    more = cut(more)
    if more.isEmpty():
        return label
    return components(found.unionByName(more))
