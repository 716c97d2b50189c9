"""Connected components of a table of links, by smallest label, in a few shuffles each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.kit import cut, discard, small


def _to_roots(hooks: DataFrame) -> DataFrame:
    """(node, root) from (node, up), where ``up`` is a node too and never larger: ups are doubled until all are roots."""
    tree = cut(hooks, "tree")
    while True:
        further = small(tree).select(F.col("node").alias("up"), F.col("up").alias("upper"))
        jumped = cut(tree.join(further, "up").select("node", F.col("upper").alias("up"), (F.col("upper") < F.col("up")).alias("moved")), "tree")
        discard(tree)
        tree = jumped
        if not tree.where("moved").limit(1).count():
            return tree


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for each id that ``links`` (a, b) join with another: comp is the smallest id it is connected with.

    Each round hooks every node to the smallest of its neighbours, if that is smaller; follows the
    hooks to their roots by doubling; and replaces the links by links between different roots. A
    root that is left has a smaller neighbour in the next round or has taken in another node, so
    two rounds halve the nodes that still have links, however long chains are. Rounds go on until
    no link is left. Labels are combined before the shuffle; a small tree is broadcast, and other joins of
    written tables are split by Spark where a hub is hot. Rounds are written to the shared folder, which cuts the lineage.

    Null ids, links of an id with itself and repeated links change nothing. Other columns are ignored.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    edges, labels = cut(links.distinct(), "edges"), None
    while labels is None or edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = _to_roots(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")))
        few = small(tree)
        if labels is None:
            onward = tree.select(F.col("node").alias("id"), F.col("up").alias("comp"))
        else:
            roots = few.select(F.col("node").alias("comp"), F.col("up").alias("root"))
            onward = labels.join(roots, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
        onward = cut(onward, "labels")
        x, y = (few.select(F.col("node").alias(c), F.col("up").alias(f"{c}_root")) for c in ("a", "b"))
        between = edges.join(x, "a").join(y, "b").where("a_root <> b_root")
        between = cut(between.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
        discard(edges, tree, *([] if labels is None else [labels]))
        edges, labels = between, onward
    discard(edges)
    return labels
