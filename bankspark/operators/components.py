"""Connected components of rows that share keys, by parallel hooking and shortcutting over joined parent tables.

Each key hooks its rows to its smallest row, which leaves a graph over those smallest rows only. In rounds
every node hooks to its smallest neighbour, parents are shortcut until they are roots, and edges are contracted
to edges between roots, until none is left. A node hooks in one round only, so the parents of all rounds make one
table, which meets the rows once at the end. Minima are combined before each shuffle, so a key held by a third
of all rows sends one row a task; joins against it are equi joins whose other side has one row a key, which
adaptive execution splits. Edges are counted each round; few of them are kept in one partition, where the same
joins need no shuffle. Lineage is cut with checkpoints in the shared folder.

Defined results: null keys link nothing; a row without keys is its own group; repeated ids are one row; a null
id has a null group; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bankspark.runtime import cut

#: Edges (two ids each) that one partition holds; more stay spread.
FEW_EDGES = 200_000


def components(df: DataFrame, key: str, links: dict[str, Column]) -> DataFrame:
    """key, group: the smallest key of the rows that are linked, directly or through others."""
    digests = F.array(*[F.when(c.isNotNull(), F.unhex(F.md5(F.concat(F.lit(f"{n}\u0001"), c)))) for n, c in links.items()])
    rows = df.select(F.col(key).alias("row"), F.filter(digests, lambda x: x.isNotNull()).alias("keys"))
    pairs = rows.select("row", F.explode("keys").alias("k")).where("row is not null")
    least = pairs.groupBy("k").agg(F.min("row").alias("low"))
    # row -> the smallest rows of its keys; the first is its parent, the others are linked with it
    own = pairs.join(least, "k").groupBy("row").agg(F.array_sort(F.collect_set("low")).alias("lows"))
    own = cut(own)
    edges = cut(own.where(F.size("lows") > 1).select(F.element_at("lows", 1).alias("b"), F.explode(F.slice("lows", F.lit(2), F.size("lows"))).alias("a")).distinct())
    roots = own.select("row", F.element_at("lows", 1).alias("group"))
    moved = None
    for turn in range(64):
        n = edges.count()
        if not n:
            break
        # merge joins of two single partitions need neither shuffle nor broadcast
        together = (lambda d: d.coalesce(1).hint("merge")) if n <= FEW_EDGES else (lambda d: d)
        edges = together(edges)
        parent = hook(edges, together)
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        moved = parent if moved is None else together(moved.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent")).union(parent))
        if turn % 8 == 7:
            moved = together(cut(moved))
        edges = edges.join(parent.withColumnsRenamed({"node": "a", "parent": "pa"}), "a").join(parent.withColumnsRenamed({"node": "b", "parent": "pb"}), "b", "left")
        edges = cut(edges.select(F.greatest("pa", F.coalesce("pb", "b")).alias("a"), F.least("pa", F.coalesce("pb", "b")).alias("b")).where("a <> b").distinct())
    else:
        raise RuntimeError("the components did not settle in 64 rounds")
    if moved is not None:
        roots = roots.join(moved.withColumnRenamed("node", "group"), "group", "left").select("row", F.coalesce("parent", "group").alias("group"))
    return df.select(F.col(key).alias("row")).distinct().join(roots, "row", "left").select(F.col("row").alias(key), F.coalesce("group", "row").alias("group"))


def hook(edges: DataFrame, together=lambda d: d) -> DataFrame:
    """node, parent: every node that is not a root with the root of the tree it hooks into."""
    both = together(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).where("parent < node")
    for _ in range(64):
        # a parent that moves again in the second of two jumps may move further
        parent = together(cut(parent))
        once = jump(parent, parent)
        parent = together(cut(jump(once.select("node", "parent"), parent)))
        if parent.where("moves").isEmpty():
            return parent.select("node", "parent")
        parent = parent.select("node", "parent")
    raise RuntimeError("the parents did not settle in 64 rounds")


def jump(parent: DataFrame, known: DataFrame) -> DataFrame:
    """node, parent, moves: every parent's own parent where it has one."""
    up = known.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return parent.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moves"))
