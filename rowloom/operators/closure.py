"""All ancestors of a row along its foreign keys, in depth-first order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.operators.util import union_all
from rowloom.session import stage


def path_step(fk_pos: Column) -> Column:
    """One hop of a path: three digits that fall as the key position grows."""
    return F.lpad((F.lit(999) - fk_pos).cast("string"), 3, "0")


def ups_of(others: Column) -> Column:
    """A list of parents by the position of their key, null where there is none, as parents with their path steps."""
    named = F.transform(
        others, lambda up, pos: F.when(up.isNotNull(), F.struct(pos.alias("fk_pos"), path_step(pos).alias("step"), up.alias("parent_id")))
    )
    return F.array_compact(named)


def ancestor_paths(nodes: DataFrame, edges: DataFrame, max_hops: int | None) -> DataFrame:
    """(node_id, ancestor_id, hops, path) for every node, itself included with an empty path.

    The last key of a row is followed first, so a hop adds three digits that
    fall as ``fk_pos`` grows, and depth-first order is the order of the paths
    as strings, a prefix before its extensions. Only the least path per pair is kept, hop by hop: of two paths
    to one ancestor the lesser stays so when both go on. With ``max_hops`` known from the schema each hop is written once and
    extended by the next. In a cyclic schema (``None``) each round extends only the paths that improved,
    until none does; a loop never improves a path, so this ends.
    """
    up = edges.select(F.col("child_id").alias("ancestor_id"), path_step(F.col("fk_pos")).alias("step"), "parent_id")
    start = nodes.select(
        "node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("hops"), F.lit("").alias("path")
    )

    def extend(paths: DataFrame) -> DataFrame:
        return paths.join(up, "ancestor_id").select(
            "node_id",
            F.col("parent_id").alias("ancestor_id"),
            (F.col("hops") + 1).alias("hops"),
            F.concat("path", "step").alias("path"),
        )

    if max_hops is not None:
        levels = [start]
        for _ in range(max_hops):
            levels.append(stage(least_paths(extend(levels[-1])), "closure"))
        return least_paths(union_all(levels))

    best = fresh = stage(start, "closure")
    while True:
        found = least_paths(extend(fresh))
        old = best.select("node_id", "ancestor_id", F.col("path").alias("old_path"))
        better = found.join(old, ["node_id", "ancestor_id"], "left").filter(
            F.col("old_path").isNull() | (F.col("path") < F.col("old_path"))
        )
        fresh = stage(better.drop("old_path"), "closure")
        if fresh.isEmpty():
            return best
        best = stage(least_paths(best.unionByName(fresh)), "closure")


def least_paths(paths: DataFrame) -> DataFrame:
    """The depth-first first path per (node, ancestor)."""
    least = F.min(F.struct("path", "hops"))
    return (
        paths.groupBy("node_id", "ancestor_id")
        .agg(least.alias("b"))
        .select("node_id", "ancestor_id", F.col("b.hops").alias("hops"), F.col("b.path").alias("path"))
    )


def ancestors(nodes: DataFrame, edges: DataFrame, max_hops: int | None) -> DataFrame:
    """The paths of every node. Without cycles only rows that are parents climb hop by hop: every row then takes a step to each of its
    parents and goes on as the parent does, so the edges of the largest tables are joined once, however long the chains.
    """
    if max_hops is None:
        return ancestor_paths(nodes, edges, None)
    # Edges that know the child's other parents tell which rows reach an ancestor one way only: those need no comparison.
    many = F.size("ups") > 0 if "ups" in edges.columns else F.lit(True)
    slim = edges.select("child_id", "parent_id", path_step(F.col("fk_pos")).alias("step"), many.alias("many"))
    own = nodes.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("hops"), F.lit("").alias("path"))
    paths = parent_paths(edges, max_hops)
    # A row has at most as many ancestor paths as its tables have, which the schema bounds.
    lists = stage(
        paths.groupBy(F.col("node_id").alias("parent_id")).agg(F.collect_list(F.struct("ancestor_id", "hops", "path")).alias("up")),
        "closure",
    )

    def climbed(some: DataFrame) -> DataFrame:
        met = some.join(lists, "parent_id").select("child_id", "step", F.explode("up").alias("u"))
        return met.select(
            F.col("child_id").alias("node_id"),
            F.col("u.ancestor_id").alias("ancestor_id"),
            (F.col("u.hops") + 1).alias("hops"),
            F.concat("step", "u.path").alias("path"),
        )

    return union_all([own, climbed(slim.filter("NOT many")), least_paths(climbed(slim.filter("many")))])


def parent_paths(edges: DataFrame, max_hops: int | None) -> DataFrame:
    """Ancestor paths of the rows that are parents, along the edges between such rows alone."""
    parents = stage(edges.select(F.col("parent_id").alias("node_id")).distinct(), "parents")
    between = edges.select("child_id", "fk_pos", "parent_id").join(parents.withColumnRenamed("node_id", "child_id"), "child_id", "left_semi")
    return ancestor_paths(parents, stage(between, "parent_edges"), max_hops)


def parent_closure(nodes: DataFrame, edges: DataFrame, max_hops: int | None) -> DataFrame:
    """Ancestor paths, with the cell count of every ancestor, of the rows that are parents.

    Rows nobody points to, as in the largest tables, reach their ancestors
    through their own keys and need no entry here.
    """
    counts = nodes.select(F.col("node_id").alias("ancestor_id"), "n_cells")
    return parent_paths(edges, max_hops).join(counts, "ancestor_id")
