"""Ancestors of rows along the foreign keys of the schema, where every parent's key is its row position.

Without cycles the schema lists the paths that a row of a table can take, so the ancestors of a row are so many columns and the path and hops of
each are known beforehand. A row takes over the columns of its parents: one join per foreign key whose parents have parents, and none
of rows with their own ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.operators.graph import Numbered, parent_ids
from rowloom.operators.util import union_all
from rowloom.session import stage
from rowloom.sources.catalog import Catalog, Table

# A schema with more paths from one table goes hop by hop.
MOST_PATHS = 64
ANCESTORS = "node_id bigint, ancestor_id bigint, hops int, path string"


def paths_of(catalog: Catalog, t: Table) -> list[tuple[str, str]]:
    """(path, table) of every ancestor that the schema gives a row of a table without cycles above it, in depth-first order."""
    out = []
    for pos, (_, parent) in reversed(list(enumerate(t.fkeys))):
        step = f"{999 - pos:03d}"
        out += [(step, parent), *[(step + path, table) for path, table in paths_of(catalog, catalog.table(parent))]]
    return out


def has_lineage(numbered: Numbered) -> bool:
    """Whether the schema has no cycle, not too many paths and row positions as keys of all parents."""
    catalog = numbered.catalog
    if catalog.max_hops() is None or any(parent_ids(numbered, t) is None for t in catalog.tables):
        return False
    n_paths: dict[str, int] = {}

    def count(t: Table) -> int:
        if t.name not in n_paths:
            n_paths[t.name] = sum(1 + count(catalog.table(p)) for _, p in t.fkeys)
        return n_paths[t.name]

    return all(count(t) <= MOST_PATHS for t in catalog.tables)


def with_lineage(numbered: Numbered, t: Table, lists: dict[str, DataFrame], cells: bool) -> DataFrame:
    """node_id, n_cells and the ancestors of each row of a table: ``a0``, ``a1``, ... as ``paths_of`` lists them, null where a key has no parent.

    ``lists`` has the same of its parents. With ``cells``, ``c0``, ``c1``, ... are the numbers of their cells.
    """
    catalog = numbered.catalog
    keys = {f"k{pos}": key for pos, key in enumerate(parent_ids(numbered, t))}
    rows = numbered.node_rows(t).select("node_id", numbered.n_cells(t).alias("n_cells"), *[key.alias(k) for k, key in keys.items()])
    ids, counts = [], []
    for pos, (_, parent) in reversed(list(enumerate(t.fkeys))):
        above = len(paths_of(catalog, catalog.table(parent)))
        if cells or above:
            theirs = {f"u{pos}_{i}": F.col(f"a{i}") for i in range(above)}
            if cells:
                theirs |= {f"n{pos}": F.col("n_cells"), **{f"v{pos}_{i}": F.col(f"c{i}") for i in range(above)}}
            up = lists[parent].select(F.col("node_id").alias("at"), *[c.alias(n) for n, c in theirs.items()])
            # Rows without a parent take a key that no row has, each its own.
            rows = rows.withColumn("at", F.coalesce(f"k{pos}", -F.col("node_id") - 1)).join(up, "at", "left").drop("at")
        ids += [f"k{pos}", *[f"u{pos}_{i}" for i in range(above)]]
        counts += [f"n{pos}", *[f"v{pos}_{i}" for i in range(above)]]
    return rows.select(
        "node_id",
        "n_cells",
        *[F.col(c).alias(f"a{i}") for i, c in enumerate(ids)],
        *([F.col(c).alias(f"c{i}") for i, c in enumerate(counts)] if cells else []),
    )


def parent_lists(numbered: Numbered, cells: bool) -> dict[str, DataFrame]:
    """``with_lineage`` of every table that is somebody's parent; tables with parents of their own are written once."""
    catalog = numbered.catalog
    lists: dict[str, DataFrame] = {}

    def add(t: Table) -> None:
        for _, parent in t.fkeys:
            if parent not in lists:
                above = catalog.table(parent)
                add(above)
                own = with_lineage(numbered, above, lists, cells)
                lists[parent] = stage(own, f"lineage_{parent}") if above.fkeys else own

    for t in catalog.tables:
        add(t)
    return lists


def unfolded(catalog: Catalog, t: Table, rows: DataFrame, cells: bool) -> DataFrame:
    """One row per row of a table and ancestor, itself included; of several paths to one ancestor the first in depth-first order."""
    paths = paths_of(catalog, t)

    def entry(ancestor: Column, path: str, n_cells: Column) -> Column:
        fields = [ancestor.alias("ancestor_id"), F.lit(len(path) // 3).alias("hops"), F.lit(path).alias("path")]
        return F.struct(*fields, *([n_cells.alias("n_cells")] if cells else []))

    entries = [entry(F.col("node_id"), "", F.col("n_cells"))]
    for i, (path, table) in enumerate(paths):
        new = F.col(f"a{i}").isNotNull()
        for j in range(i):
            if paths[j][1] == table:
                new = new & ~F.col(f"a{i}").eqNullSafe(F.col(f"a{j}"))
        entries.append(F.when(new, entry(F.col(f"a{i}"), path, F.col(f"c{i}") if cells else F.lit(None))))
    return rows.select("node_id", F.inline(F.array_compact(F.array(*entries))))


def row_ancestors(numbered: Numbered) -> DataFrame | None:
    """``ancestors`` of every row; None where rows do not tell their lineage."""
    if not has_lineage(numbered):
        return None
    lists = parent_lists(numbered, cells=False)
    parts = [unfolded(numbered.catalog, t, with_lineage(numbered, t, lists, cells=False), cells=False) for t in numbered.catalog.tables]
    return union_all(parts, numbered.catalog.spark, ANCESTORS)


def row_closure(numbered: Numbered) -> DataFrame | None:
    """``parent_closure`` of every row of the tables that are parents; None where rows do not tell their lineage."""
    if not has_lineage(numbered):
        return None
    catalog = numbered.catalog
    lists = parent_lists(numbered, cells=True)
    parts = [unfolded(catalog, catalog.table(name), rows, cells=True) for name, rows in lists.items()]
    return union_all(parts, catalog.spark, f"{ANCESTORS}, n_cells int")
