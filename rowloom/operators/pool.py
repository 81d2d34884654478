"""Several databases as one graph: each keeps its ids, below the number of the database.

Rows, places, columns and texts of database number d have the ids they have there plus d << DB_SHIFT. Random draws go by the ids within the
database, so every context of a pool is the one that its database alone would give.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.operators.adjacency import Adjacency
from rowloom.operators.graph import Graph
from rowloom.operators.util import DB_SHIFT, in_db, union_all
from rowloom.sources.tasks import ResolvedTask

# Databases of a pool: what the bits above an id hold beside the task number.
MOST_DATABASES = 1 << 8

# Id columns per table of a graph.
IDS = {
    "nodes": ("node_id",),
    "edges": ("child_id", "parent_id"),
    "cells": ("node_id", "col_id"),
    "text_dict": ("text_id",),
    "column_index": ("col_id", "name_text_id"),
    "table_info": ("node_offset",),
}


@dataclass(frozen=True)
class GraphPool:
    """The tables of several graphs side by side; ``db_no`` of a row lies in its ids. The number of a database is its place in ``members``."""

    members: dict[str, Graph]
    nodes: DataFrame
    edges: DataFrame
    cells: DataFrame
    text_dict: DataFrame
    column_index: DataFrame
    table_info: DataFrame

    def member(self, db: str) -> tuple[int, Graph]:
        """Number and graph of a database; unknown names are errors."""
        if db not in self.members:
            raise ValueError(f"no database {db} in the pool of {', '.join(self.members)}")
        return list(self.members).index(db), self.members[db]

    def table_names(self) -> list[str]:
        return sorted({name for g in self.members.values() for name in g.table_names()})

    def max_parents(self) -> int:
        return max(g.max_parents() for g in self.members.values())


def placed(df: DataFrame, db_no: int, ids: tuple[str, ...], more: dict[str, Column] | None = None) -> DataFrame:
    """Rows of one database with their ids in the pool."""
    return df.withColumns({c: in_db(F.col(c), db_no) for c in ids} | (more or {})) if db_no else df


def pool_graphs(graphs: dict[str, Graph]) -> GraphPool:
    """One graph of several, without a shuffle and without numbering a row anew."""
    if not 0 < len(graphs) <= MOST_DATABASES:
        raise ValueError(f"a pool has 1 to {MOST_DATABASES} databases")

    def table(name: str) -> DataFrame:
        parts = []
        for db_no, (db, g) in enumerate(graphs.items()):
            more = {}
            if name == "cells":
                is_text = F.col("class_value_id") >= 0
                more = {c: F.when(is_text, in_db(F.col(c), db_no)).otherwise(F.col(c)) for c in ("text_id", "class_value_id")}
            parts.append(placed(getattr(g, name), db_no, IDS[name], more).withColumn("db", F.lit(db)))
        return union_all(parts)

    return GraphPool(members=dict(graphs), **{name: table(name) for name in IDS})


def count_cells(cells: DataFrame) -> DataFrame:
    """Cells, and distinct rows and columns that have them, per database and kind of value.

    Rows are told apart as the bits of words that each cover 64 ids, and each task puts together the words of the rows it reads: far fewer
    rows meet than cells, and no id is moved by itself.
    """
    kind = ["db", "sem_type"]
    bit = F.expr("shiftleft(1L, CAST(node_id & 63 AS INT))")
    words = cells.groupBy(*kind, F.shiftright("node_id", 6).alias("word")).agg(F.count("*").alias("n"), F.bit_or(bit).alias("bits"))
    rows = words.groupBy(*kind).agg(F.sum("n").alias("n_cells"), F.sum(F.bit_count("bits")).cast("bigint").alias("n_nodes"))
    # One row per column of the schema and kind.
    cols = cells.groupBy(*kind, "col_id").count().groupBy(*kind).agg(F.count("*").alias("n_cols"))
    return rows.join(F.broadcast(cols), kind)


def pool_tasks(task: ResolvedTask, task_no: int, db_no: int) -> ResolvedTask:
    """A task resolved within its database, with the pool's numbers and ids."""
    at = in_pool(db_no)
    return replace(
        task,
        task_no=task_no,
        db_no=db_no,
        target_col_id=at(task.target_col_id),
        drop_col_ids=tuple(map(at, task.drop_col_ids)),
        first_node=at(task.first_node),
        hidden_ranges=tuple((at(a), at(b)) for a, b in task.hidden_ranges),
    )


def in_pool(db_no: int):
    return lambda id_: id_ + (db_no << DB_SHIFT)


def _parents(name: str, db_no: int) -> Column:
    return F.transform(name, lambda u: F.struct(u["fk_pos"].alias("fk_pos"), u["step"].alias("step"), in_db(u["parent_id"], db_no).alias("parent_id")))


def pool_adjacency(parts: list[Adjacency]) -> Adjacency:
    def each(pick, ids: tuple[str, ...], ups: bool = False) -> DataFrame:
        return union_all([placed(pick(a), i, ids, {"ups": _parents("ups", i)} if ups else None) for i, a in enumerate(parts)])

    return Adjacency(
        entries=each(lambda a: a.entries.drop("others"), ("adj_pos", "parent_id", "child_id"), ups=True),
        runs=each(lambda a: a.runs, ("parent_id", "start")),
        times=each(lambda a: a.times, ("parent_id",)),
        height=max(a.height for a in parts),
    )


def pool_closures(parts: list[DataFrame]) -> DataFrame:
    return union_all([placed(df, i, ("node_id", "ancestor_id")) for i, df in enumerate(parts)])


def pool_payloads(parts: list[DataFrame]) -> DataFrame:
    def one(df: DataFrame, db_no: int) -> DataFrame:
        parents = F.transform("f2p_nbr_ids", lambda p: in_db(p, db_no))
        return placed(df, db_no, ("node_id",), {"ups": _parents("ups", db_no), "f2p_nbr_ids": parents})

    return union_all([one(df, i) for i, df in enumerate(parts)])
