"""From the rows of contexts to their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from rowloom.operators.closure import path_step
from rowloom.operators.sampling import ITEM, RANK

CONTEXT = ["task_no", "seed_id"]
CELL_FIELDS = [
    "col_id",
    "sem_type",
    "number_value",
    "text_id",
    "datetime_value",
    "boolean_value",
    "class_value_id",
]


def node_payload(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per row: table, timestamp, number of cells, all parents with their path steps (``ups``) and as ids."""
    steps = F.array_sort(F.collect_list(F.struct("fk_pos", path_step(F.col("fk_pos")).alias("step"), "parent_id")))
    ups = edges.groupBy(F.col("child_id").alias("node_id")).agg(steps.alias("ups"))
    none = F.array().cast("array<struct<fk_pos:int,step:string,parent_id:bigint>>")
    return (
        nodes.select("node_id", "table_name", "ts_sec", "is_task", "n_cells")
        .join(ups, "node_id", "left")
        .withColumn("ups", F.coalesce("ups", none))
        .withColumn("f2p_nbr_ids", F.col("ups")["parent_id"])
    )


def number_cells(context_nodes: DataFrame, row_cells: DataFrame, tasks: list, seq_len: int, parts: int | None = None) -> DataFrame:
    """``context_cells`` of tasks without leakage columns, with column, type, number and mask of each cell alone, from whole rows of cells."""
    if any(t.drop_col_ids for t in tasks):
        raise ValueError("leakage columns are hidden by the times of the rows: use context_cells")
    target = F.lit(None).cast("bigint")
    for t in tasks:
        target = F.when(F.col("task_no") == t.task_no, F.lit(t.target_col_id).cast("bigint")).otherwise(target)
    fits = F.filter("cells", lambda c: F.col("before") + c["cell_ord"] < seq_len)
    shown = context_nodes.select(*CONTEXT, "node_id", "before").join(row_cells, "node_id").withColumn("cells", fits)
    shown = shown.repartition(*([parts] if parts else []), *CONTEXT).select("*", F.explode("cells").alias("c"))
    hidden = (F.col("node_id") == F.col("seed_id")) & (F.col("c.col_id") == target)
    pos = (F.col("before") + F.col("c.cell_ord")).cast("int")
    return shown.select(*CONTEXT, pos.alias("pos"), "c.sem_type", "c.number_value", hidden.alias("mask"))


def context_cells(
    context_nodes: DataFrame,
    payload: DataFrame,
    cells: DataFrame,
    tasks: list,
    seq_len: int,
    parts: int | None = None,
) -> DataFrame:
    """The cells of every context in order, at most ``seq_len`` of them.

    A task's leakage columns are hidden on the seed and on every row with the
    seed's timestamp (no timestamp equals no timestamp). ``tasks`` are the
    resolved tasks in the order of ``task_no``; their number is the
    catalogue's. Rows were trimmed before, so only rows with a visible cell
    meet their cells here.

    A row travels with the list of its cells, as many as its table has columns, and is unfolded only where its context is: the
    result lies by CONTEXT, in ``parts`` partitions if given, so what groups it by context needs no further shuffle.
    """
    target = F.lit(None).cast("bigint")
    drops = F.lit(None).cast("array<bigint>")
    for t in tasks:
        mine = F.col("task_no") == t.task_no
        target = F.when(mine, F.lit(t.target_col_id).cast("bigint")).otherwise(target)
        if t.drop_col_ids:
            ids = F.array(*[F.lit(c).cast("bigint") for c in t.drop_col_ids])
            drops = F.when(mine, ids).otherwise(drops)
    packed = cells.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("cell_ord", *CELL_FIELDS))).alias("cells"))
    shown = context_nodes.drop("n_cells").join(payload.drop("ups", "n_cells"), "node_id").join(packed, "node_id")
    is_seed = F.col("node_id") == F.col("seed_id")
    if any(t.drop_col_ids for t in tasks):
        at_seed = is_seed | F.col("ts_sec").eqNullSafe(F.col("seed_ts"))
        left = F.filter("cells", lambda c: ~F.array_contains(drops, c["col_id"]))
        shown = shown.withColumn("cells", F.when(drops.isNotNull() & at_seed, left).otherwise(F.col("cells")))
        shown = shown.repartition(*([parts] if parts else []), *CONTEXT)
        earlier = W.partitionBy(*CONTEXT).orderBy(*RANK).rowsBetween(W.unboundedPreceding, -1)
        shown = shown.withColumn("before", F.coalesce(F.sum(F.size("cells")).over(earlier), F.lit(0)))
        fits = F.slice("cells", F.lit(1), F.greatest(F.lit(seq_len) - F.col("before"), F.lit(0)).cast("int"))
        shown = shown.select("*", F.posexplode(fits).alias("nth", "c"))
        pos = F.col("before") + F.col("nth")
    else:
        fits = F.filter("cells", lambda c: F.col("before") + c["cell_ord"] < seq_len)
        shown = shown.withColumn("cells", fits).repartition(*([parts] if parts else []), *CONTEXT).select("*", F.explode("cells").alias("c"))
        pos = F.col("before") + F.col("c.cell_ord")
    shown = shown.select(*[c for c in shown.columns if c != "cells"], *[F.col("c")[f].alias(f) for f in CELL_FIELDS])
    is_target = is_seed & (F.col("col_id") == target)
    return shown.select(
        *ITEM,
        "task_no",
        "seed_id",
        pos.cast("int").alias("pos"),
        "node_id",
        "depth",
        "table_name",
        *CELL_FIELDS,
        "f2p_nbr_ids",
        is_target.alias("is_target"),
        is_target.alias("mask"),
        (F.col("is_task") | (F.col("col_id") == target)).alias("is_task_node"),
    )
