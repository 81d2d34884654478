"""Contexts lie together: what is asked of them by context moves nothing."""

import pytest
from pyspark.sql import functions as F

from rowloom.operators import assemble as B
from rowloom.operators import payload as P
from rowloom.operators import relations as R
from rowloom.session import stage_buckets


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def cells(spark):
    # Context 1: row 10 points to itself and 11, row 12 to 11 and a row that is not shown. Context 2: row 11 alone.
    rows = [(0, 1, 0, 10, "a", 5, [10, 11], True), (0, 1, 1, 10, "a", 6, [10, 11], False), (0, 1, 2, 11, "b", 7, [], False)]
    rows += [(0, 1, 3, 12, "a", 5, [11, 99], False), (0, 2, 0, 11, "b", 7, [], True)]
    schema = "task_no int, seed_id bigint, pos int, node_id bigint, table_name string, col_id bigint, f2p_nbr_ids array<bigint>, is_target boolean"
    return stage_buckets(spark.createDataFrame(rows, schema), "cells", P.CONTEXT, 3)


def test_relations_without_a_shuffle(cells):
    found = {
        "rows": R.row_relations(cells),
        "edges": R.induced_edges(R.context_rows(cells)),
        "summary": R.context_summary(cells),
        "density": R.mask_density(cells),
        "columns": R.column_relations(cells),
        "tables": R.table_counts(cells),
    }
    for name, df in found.items():
        assert "Exchange hashpartitioning" not in plan(df), name
    rows = {(r.seed_id, r.node_id): (r.q_pos, r.parent_kv, r.feat_kv, r.nbr_kv) for r in found["rows"].collect()}
    assert rows == {
        (1, 10): ([0, 1], [0, 1, 2], [0, 1, 2], [0, 1]),
        (1, 11): ([2], [], [2], [0, 1, 3]),
        (1, 12): ([3], [2], [2, 3], []),
        (2, 11): ([0], [], [0], []),
    }
    assert sorted((r.seed_id, r.node_id, r.parent_id) for r in found["edges"].collect()) == [(1, 10, 10), (1, 10, 11), (1, 12, 11)]
    assert sorted((r.seed_id, r.n_nodes, r.n_targets, r.n_edges) for r in found["summary"].collect()) == [(1, 3, 1, 3), (2, 1, 1, 0)]
    density = sorted((r.seed_id, r.n_cells, r.feat_pairs, r.nbr_pairs, r.col_pairs, r.full_pairs) for r in found["density"].collect())
    assert density == [(1, 4, 6 + 3, 4 + 3, 4 + 1 + 1, 16), (2, 1, 1, 0, 1, 1)]


def test_cells_leave_by_context(spark):
    nodes = spark.createDataFrame(
        [(1, 0, 1, None, 1, 0, 0.0, 0, "", 0, 2, 0), (1, 0, 1, None, 2, 1, 0.5, 0, "", 1, 2, 2)],
        "item_id bigint, task_no int, seed_id bigint, seed_ts bigint, node_id bigint, level int, key double, tie bigint, path string, depth int, n_cells int, before bigint",
    )
    payload = spark.createDataFrame(
        [(1, "a", None, False, 2, [], [2]), (2, "b", None, False, 2, [], [])],
        "node_id bigint, table_name string, ts_sec bigint, is_task boolean, n_cells int, ups array<bigint>, f2p_nbr_ids array<bigint>",
    )
    cells = spark.range(4).select(
        (F.col("id") % 2 + 1).alias("node_id"), F.floor(F.col("id") / 2).cast("int").alias("cell_ord"), F.col("id").alias("col_id"),
        F.lit(0).cast("tinyint").alias("sem_type"), F.lit(0.5).cast("float").alias("number_value"), F.lit(0).cast("bigint").alias("text_id"),
        F.lit(0.0).cast("float").alias("datetime_value"), F.lit(0.0).cast("float").alias("boolean_value"), F.lit(-1).cast("bigint").alias("class_value_id"),
    )
    shown = P.context_cells(nodes, payload, cells, [], 3, parts=3)
    assert [(r.pos, r.node_id, r.col_id) for r in shown.orderBy("pos").collect()] == [(0, 1, 0), (1, 1, 2), (2, 2, 1)]
    assert plan(B.pad_contexts(shown, 3, ["a", "b"], 1)).count("Exchange hashpartitioning") == plan(shown).count("Exchange hashpartitioning") > 0
