"""Several databases in one pool, vectors in batches, beside each database alone."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.functions import udfs as U
from rowloom.operators import assemble as B, graph as G, sampling as SP
from rowloom.operators.pool import count_cells, pool_graphs
from rowloom.operators.util import DB_SHIFT
from rowloom.plans import pipeline as PL
from rowloom.session import stage
from rowloom.sources import tasks as T
from rowloom.sources.catalog import Catalog, Table
from rowloom.sources.tasks import Task

BUYERS = Task("shop", "visits", "late", (), "forecast", "clf")
STAFF = Task("firm", "staff", "pay", ("level",), "autocomplete", "reg")


def shop(spark):
    buyers = spark.createDataFrame([(i, f"name {i % 3}", float(i)) for i in range(8)], "id long, name string, age double")
    sales = spark.createDataFrame([(i % 8, f"item {i % 5}", 100 + i) for i in range(60)], "buyer long, item string, at int")
    sales = sales.select("buyer", "item", F.timestamp_seconds("at").alias("at"))
    visits = spark.createDataFrame([(i % 8, 110 + 5 * i, i % 2 == 0) for i in range(10)], "buyer long, at int, late boolean")
    visits = visits.select("buyer", F.timestamp_seconds("at").alias("at"), "late")
    return Catalog.of(
        [
            Table("buyers", buyers, pkey="id", order="pkey"),
            Table("sales", sales, fkeys=(("buyer", "buyers"),), time_col="at", order=("at",)),
            Table("visits", visits, split="train", fkeys=(("buyer", "buyers"),), time_col="at", order=("at",)),
        ],
        "shop",
    )


def firm(spark):
    offices = spark.createDataFrame([(i, f"city {i}") for i in range(3)], "id long, city string")
    staff = spark.createDataFrame([(i, i % 3, None if i % 7 == 0 else float(i * i), i % 4) for i in range(25)], "id long, office long, pay double, level int")
    return Catalog.of([Table("offices", offices, pkey="id", order="pkey"), Table("staff", staff, pkey="id", fkeys=(("office", "offices"),), order="pkey")], "firm")


@pytest.fixture(scope="module")
def graphs(spark):
    return {name: PL.stage_graph(G.build_graph(spark, make(spark))) for name, make in (("shop", shop), ("firm", firm))}


def contexts(graph, index, wanted, width=3, seq_len=12):
    tasks = PL.resolve_splits(graph, wanted)
    pool = stage(T.seeds(graph.nodes, graph.cells, tasks), "seeds")
    rows = SP.with_node_pos(PL.contexts(graph, index, tasks, pool, PL.run_config(tasks, width, seq_len))).collect()
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.task_no, r.seed_id, r.node_pos)):
        out[r.task_no, r.seed_id].append((r.node_id, r.depth, r.before))
    return dict(out)


def test_a_pool_gives_what_each_database_gives(spark, graphs):
    pool = pool_graphs(graphs)
    both = contexts(pool, PL.index_graph(pool), [(STAFF, "train"), (BUYERS, "train")])
    for task_no, (task, db_no) in enumerate(((STAFF, 1), (BUYERS, 0))):
        graph = graphs[task.db]
        alone = contexts(graph, PL.index_graph(graph), [(task, "train")])
        up = db_no << DB_SHIFT
        assert {s - up: [(n - up, d, b) for n, d, b in rows] for (t, s), rows in both.items() if t == task_no} == {s: rows for (_, s), rows in alone.items()}
    assert len(both) == 10 + 25 - 4


def test_unknown_database(graphs):
    with pytest.raises(ValueError, match="no database mall"):
        PL.resolve_splits(pool_graphs(graphs), [(Task("mall", "staff", "pay"), "train")])


def test_batches_of_a_pool_and_their_vectors(spark, graphs):
    pool = pool_graphs(graphs)
    tasks = PL.resolve_splits(pool, [(STAFF, "train"), (BUYERS, "train")])
    batches = stage(PL.training_batches(pool, PL.index_graph(pool), tasks, width=3, seq_len=12, batch_size=4, world_size=2), "batches")
    vectors = stage(U.embed_texts(pool.text_dict), "vectors")
    rows, blocks = B.batch_vectors(batches, vectors, pool.column_index, pool.text_dict.select("text_id", "n_uses"))
    known = {r["text_id"]: np.array(r["vec"]) for r in vectors.collect()}
    names = {r["col_id"]: known[r["name_text_id"]] for r in pool.column_index.collect()}
    by_batch = {(r["rank"], r["batch_idx"]): r for r in blocks.collect()}
    got = rows.collect()
    assert len(got) == batches.count() == 32 and {r["task_no"] for r in got} == {0, 1}
    seen = defaultdict(set)
    for r in got:
        block = by_batch[r["rank"], r["batch_idx"]]
        assert len(r["text_at"]) == len(r["name_at"]) == 12
        seen[r["rank"], r["batch_idx"]] |= {i for i, p in zip(r["class_value_ids"], r["is_padding"]) if i >= 0 and not p}
        for text, col, pad, at, name in zip(r["class_value_ids"], r["col_ids"], r["is_padding"], r["text_at"], r["name_at"]):
            assert (at >= 0) == (text >= 0 and not pad) and (name >= 0) == (not pad)
            if at >= 0:
                assert (np.array(block["text_block"][at]) == known[text]).all()
            if name >= 0:
                assert (np.array(block["name_block"][name]) == names[col]).all()
    # Each distinct text of a batch has one vector there.
    assert {k: len(by_batch[k]["text_block"]) for k in seen} == {k: len(v) for k, v in seen.items()}


def test_a_stored_index_samples_alike(spark, graphs, tmp_path):
    graph = graphs["shop"]
    index = PL.index_graph(graph)
    PL.write_index(index, str(tmp_path / "index"))
    again = PL.read_index(spark, str(tmp_path / "index"))
    wanted = [(BUYERS, "train")]
    assert contexts(graph, again, wanted) == contexts(graph, index, wanted)
    index.adjacency.runs.limit(1).write.mode("overwrite").parquet(str(tmp_path / "index" / "runs"))
    with pytest.raises(ValueError, match="damaged"):
        PL.read_index(spark, str(tmp_path / "index"))


def test_values_meet_no_shuffle(spark):
    from rowloom.operators.stats import column_stats
    from rowloom.operators import dictionary as D

    numbered = G.number_rows(firm(spark))
    stats = stage(column_stats(numbered.catalog), "col_stats")
    texts = stage(D.build_dictionary(G.table_texts(numbered.catalog), D.schema_texts(spark, numbered.catalog)), "text_dict")
    plan = G.value_cells(numbered, stats)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert G.cells(numbered, stats, texts).count() == 3 + 25 * 2 - 4


def test_cells_of_a_pool_are_counted_without_moving_ids(spark, graphs):
    cells = pool_graphs(graphs).cells
    # Ids around the edges of the 64-bit words, several cells per row.
    more = spark.range(400).selectExpr("id % 131 AS node_id", "id % 7 AS col_id", "CAST(id % 2 AS TINYINT) AS sem_type", "'more' AS db")
    for some in (cells.select("db", "sem_type", "node_id", "col_id"), more.select("db", "sem_type", "node_id", "col_id")):
        got = count_cells(some)
        assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
        want = defaultdict(lambda: [0, set(), set()])
        for r in some.collect():
            w = want[r.db, r.sem_type]
            w[0] += 1
            w[1].add(r.node_id)
            w[2].add(r.col_id)
        told = {(r.db, r.sem_type): (r.n_cells, r.n_nodes, r.n_cols) for r in got.collect()}
        assert told == {k: (n, len(a), len(b)) for k, (n, a, b) in want.items()}
