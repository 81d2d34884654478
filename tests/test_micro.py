"""A hand-made database with every odd case, and what must come out of it."""

from datetime import datetime, timezone

import pytest

from rowloom.operators import graph as G, payload as P, sampling as SP
from rowloom.operators.closure import ancestors
from rowloom.plans import pipeline as PL
from rowloom.session import stage
from rowloom.sources.catalog import Catalog, Table
from rowloom.sources.tasks import Task, seeds


def at(sec):
    return None if sec is None else datetime.fromtimestamp(sec, timezone.utc)


@pytest.fixture(scope="module")
def graph(spark):
    nan = float("nan")
    make = spark.createDataFrame
    a = make([(0, True, 1.0, "x"), (1, True, nan, None), (2, True, None, "y")], "a_id long, flag boolean, x double, name string")
    b = make(
        [(0, 0, 1, None, at(100), 10), (1, 2, 2, 0, None, 20), (2, None, 0, 1, at(300), None)],
        "b_id long, a1 long, a2 long, boss long, t timestamp, v int",
    )
    c = make([(0, at(100)), (1, at(200)), (2, at(300))], "b long, t timestamp")
    d = make([(0,)], "d_id long")
    t1 = "a long, t timestamp, y boolean"
    t2 = make([(0, at(10), 5.0)], "a long, t timestamp, y double")
    toa = (("a", "a"),)
    tables = [
        Table("a", a, pkey="a_id", order="pkey"),
        Table("b", b, pkey="b_id", fkeys=(("a1", "a"), ("a2", "a"), ("boss", "b")), time_col="t", order="pkey"),
        Table("c", c, fkeys=(("b", "b"),), time_col="t", order=("b",)),
        Table("d", d, pkey="d_id", order="pkey"),
        Table("t1", make([(0, at(200), True), (0, at(250), None), (2, at(50), False)], t1), "train", fkeys=toa, time_col="t", order=("a", "t")),
        Table("t1", make([(0, at(400), True)], t1), "val", fkeys=toa, time_col="t", order=("a", "t")),
        Table("t1", make([(2, at(500), False)], t1), "test", fkeys=toa, time_col="t", order=("a", "t")),
        Table("t2", t2, "train", fkeys=toa, time_col="t", order=("a", "t")),
    ]
    return PL.stage_graph(G.build_graph(spark, Catalog.of(tables, "micro")))


# Node ids: a 0-2, b 3-5, c 6-8, d 9, t1 test 10, t1 train 11-13, t1 val 14, t2 15.
def test_ranges(graph):
    assert graph.ranges == {
        ("a", "db"): (0, 3), ("b", "db"): (3, 3), ("c", "db"): (6, 3), ("d", "db"): (9, 1), ("t1", "test"): (10, 1),
        ("t1", "train"): (11, 3), ("t1", "val"): (14, 1), ("t2", "train"): (15, 1),
    }
    assert graph.catalog.has_cycle()


def test_nodes(graph):
    got = {r.node_id: (r.ts_sec, r.is_task, r.n_cells) for r in graph.nodes.collect()}
    assert got == {
        0: (None, False, 3), 1: (None, False, 1), 2: (None, False, 2),
        3: (100, False, 2), 4: (None, False, 1), 5: (300, False, 1),
        6: (100, False, 1), 7: (200, False, 1), 8: (300, False, 1), 9: (None, False, 0),
        10: (500, True, 2), 11: (200, True, 2), 12: (250, True, 1), 13: (50, True, 2), 14: (400, True, 2), 15: (10, True, 2),
    }


def test_compat_leaves_unlinked_rows_without_time(spark, graph):
    numbered = G.number_rows(Catalog.of([t for t in graph.catalog.tables if t.name in ("a", "b")], "m"))
    got = {r.node_id: r.ts_sec for r in G.nodes(numbered, compat=True).collect()}
    assert got[3] == 100 and got[5] == 300 and got[0] is None


def test_edges(graph):
    got = sorted((r.child_id, r.fk_pos, r.parent_id, r.child_ts, r.parent_ts) for r in graph.edges.collect() if r.child_id < 10)
    assert got == [
        (3, 0, 0, 100, None), (3, 1, 1, 100, None), (4, 0, 2, None, None), (4, 1, 2, None, None), (4, 2, 3, None, 100),
        (5, 1, 0, 300, None), (5, 2, 4, 300, None), (6, 0, 3, 100, 100), (7, 0, 4, 200, None), (8, 0, 5, 300, 300),
    ]


def test_parents_and_children(graph):
    up = {r.child_id: r.parent_ids for r in G.parents_list(graph.edges).collect()}
    assert up[4] == [2, 2, 3] and up[5] == [0, 4] and 9 not in up
    down = {r.parent_id: r.child_ids for r in G.children_list(graph.edges).collect()}
    assert down[2] == [4, 4, 10, 13] and down[0] == [3, 5, 11, 12, 14, 15]


def test_cells(graph):
    index = {r.col_id: f"{r.col_name} of {r.table_name}" for r in graph.column_index.collect()}
    texts = {r.text_id: r.text for r in graph.text_dict.collect()}
    got = {}
    for r in graph.cells.orderBy("node_id", "cell_ord").collect():
        value = texts[r.text_id] if r.sem_type == 1 else [r.number_value, None, r.datetime_value, r.boolean_value][r.sem_type]
        assert (r.class_value_id == -1) == (r.sem_type != 1)
        got.setdefault(r.node_id, []).append((index[r.col_id], value))
    assert got[0] == [("flag of a", 0.0), ("x of a", 0.0), ("name of a", "x")]
    assert got[1] == [("flag of a", 0.0)]
    assert [c for c, _ in got[2]] == ["flag of a", "name of a"]
    assert [c for c, _ in got[4]] == ["v of b"] and 9 not in got
    assert [round(got[n][-1][1], 4) for n in (3, 4)] == [-0.7071, 0.7071]
    # The validation row is scaled by the train mean (one true, one false).
    assert round(got[14][1][1], 4) == round(0.5 / 0.5**0.5, 4)


def test_stats(graph):
    got = {(r.table_name, r.split, r.col_name): (r.mean, r.std) for r in graph.col_stats.collect()}
    assert got[("a", "db", "flag")] == (1.0, 1.0) and got[("a", "db", "x")] == (1.0, 1.0) and got[("a", "db", "name")] == (0.0, 0.0)
    assert got[("t1", "val", "y")] == got[("t1", "train", "y")]
    times = [100, 300, 100, 200, 300, 200, 250, 50, 400, 500, 10]
    mean = sum(times) / len(times)
    std = (sum((t - mean) ** 2 for t in times) / len(times)) ** 0.5
    assert got[("b", "db", "t")] == pytest.approx((mean * 1e6, std * 1e6))


def test_ancestors_with_self_reference(graph):
    got = {(r.node_id, r.ancestor_id): (r.hops, r.path) for r in ancestors(graph.nodes, graph.edges, None).collect()}
    mine = {k[1]: v for k, v in got.items() if k[0] == 8}
    # c2 -> b2 -> (boss b1 -> (boss b0 -> a1, a0), a2), a0: the last key is followed first.
    assert mine[5] == (1, "999") and mine[4] == (2, "999997") and mine[3] == (3, "999997997")
    assert mine[0] == (4, "999997997999") and mine[2] == (3, "999997998") and len(mine) == 7
    assert got[(9, 9)] == (0, "")


def test_contexts(spark, graph):
    task = Task("micro", "t1", "y")
    tasks = PL.resolve_splits(graph, [(task, "train")])
    pool = stage(seeds(graph.nodes, graph.cells, tasks), "seeds")
    # The row without a label is no seed.
    assert sorted(r.seed_id for r in pool.collect()) == [11, 13]
    index = PL.index_graph(graph)
    config = PL.run_config(tasks, 99, 1000)
    nodes = PL.contexts(graph, index, tasks, pool, config)
    rows = {}
    for r in SP.with_node_pos(stage(nodes, "n")).orderBy("seed_id", "node_pos").collect():
        rows.setdefault(r.seed_id, []).append(r.node_id)
    # Seed 11 (a0, t=200): a0; b0 (t=100) with a1; then b1 (no time) with a2; c0, c1. Newer rows, the unlabelled row of
    # t=250, the other split's newer row and the other task's row stay out; t1 at 50 belongs to a2 and is older.
    assert rows[11][:2] == [11, 0] and set(rows[11]) == {11, 0, 3, 1, 4, 2, 6, 7, 13}
    assert 15 not in rows[11] and 12 not in rows[11] and 5 not in rows[11]
    # Seed 13 (a2, t=50): b1 has no time; its boss b0 is a parent and is shown although it is newer.
    assert set(rows[13]) == {13, 2, 4, 3, 1, 0}
    cells = P.context_cells(stage(nodes, "n"), index.payload, graph.cells, tasks, 1000).collect()
    targets = [(r.seed_id, r.node_id) for r in cells if r.is_target]
    assert sorted(targets) == [(11, 11), (13, 13)]
    for seed in (11, 13):
        pos = sorted(r.pos for r in cells if r.seed_id == seed)
        assert pos == list(range(len(pos)))
