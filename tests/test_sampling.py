import random

import pytest

from rowloom.operators import adjacency as A, closure as CL, sampling as SP
from rowloom.operators.payload import node_payload
from rowloom.session import stage
from walk import context

NODES = "node_id long, n_cells int"
EDGES = "child_id long, fk_pos int, parent_id long, child_class int, child_ts long, child_cells int"


def random_graphs(seed, n_graphs, self_loops=False):
    """Small row graphs side by side, with several keys to one parent and missing times."""
    rng = random.Random(seed)
    cells, edges, seeds, base = {}, [], [], 0
    for _ in range(n_graphs):
        n = rng.randint(2, 14)
        kind = {}
        ts = {}
        for i in range(n):
            node = base + i
            cells[node] = rng.choice([0, 1, 2, 3])
            kind[node] = rng.choice([0, 0, 0, 1, 2])
            ts[node] = rng.choice([None, *range(8)])
        for i in range(1, n):
            node = base + i
            for pos in range(rng.randint(0, 3)):
                options = [p for p in range(base, node) if kind[p] == 0]
                if options:
                    edges.append((node, pos, rng.choice(options), kind[node], ts[node], cells[node]))
        for i in range(n):
            node = base + i
            seeds.append((0, node, ts[node], kind[node]))
        base += n
    return cells, edges, seeds


def sampled(spark, cells, edges, seeds, width, seq_len, hops=None, **options):
    nodes = spark.createDataFrame(list(cells.items()), NODES)
    e = stage(spark.createDataFrame(edges, EDGES), "edges")
    flat = nodes.selectExpr("node_id", "'t' AS table_name", "CAST(NULL AS BIGINT) AS ts_sec", "false AS is_task", "n_cells")
    payload = stage(node_payload(flat, e), "payload")
    closure = stage(CL.parent_closure(nodes, e, hops), "closure")
    pool = spark.createDataFrame(seeds, "task_no int, seed_id long, seed_ts long, seed_class int")
    config = SP.SampleConfig(width=width, seq_len=seq_len, **options)
    rows = SP.with_node_pos(SP.sample_contexts(pool, payload, A.build_adjacency(e, payload), closure, config)).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.seed_id, r.node_pos)):
        out.setdefault(r.seed_id, []).append((r.node_id, r.depth))
    return out


def walked(cells, edges, seeds, width, seq_len, **options):
    order = sorted(edges, key=lambda e: (e[2], e[3], e[4] is not None, e[4] or 0, e[0], e[1]))
    parents, children = {}, {}
    for place, (child, pos, parent, kind, ts, _) in enumerate(order):
        parents.setdefault(child, []).append((pos, parent))
        children.setdefault(parent, {}).setdefault(kind, []).append((place, child, ts))
    return {s: context(s, ts, kind, parents, children, cells, width, seq_len, **options) for _, s, ts, kind in seeds}


@pytest.mark.parametrize("width,seq_len", [(1, 5), (2, 12), (99, 1000)])
def test_same_as_a_walk(spark, width, seq_len):
    cells, edges, seeds = random_graphs(width * 31 + seq_len, 60)
    got = sampled(spark, cells, edges, seeds, width, seq_len)
    assert got == walked(cells, edges, seeds, width, seq_len)


def test_known_depth_gives_the_same(spark):
    cells, edges, seeds = random_graphs(5, 30)
    assert sampled(spark, cells, edges, seeds, 2, 20, hops=14) == walked(cells, edges, seeds, 2, 20)


def test_epoch_and_seed_change_the_sample(spark):
    edges = [(i, 0, 0, 0, i % 5, 1) for i in range(1, 60)]
    cells = {i: 1 for i in range(60)}
    seeds = [(0, 0, 3, 0)]
    first = sampled(spark, cells, edges, seeds, 5, 50)
    assert first == sampled(spark, cells, edges, seeds, 5, 50)
    assert first == walked(cells, edges, seeds, 5, 50)
    other = sampled(spark, cells, edges, seeds, 5, 50, epoch=1)
    assert other != first and other == walked(cells, edges, seeds, 5, 50, epoch=1)
    assert len(first[0]) == 6 and all(n == 0 or (n % 5) <= 3 for n, _ in first[0])


def test_strict_time_hides_rows_of_the_same_moment(spark):
    cells = {0: 1, 1: 1, 2: 1, 3: 1}
    edges = [(1, 0, 0, 1, 10, 1), (2, 0, 0, 1, 10, 1), (3, 0, 0, 1, 9, 1)]
    seeds = [(0, 1, 10, 1)]
    loose = sampled(spark, cells, edges, seeds, 5, 50)
    strict = sampled(spark, cells, edges, seeds, 5, 50, strict_time=True)
    assert {n for n, _ in loose[1]} == {0, 1, 2, 3} and {n for n, _ in strict[1]} == {0, 1, 3}


def test_very_long_task_history_is_cut_where_it_cannot_show(spark):
    """An entity with many more task rows than a context has cells: the context is full, ordered and fair."""
    n, seq_len = 600, 8
    cells = {i: 1 for i in range(n + 1)}
    edges = [(i, 0, 0, 1, i, 1) for i in range(1, n + 1)]
    seeds = [(0, i, i, 1) for i in range(1, n + 1)]
    got = sampled(spark, cells, edges, seeds, 4, seq_len)
    hits = [0, 0]
    # The head of each run is the walk's, drawn with the same key.
    for i in range(1, n + 1):
        rows = [r for r, _ in got[i]]
        assert rows[0] == i and rows[1] == 0 and len(rows) == len(set(rows)) == min(seq_len, i + 1)
        assert all(r <= i for r in rows[1:])
        if i > 100:
            hits[0] += sum(r <= i / 2 for r in rows[2:])
            hits[1] += len(rows) - 2
    assert abs(hits[0] / hits[1] - 0.5) < 0.05


def test_visible_counts_match_brute_force(spark):
    rng = random.Random(3)
    edges = []
    for i in range(4000):
        parent = 0 if rng.random() < 0.4 else rng.randint(1, 40)
        # The hot parent has long quiet spells between bursts.
        ts = None if rng.random() < 0.1 else rng.choice([0, 7, 1_000_000, 5_000_000]) + rng.randint(-300, 300)
        edges.append((1000 + i, 0, parent, rng.choice([0, 1]), ts, 1))
    e = spark.createDataFrame(edges, EDGES)
    nodes = e.selectExpr("child_id AS node_id", "'t' AS table_name", "child_ts AS ts_sec", "false AS is_task", "child_cells AS n_cells")
    adjacency = A.build_adjacency(e, stage(node_payload(nodes, e), "payload"))
    asked = [(p, k, t) for p in range(41) for k in (0, 1) for t in (-400, -5, 0, 150, 400, 999_000, 1_000_050, 3_000_000, 6_000_000, A.NO_TIME)]
    q = spark.createDataFrame(asked, "parent_id long, child_class int, seed_ts long")
    got = {(r.parent_id, r.child_class, r.seed_ts): r.n for r in A.visible_counts(adjacency, q).collect()}
    for p, k, t in asked:
        want = sum(e[2] == p and e[3] == k and (e[4] is None or e[4] <= t) for e in edges)
        assert got.get((p, k, t), 0) == want, (p, k, t)


def test_times_of_any_year(spark):
    """Blocks of times stay short whatever the dates, and runs of several levels are searched to the end."""
    from datetime import datetime, timezone

    seconds = lambda y: int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp())
    rng = random.Random(9)
    n = 70_000
    times = [seconds(1), seconds(9999), *[seconds(2020) + rng.randint(0, 5000) for _ in range(n - 2)]]
    e = spark.createDataFrame([(10 + i, 0, 0, 0, t, 1) for i, t in enumerate(times)] + [(10 + n, 0, 0, 0, None, 1)], EDGES)
    nodes = e.selectExpr("child_id AS node_id", "'t' AS table_name", "child_ts AS ts_sec", "false AS is_task", "child_cells AS n_cells")
    adjacency = A.build_adjacency(e, stage(node_payload(nodes, e), "payload"))
    assert adjacency.height == 3
    assert adjacency.times.selectExpr("max(size(ts))").first()[0] == A.BLOCK
    asked = [seconds(1) - 1, seconds(1), seconds(1000), seconds(9998), seconds(9999), *[seconds(2020) + k * 97 for k in range(60)]]
    q = spark.createDataFrame([(0, 0, t) for t in asked], "parent_id long, child_class int, seed_ts long")
    got = {r.seed_ts: r.n for r in A.visible_counts(adjacency, q).collect()}
    times.sort()
    from bisect import bisect_right

    assert got == {t: 1 + bisect_right(times, t) for t in asked}


def test_draws_are_a_permutation_and_fair(spark):
    from pyspark.sql import functions as F
    from rowloom.operators.draws import drawn
    from walk import choose, h60

    asked = [(n, k, many, h60(n, k, many)) for n in [*range(1, 30), 1000, 1025, 5000, 10**12] for k in {1, min(n, 3), min(n, 40)} for many in {k, n}]
    q = spark.createDataFrame(asked, "n long, k long, of long, question long")
    got = {}
    for r in drawn(q).collect():
        got.setdefault((r.n, r.k, r.of, r.question), []).append((r.offset, r.key))
    for n, k, many, h in asked:
        rows = got[n, k, many, h]
        assert len({o for o, _ in rows}) == k and all(0 <= o < n for o, _ in rows)
        want = sorted(choose(n, k, many, h))
        assert [o for o, _ in sorted(rows)] == [o for o, _ in want]
        assert [x for _, x in sorted(rows)] == pytest.approx([x for _, x in want])
    # Every pair of places is drawn about equally often.
    many = spark.range(6000).select(F.lit(7).alias("n"), F.lit(2).alias("k"), F.lit(2).alias("of"), (F.abs(F.xxhash64("id")) % (1 << 60)).alias("question"), "id")
    pairs = drawn(many.selectExpr("CAST(n AS BIGINT) n", "CAST(k AS BIGINT) k", "CAST(of AS BIGINT) of", "question", "id")).groupBy("id").agg(F.sum(F.expr("1L << CAST(offset AS INT)")).alias("set"))
    counts = [r["count"] for r in pairs.groupBy("set").count().collect()]
    assert len(counts) == 21 and all(abs(c - 6000 / 21) < 5 * (6000 / 21) ** 0.5 for c in counts)


def test_sampling_is_uniform(spark):
    """Over many seeds every child of a parent is drawn about equally often."""
    n, width, n_seeds = 20, 5, 2000
    cells = {i: 1 for i in range(n + 1 + n_seeds)}
    edges = [(i, 0, 0, 0, None, 1) for i in range(1, n + 1)]
    edges += [(n + 1 + s, 0, 0, 1, s, 1) for s in range(n_seeds)]
    seeds = [(0, n + 1 + s, -1, 2) for s in range(n_seeds)]
    got = sampled(spark, cells, edges, seeds, width, 50)
    times = [0] * (n + 1)
    for rows in got.values():
        for node, _ in rows:
            if 1 <= node <= n:
                times[node] += 1
    want = n_seeds * width / n
    assert all(abs(t - want) < 5 * want**0.5 for t in times[1:])


def test_other_tasks_of_a_pool_do_not_widen_the_draw(spark):
    """Leakage columns of an orders task say nothing about the rows of the churn task."""
    from dataclasses import replace

    from rowloom.operators import sampling as SP
    from rowloom.plans import pipeline as PL
    from rowloom.plans.local import CHURN, ORDER_TOTAL
    from rowloom.plans.queries import run_for

    run = run_for(spark, "/root/testdata/sf0.001")
    alone = PL.resolve_splits(run.graph, [(CHURN, "train")])
    wide = replace(ORDER_TOTAL, drop_cols=("o_orderstatus", "o_orderpriority"))
    mixed = PL.resolve_splits(run.graph, [(CHURN, "train"), (wide, "train")])
    first = SP.with_ancestors(SP.first_level(run.churn_seeds, run.index.payload), run.index.closure).filter("depth = 1")
    drawn = [
        SP.expand(first, run.index.adjacency, PL.run_config(tasks, 4, 1)).filter("child_class > 0").count() for tasks in (alone, mixed)
    ]
    assert drawn[0] == drawn[1] > 0


def test_few_visited_rows_read_the_index_without_a_shuffle(spark, monkeypatch):
    cells, edges, seeds = random_graphs(5, 40)
    few = sampled(spark, cells, edges, seeds, 2, 12)
    monkeypatch.setattr(SP, "FEW", -1)
    assert sampled(spark, cells, edges, seeds, 2, 12) == few == walked(cells, edges, seeds, 2, 12)

    links = spark.range(60_000).selectExpr(
        "id + 10 AS child_id", "0 AS fk_pos", "id % 10 AS parent_id", "0 AS child_class", "id AS child_ts", "3 AS child_cells",
        "CAST(array() AS array<struct<fk_pos:int,step:string,parent_id:bigint>>) AS ups",
    )
    index = A.build_adjacency(links, None)
    visited = spark.range(3).selectExpr("id AS item_id", "0 AS seed_class", "100L AS item_ts", "id AS node_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    try:
        config = SP.SampleConfig(width=4, seq_len=16)
        found = SP.expand(visited, index, config, few=True)
        assert "hashpartitioning(adj_pos" not in found._jdf.queryExecution().executedPlan().toString()
        plain = SP.expand(visited, index, config)
        assert "hashpartitioning(adj_pos" in plain._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
