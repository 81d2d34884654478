"""What is read off the rows beside the same tables by way of joins."""

import pytest
from pyspark.sql import functions as F

from rowloom.operators import adjacency as A, closure as CL, graph as G, lineage as L, payload as P
from rowloom.plans import pipeline as PL
from rowloom.plans.local import CHURN, LINE_OPEN, ORDER_TOTAL, local_catalog
from rowloom.plans.queries import QUERIES, run_for
from rowloom.session import stage
from rowloom.sources import tasks as T
from rowloom.sources.catalog import Catalog, Table

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def numbered(spark):
    return G.number_rows(local_catalog(spark, SF_DIR))


@pytest.fixture(scope="module")
def graph(numbered):
    nodes, edges = stage(G.nodes(numbered), "nodes"), stage(G.edges(numbered), "edges")
    return nodes, edges, stage(P.node_payload(nodes, edges), "payload")


def same(a, b):
    b = b.select(*a.columns)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def shuffles(df):
    """Exchanges by the id of a row; the offsets of sorted partitions are a few rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(plan.count(f"hashpartitioning({c}#") for c in ("node_id", "child_id", "parent_id"))


def test_payload_and_links_need_no_shuffle(numbered, graph):
    nodes, edges, payload = graph
    rows = G.row_payload(numbered)
    assert shuffles(rows) == 0 and shuffles(G.row_links(numbered)) == 0
    same(payload, rows)
    kept = ["child_id", "fk_pos", "fk_col", "parent_id", "child_table", "child_split", "child_class", "child_ts", "child_cells"]
    same(edges.select(*kept), G.row_links(numbered))


def test_entries_carry_the_other_parents(numbered, graph):
    _, edges, payload = graph
    same(A.build_adjacency(edges, payload).entries, A.build_adjacency(G.row_links(numbered), None).entries)


def test_parents_list_needs_no_shuffle(spark):
    assert shuffles(QUERIES["parents_list"](run_for(spark, SF_DIR))) == 0


def test_seeds_from_rows(numbered, graph):
    wanted = [(CHURN, "val"), (ORDER_TOTAL, "train"), (LINE_OPEN, "train")]
    tasks = PL.resolve_rows(numbered.catalog, numbered.ranges, wanted)
    assert shuffles(T.row_seeds(numbered, tasks)) == 0
    cells = stage(G.all_raw_cells(numbered).select("node_id", "col_id"), "raw")
    same(T.seeds(graph[0], cells, tasks), T.row_seeds(numbered, tasks))


def test_ancestors_by_their_parents(numbered, graph):
    nodes, edges, _ = graph
    hops = numbered.catalog.max_hops()
    want = CL.ancestor_paths(nodes, edges, hops)
    same(want, CL.ancestors(nodes, edges, hops))
    same(want, CL.ancestors(nodes, G.row_links(numbered), hops))


def test_numbering_without_values(spark, numbered):
    slim = G.number_rows(local_catalog(spark, SF_DIR), values=False)
    same(G.nodes(numbered), G.nodes(slim))
    same(G.edges(numbered), G.edges(slim))
    line = slim.rows[("lineitem", "db")].columns
    assert "l_quantity" not in line and "l_extendedprice" not in line and G.N_CELLS in line


def test_numbering_without_values_counts_an_index_cell(spark):
    df = spark.createDataFrame([(1, 0.5), (0, None), (2, float("nan"))], "k int, v double")
    t = Table("t", df, order=("k",), index_cell="dummy")
    told = G.nodes(G.number_rows(Catalog.of([t], "m"), values=False))
    assert [tuple(r) for r in told.select("row_idx", "n_cells").orderBy("row_idx").collect()] == [
        tuple(r) for r in G.nodes(G.number_rows(Catalog.of([t], "m"))).select("row_idx", "n_cells").orderBy("row_idx").collect()
    ]


def test_lineage_along_the_schema(spark, numbered, graph):
    nodes, edges, _ = graph
    want = CL.ancestor_paths(nodes, edges, numbered.catalog.max_hops())
    same(want, L.row_ancestors(numbered))
    same(want, L.row_ancestors(G.number_rows(local_catalog(spark, SF_DIR), values=False)))
    closure = CL.parent_closure(nodes, edges, numbered.catalog.max_hops())
    met = L.row_closure(numbered).join(closure.select("node_id").distinct(), "node_id", "left_semi")
    same(closure, met)


def test_lineage_with_gaps_and_two_ways_to_one_row(spark):
    """b points twice to a, so c reaches a by b and by itself; null keys and keys without a parent."""
    a = spark.createDataFrame([(i, float(i)) for i in range(4)], "a int, x double")
    b = spark.createDataFrame([(0, 1, 1, 1.0), (1, 2, 3, None), (2, None, 9, 2.0)], "b int, a1 int, a2 int, y double")
    c = spark.createDataFrame([(i, i % 4 if i % 3 else None, 1) for i in range(9)], "i int, b int, a int")
    tables = [
        Table("a", a, pkey="a", order="pkey"),
        Table("b", b, pkey="b", fkeys=(("a1", "a"), ("a2", "a")), order="pkey"),
        Table("c", c, fkeys=(("b", "b"), ("a", "a")), order=("i",)),
    ]
    numbered = G.number_rows(Catalog.of(tables, "gaps"))
    nodes, edges = G.nodes(numbered), G.edges(numbered)
    same(CL.ancestor_paths(nodes, edges, 2), L.row_ancestors(numbered))
    closure = CL.parent_closure(nodes, edges, 2)
    same(closure, L.row_closure(numbered).join(closure.select("node_id").distinct(), "node_id", "left_semi"))


def test_no_lineage_in_a_cycle(spark):
    t = Table("t", spark.createDataFrame([(0, None), (1, 0)], "t int, boss int"), pkey="t", fkeys=(("boss", "t"),), order="pkey")
    numbered = G.number_rows(Catalog.of([t], "cycle"))
    assert L.row_ancestors(numbered) is None and L.row_closure(numbered) is None


def test_ids_are_not_gathered_in_hash_tables(spark, numbered):
    """Packed ids are small in shuffle files and large in a task's memory: joins between shuffled rows must be able to spill."""
    edges = G.row_links(numbered)
    parents = edges.select(edges["parent_id"].alias("child_id")).distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        met = edges.select("child_id").join(parents, "child_id", "left_semi")
        met.collect()
        assert "ShuffledHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_entries_hold_plain_ids_and_name_them_where_they_are_met(spark, numbered):
    entries = A.build_adjacency(G.row_links(numbered), None)
    places = spark.range(0, 60_000, 7).select(F.col("id").alias("adj_pos"))
    met = A.children_at(entries, places)
    same(met, places.join(entries.entries.select("adj_pos", "child_id", "child_cells", "ups"), "adj_pos"))
    named = A.Adjacency(entries.entries.drop("others"), entries.runs, entries.times, entries.height)
    same(met, A.children_at(named, places))
    # The sort of all edges moves ids alone.
    ordered = A.child_order(G.row_links(numbered))
    assert "others" in ordered.columns and "ups" not in ordered.columns


def test_seed_rows_read_the_tables_of_seeds_alone(numbered):
    tasks = PL.resolve_rows(numbered.catalog, numbered.ranges, [(CHURN, "val")])
    mine = PL.seed_rows(G.row_payload(numbered), tasks)
    assert {r.table_name for r in mine.select("table_name").distinct().collect()} == {CHURN.table}
    read = mine._jdf.queryExecution().optimizedPlan().toString()
    assert "o_custkey" not in read and "l_orderkey" not in read and "c_custkey" in read


def test_numbering_with_the_values_of_tasks(spark, numbered):
    part = G.number_rows(local_catalog(spark, SF_DIR), values=False, task_values=True)
    tasks = PL.resolve_rows(part.catalog, part.ranges, [(CHURN, "val")])
    same(T.row_seeds(numbered, tasks), T.row_seeds(part, tasks))
    same(G.row_payload(numbered), G.row_payload(part))
    assert "l_quantity" not in part.rows[("lineitem", "db")].columns
