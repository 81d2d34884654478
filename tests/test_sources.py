import json
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rowloom.operators import graph as G, index as I
from rowloom.operators.clean import clean_table
from rowloom.plans import pipeline as PL
from rowloom.session import stage_root
from rowloom.sources import tasks as T
from rowloom.sources.catalog import load_catalog, table_roles


def put(path, columns, pkey=None, fkeys=None, time_col=None, parts=None):
    table = pa.table(columns)
    meta = {"pkey_col": pkey, "fkey_col_to_pkey_table": fkeys or {}, "time_col": time_col}
    table = table.replace_schema_metadata({k: json.dumps(v) for k, v in meta.items()})
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(table, path, row_group_size=parts or 1000)


@pytest.fixture(scope="module")
def root():
    from pathlib import Path

    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "rel-event"
    put(root / "db/users.parquet", {"user_id": [0, 1, 2], "birthyear": [1990, None, 1985]}, pkey="user_id")
    put(
        root / "db/user_friends.parquet",
        {"user": pa.array([0, None, 1, 2, 2], pa.int64()), "friend": pa.array([1, 2, 0, None, 1], pa.int64())},
        fkeys={"user": "users", "friend": "users"},
    )
    for split in ("train", "val", "test"):
        put(
            root / f"tasks/user-repeat/{split}.parquet",
            {"index": [0, 1], "user": [0, 1], "target": [0, 1]},
            fkeys={"user": "users"},
        )
        put(root / f"tasks/user-event-link/{split}.parquet", {"user": [0], "target": [1]}, fkeys={"user": "users"})
    return str(root)


def test_load_catalog(spark, root):
    catalog = load_catalog(spark, root, "rel-event", clean_table)
    assert [(t.name, t.split) for t in catalog.tables] == [
        ("user_friends", "db"), ("users", "db"), ("user-repeat", "test"), ("user-repeat", "train"), ("user-repeat", "val")
    ]
    roles = {(r.table_name, r.split, r.role, r.col_name): r.parent_table for r in table_roles(spark, catalog).collect()}
    assert roles[("user_friends", "db", "fkey", "friend")] == "users" and ("users", "db", "pkey", "user_id") in roles
    repeat = catalog.table("user-repeat", "train")
    assert repeat.df.dtypes == [("user", "bigint"), ("target", "boolean")]
    with pytest.raises(ValueError, match="nothing of users"):
        catalog.column_id("nothing", "users")

    graph = G.build_graph(spark, catalog)
    assert graph.ranges[("user_friends", "db")] == (0, 3) and graph.ranges[("users", "db")] == (3, 3)
    # Rows with nulls are gone, the others keep their order; each still has a cell, its position.
    cells = [(r.node_id, round(r.number_value, 3)) for r in graph.cells.filter("node_id < 3").orderBy("node_id").collect()]
    assert cells == [(0, -1.0), (1, 0.0), (2, 1.0)]
    edges = sorted((r.child_id, r.fk_col, r.parent_id) for r in graph.edges.filter("child_table = 'user_friends'").collect())
    assert edges == [(0, "friend", 4), (0, "user", 3), (1, "friend", 3), (1, "user", 4), (2, "friend", 4), (2, "user", 5)]
    tasks = PL.resolve_splits(graph, [(t, "val") for t in T.KNOWN_TASKS if t.table == "user-repeat"])
    assert T.seeds(graph.nodes, graph.cells, tasks).count() == 2


def test_overrides_and_missing_roles(spark):
    from pathlib import Path

    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    put(root / "db/UserInfo.parquet", {"id": [0]}, pkey="id")
    put(root / "db/Visits.parquet", {"UserID": [0]}, fkeys={"UserID": "Users"})
    catalog = load_catalog(spark, str(root), "rel-avito")
    assert catalog.table("Visits").fkeys == (("UserID", "UserInfo"),)
    pq.write_table(pa.table({"x": [1]}), root / "db/plain.parquet")
    with pytest.raises(ValueError, match="footer"):
        load_catalog(spark, str(root), "rel-avito")


def test_folder_tables_and_unknown_paths(spark):
    from pathlib import Path

    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    put(root / "db/users.parquet", {"id": [0, 1]}, pkey="id")
    for k in range(3):  # a table as Spark writes it
        put(root / f"db/orders.parquet/part-{k}.parquet", {"b": [k], "a": [1], "v": [1.0]}, fkeys={"a": "users", "b": "users"})
    put(root / "tasks/t/train.parquet", {"u": [0], "y": [True]}, fkeys={"u": "users"})
    catalog = load_catalog(spark, str(root), "x")
    assert [(t.name, t.split) for t in catalog.tables] == [("orders", "db"), ("users", "db"), ("t", "train")]
    assert catalog.table("orders").df.count() == 3
    # Keys in the order of the columns, not of the footer.
    assert catalog.table("orders").fkey_cols == ["b", "a"]
    put(root / "tasks/a-b-c/train.parquet", {"u": [0]}, fkeys={})
    with pytest.warns(UserWarning, match="a-b-c"):
        load_catalog(spark, str(root), "x")
    (root / "tasks/a-b-c/train.parquet").unlink()
    for odd in ("tasks/t/holdout.parquet", "tasks/t/db.parquet", "db/deep/x.parquet", "plain.parquet"):
        put(root / odd, {"u": [0]})
        with pytest.raises(ValueError, match="neither"):
            load_catalog(spark, str(root), "x")
        (root / odd).unlink()


def test_file_order_spans_files(spark):
    path = stage_root(spark) + "/ordered"
    spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)
    from rowloom.sources.catalog import Table

    got = I.with_row_index(Table("t", spark.read.parquet(path), order="file"))
    assert got.filter("id <> row_idx").count() == 0 and got.count() == 1000


def test_keys_that_do_not_number_the_rows(spark):
    from rowloom.sources.catalog import Catalog, Table

    for keys in ([1, 2], [0, 5, 7], [0, 0, 2], [0, 2, 2, 2, 4], [0, None], [1, 1, 2, 2, 3, 6, 6], [-1, 0, 1], [0] * 40_000 + [1]):
        df = spark.createDataFrame([(k, 1) for k in keys], "id long, v int")
        with pytest.raises(ValueError, match="each once"):
            G.number_rows(Catalog.of([Table("t", df, pkey="id", order="pkey")]))
    for n in (0, 1, 5, 70_000):
        G.number_rows(Catalog.of([Table("t", spark.range(n).withColumn("v", F.lit(1)), pkey="id", order="pkey")]))


def test_fractions_number_nothing(spark):
    from rowloom.sources.catalog import Catalog, Table

    df = spark.createDataFrame([(0.0, 1), (1.5, 1)], "id double, v int")
    with pytest.raises(ValueError, match="each once"):
        G.number_rows(Catalog.of([Table("t", df, pkey="id", order="pkey")]))


def test_single_staged_tables_are_dropped(spark):
    from pathlib import Path

    from rowloom.session import CLEANUP, drop_staged, stage, stage_root

    before = spark.conf.get(CLEANUP)
    one = stage(spark.range(10).groupBy("id").count(), "one")
    two = stage(spark.range(3), "two")
    assert spark.conf.get(CLEANUP) == before
    assert drop_staged(one.filter("id > 3")) == 1 and drop_staged(one) == 0
    left = [p.name.split("-")[0] for p in Path(stage_root(spark)).iterdir()]
    assert "one" not in left and two.count() == 3


@pytest.mark.parametrize("order", ["pkey", ("id",)])
def test_keys_of_other_number_types(spark, order):
    from rowloom.sources.catalog import Catalog, Table

    up = Table("up", spark.range(3).withColumn("v", F.lit(1)), pkey="id", order=order)
    rows = [(1.0, 0), (None, 1), (2.0, 2), (1.5, 3), (9.0, 4), (float("nan"), 5), (float("inf"), 6)]
    for kind in ("double", "float"):
        down = Table("down", spark.createDataFrame(rows, f"k {kind}, v int"), fkeys=(("k", "up"),), order=("v",))
        numbered = G.number_rows(Catalog.of([up, down]))
        edges = G.edges(numbered)
        assert sorted((r.child_id, r.parent_id) for r in edges.collect()) == [(0, 8), (2, 9)]
        report = G.key_report(numbered, edges).first()
        assert (report.n_rows, report.n_set, report.n_matched) == (7, 6, 2)
    text = Table("down", spark.createDataFrame([("1", 0)], "k string, v int"), fkeys=(("k", "up"),), order=("v",))
    with pytest.raises(ValueError, match="cannot be compared"):
        G.edges(G.number_rows(Catalog.of([up, text])))


def test_six_keys_keep_six_parents(spark):
    from rowloom.operators.assemble import pad_contexts
    from rowloom.operators.payload import context_cells, node_payload
    from rowloom.sources.catalog import Catalog, Table

    up = Table("up", spark.range(8).withColumn("v", F.lit(1)), pkey="id", order="pkey")
    cols = [f"k{i}" for i in range(6)]
    down = Table("down", spark.createDataFrame([(*range(1, 7), 5)], ", ".join(f"{c} long" for c in cols) + ", v int"),
                 fkeys=tuple((c, "up") for c in cols), order=("v",))
    catalog = Catalog.of([up, down])
    graph = G.build_graph(spark, catalog)
    payload = node_payload(graph.nodes, graph.edges)
    (row,) = payload.filter("table_name = 'down'").collect()
    assert row.f2p_nbr_ids == [2, 3, 4, 5, 6, 7] and catalog.max_parents() == 6
    nodes = spark.createDataFrame([(0, 0, 0, 0, 0, 0.0, 0, "", 0, 1, 0)], "item_id long, task_no int, seed_id long, seed_ts long, "
                                  "level int, key double, tie long, path string, node_id long, n_cells int, before long").withColumn("depth", F.lit(0))
    cells = context_cells(nodes, payload, graph.cells, [], 4)
    padded = pad_contexts(cells, 4, ["up", "down"], catalog.max_parents()).first()
    assert padded.f2p_nbr_ids[0] == [2, 3, 4, 5, 6, 7] and padded.f2p_nbr_ids[1] == [-1] * 6


def test_sparse_and_text_keys(spark):
    from rowloom.sources.catalog import Catalog, Table

    up = Table("up", spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, v int"), pkey="k", order=("k",))
    down = Table("down", spark.createDataFrame([("z", 1), (None, 2), ("x", 3), ("q", 4)], "k string, v int"), fkeys=(("k", "up"),), order=("v",))
    graph = G.build_graph(spark, Catalog.of([up, down]))
    assert sorted((r.child_id, r.parent_id) for r in graph.edges.collect()) == [(0, 6), (2, 4)]


def test_unsupported_types_and_infinite_values(spark):
    from rowloom.sources.catalog import Catalog, Table

    bad = Table("b", spark.createDataFrame([(0, [1])], "id long, v array<int>"), pkey="id", order="pkey")
    with pytest.raises(ValueError, match="cannot become cells"):
        G.build_graph(spark, Catalog.of([bad]))
    inf = Table("i", spark.createDataFrame([(0, 1.0), (1, float("inf"))], "id long, v double"), pkey="id", order="pkey")
    with pytest.raises(Exception, match="infinite value"):
        # The mean itself is infinite, so scaling gives NaN or infinity; a finite mean with an infinite value must fail.
        numbered = G.number_rows(Catalog.of([inf]))
        stats = spark.createDataFrame([(0, 0.0, 1.0)], "stat_key int, mean double, std double")
        texts = G.D.build_dictionary(spark.createDataFrame([("a",)], "text string"))
        G.cells(numbered, stats, texts).collect()


def test_write_and_read_graph(spark, root):
    catalog = load_catalog(spark, root, "rel-event", clean_table)
    graph = PL.stage_graph(G.build_graph(spark, catalog))
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/graph"
    PL.write_graph(graph, path)
    again = PL.read_graph(spark, path, catalog)
    for name in G.Graph.TABLES:
        a, b = getattr(graph, name), getattr(again, name)
        assert a.count() == b.count() and sorted(a.columns) == sorted(b.columns)
    assert again.ranges == graph.ranges
    # The dictionary read by text is its own reverse map.
    assert again.text_dict.filter("text = 'users'").count() == 1


def test_task_catalogue(spark):
    tasks = T.task_frame(spark, T.KNOWN_TASKS)
    assert tasks.count() == 36
    assert {(r.kind, r.type): r["count"] for r in tasks.groupBy("kind", "type").count().collect()} == {
        ("forecast", "clf"): 12, ("forecast", "reg"): 9, ("autocomplete", "clf"): 7, ("autocomplete", "reg"): 8
    }
    assert T.leave_one_db_out(tasks, "rel-f1").filter("db = 'rel-f1'").count() == 0
    held = T.leave_one_task_out(tasks, "rel-amazon", "user-churn")
    assert {r.db for r in held.collect()} == {"rel-amazon"} and held.filter("table_name = 'user-churn'").count() == 0
    by_name = tasks.withColumn("rule", T.type_by_name(F.col("table_name"))).filter("kind = 'forecast' AND rule <> type")
    assert by_name.count() == 0
