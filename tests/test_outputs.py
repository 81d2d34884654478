"""Batches, relations, metrics, functions and UDF surfaces on small inputs."""

import math
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom.functions import scalars as S, udfs as U
from rowloom.operators import assemble as B, metrics as M, relations as R

PRED = "task_id string, split string, step int, batch_idx int, seed_id long, sem_type int, y double, yhat double, mask boolean"


def preds(spark, rows):
    return spark.createDataFrame([("t", "val", 0, i // 2, i, 3, float(y), float(p), True) for i, (y, p) in enumerate(rows)], PRED)


def test_auc(spark):
    assert M.roc_auc(preds(spark, [(-1, 0.1), (-1, 0.2), (1, 0.3), (1, 0.9)])).first().auc == 1.0
    assert M.roc_auc(preds(spark, [(-1, 0.5), (1, 0.5)])).first().auc == 0.5
    assert M.roc_auc(preds(spark, [(1, 0.5), (1, 0.7)])).first().auc is None
    rng = np.random.default_rng(0)
    rows = [(1 if rng.random() < 0.3 else -1, round(rng.normal(), 1)) for _ in range(3000)]
    pos = [p for y, p in rows if y > 0]
    neg = [p for y, p in rows if y <= 0]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    for buckets in (2, 16, 256):
        assert M.roc_auc(preds(spark, rows), n_buckets=buckets).first().auc == pytest.approx(want)


def test_r2(spark):
    assert M.r2(preds(spark, [(1, 1), (2, 2), (3, 4)])).first().r2 == pytest.approx(0.5)
    assert M.r2(preds(spark, [(2, 2), (2, 2)])).first().r2 == 1.0
    assert M.r2(preds(spark, [(2, 1), (2, 3)])).first().r2 is None


def test_losses(spark):
    df = spark.createDataFrame(
        [("t", "val", 0, 0, 0, 0, 0.0, 0.5, True), ("t", "val", 0, 0, 1, 2, 0.0, 3.0, True), ("t", "val", 0, 0, 2, 3, 1.0, 2.0, True),
         ("t", "val", 0, 0, 3, 3, 1.0, 99.0, False), ("t", "val", 0, 1, 4, 0, 0.0, 1.0, True)], PRED)
    got = {r.batch_idx: r.loss for r in M.batch_loss(df).collect()}
    assert got[0] == pytest.approx((0.125 + 2.5 + math.log1p(math.exp(-2))) / 3) and got[1] == 0.5
    assert M.mean_loss(df).first().loss == pytest.approx((got[0] + got[1]) / 2)
    with pytest.raises(Exception, match="text targets"):
        M.batch_loss(df.withColumn("sem_type", F.lit(1))).collect()


def test_best_on_val(spark):
    rows = [("t", "val", 0, 0.5), ("t", "test", 0, 0.4), ("t", "val", 1, 0.8), ("t", "test", 1, 0.6), ("t", "val", 2, 0.8), ("t", "test", 2, 0.9)]
    best = M.best_on_val(spark.createDataFrame(rows, "task_id string, split string, step int, value double")).first()
    assert (best.step, best.val, best.test) == (1, 0.8, 0.6)


def test_bf16(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000), rng.normal(size=500) * 1e30, rng.normal(size=500) * 1e-38, [0.0, 1.0, 2.0**-126, 3.4e38, -1.00390625, 1.01171875]]).astype(np.float32)
    bits = x.view(np.uint32).astype(np.uint64)
    want = (((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16) << 16).astype(np.uint32).view(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(x)), "x": x}))
    got = df.select("i", S.bf16(F.col("x")).alias("y")).orderBy("i").toPandas()["y"].to_numpy(np.float32)
    assert np.array_equal(got, want)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x float").select(S.bf16(F.col("x")).alias("y")).collect()
    assert math.isnan(odd[0].y) and odd[1].y == math.inf and odd[2].y is None


def test_epoch_seconds_truncate_toward_zero(spark):
    df = spark.sql("SELECT timestamp_micros(-1500000) AS a, timestamp_micros(1999999) AS b")
    assert df.select(S.epoch_seconds(F.col("a")).alias("a"), S.epoch_seconds(F.col("b")).alias("b")).first() == (-1, 1)


def items(spark, n):
    return spark.createDataFrame([(0, "t", i) for i in range(n)], "task_no int, task_id string, seed_id long")


@pytest.mark.parametrize("n", [1, 5, 12, 13, 100])
def test_stripe_covers_every_item_once(spark, n):
    rows = B.stripe(B.epoch_order(items(spark, n), 1), 3, 4).collect()
    own = [r for r in rows if not r.is_wrapped]
    assert sorted(r.seed_id for r in own) == list(range(n))
    assert len({(r.batch_idx, r.rank, r.slot) for r in rows}) == len(rows)
    per_batch = {}
    for r in rows:
        per_batch.setdefault((r.batch_idx, r.rank), []).append(r)
    for group in per_batch.values():
        assert len(group) == 3 and sum(not r.is_wrapped for r in group) == group[0].true_batch_size
    assert B.num_batches(items(spark, n), 3, 4).first().n_batches == -(-n // 12)


def test_epochs_differ(spark):
    order = lambda e: [r.seed_id for r in B.epoch_order(items(spark, 50), e).orderBy("position").collect()]
    assert order(0) == order(0) != order(1)


CELLS = (
    "item_id long, task_no int, seed_id long, pos int, node_id long, depth int, table_name string, col_id long, sem_type byte, number_value float, "
    "text_id long, datetime_value float, boolean_value float, class_value_id long, f2p_nbr_ids array<long>, is_target boolean, mask boolean, "
    "is_task_node boolean"
)


@pytest.fixture(scope="module")
def cells(spark):
    """Context of seed 9: the seed row (parent 5), its parent 5 (parents 4 and 5, so its own boss), 4, and 7, another child of 5."""
    shape = [(9, "t", [5], 2), (5, "p", [4, 5], 3), (4, "q", [], 1), (7, "t", [5, 8], 2)]
    rows, pos = [], 0
    for node, table, up, n in shape:
        for c in range(n):
            col = {"t": 0, "p": 10, "q": 20}[table] + c
            rows.append((9, 0, 9, pos, node, 0, table, col, 0, float(pos), 0, 0.0, 0.0, -1, up, pos == 1, pos == 1, table == "t"))
            pos += 1
    return spark.createDataFrame(rows, CELLS)


def test_relations_match_pairs(cells):
    rows = cells.collect()
    feat, nbr, col = set(), set(), set()
    for q in rows:
        for kv in rows:
            if q.node_id == kv.node_id or kv.node_id in q.f2p_nbr_ids:
                feat.add((q.pos, kv.pos))
            if q.node_id in kv.f2p_nbr_ids:
                nbr.add((q.pos, kv.pos))
            if (q.table_name, q.col_id) == (kv.table_name, kv.col_id):
                col.add((q.pos, kv.pos))
    got = R.row_relations(cells).collect()
    assert {(q, k) for r in got for q in r.q_pos for k in r.feat_kv} == feat
    assert {(q, k) for r in got for q in r.q_pos for k in r.nbr_kv} == nbr
    assert {(q, k) for r in R.column_relations(cells).collect() for q in r.col_kv for k in r.col_kv} == col
    d = R.mask_density(cells).first()
    assert (d.feat_pairs, d.nbr_pairs, d.col_pairs, d.full_pairs) == (len(feat), len(nbr), len(col), len(rows) ** 2)
    assert sorted((r.node_id, r.parent_id) for r in R.induced_edges(R.context_rows(cells)).collect()) == [(5, 4), (5, 5), (7, 5), (9, 5)]
    s = R.context_summary(cells).first()
    assert (s.n_nodes, s.n_edges, s.n_targets) == (4, 4, 1)


def test_padding_masking_and_export(spark, cells):
    padded = B.pad_contexts(cells, 10, ["t", "p", "q"], 5, bf16=True)
    row = padded.first()
    assert row.node_ids == [9, 9, 5, 5, 5, 4, 7, 7, -1, -1] and row.is_padding == [False] * 8 + [True] * 2
    assert row.f2p_nbr_ids[2] == [4, 5, -1, -1, -1] and row.f2p_nbr_ids[9] == [-1] * 5
    assert row.class_value_ids == [-1] * 10 and row.masks == [False, True] + [False] * 8 and row.table_ids[:3] == [2, 2, 0]
    pool = spark.createDataFrame([(0, "t", 9)], "task_no int, task_id string, seed_id long")
    batches = B.assemble_batches(B.stripe(B.epoch_order(pool, 0), 2, 1), padded)
    masked = {r.is_wrapped: r for r in B.mask_wrapped(batches).collect()}
    assert masked[True].is_padding == [True] * 10 and not any(masked[True].masks) and masked[False].masks[1]
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/b"
    B.write_batches(batches, path)
    assert spark.read.parquet(path).filter("epoch = 0 AND rank = 0").count() == 2
    scores = U.score_batches(batches).collect()
    assert len(scores) == 1 and scores[0].yhat == pytest.approx(np.mean([0, 2, 3, 4, 5, 6, 7]))


def test_custom_embedder_and_scorer(spark, cells):
    texts = spark.createDataFrame([(0, "a bb"), (1, ""), (2, "ccc")], "text_id long, text string")

    class Lengths:
        def __call__(self, batch):
            return np.array([[len(t), 1.0] for t in batch])

    got = {r.text_id: list(r.vec) for r in U.embed_texts(texts, Lengths, batch_size=2).collect()}
    assert got == {0: [4.0, 1.0], 1: [0.0, 1.0], 2: [3.0, 1.0]}
    plain = {r.text_id: np.array(r.vec) for r in U.embed_texts(texts).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in plain.values())


def test_predictions_from_batches(spark):
    from rowloom.operators import metrics as M
    from rowloom.sources.tasks import ResolvedTask, Task

    tasks = [ResolvedTask(i, Task("d", t, "y"), "val", 0, (), 1, 0, 9, ()) for i, t in enumerate(("user-churn", "user-ltv"))]
    rows = [
        (0, 1, 0, False, [0, 3], [False, True], [7.0, 0.0], [0.0, -1.0]),
        (0, 2, 0, False, [3, 0], [True, False], [0.0, 7.0], [1.0, 0.0]),
        (0, 2, 1, True, [3, 0], [True, False], [0.0, 7.0], [1.0, 0.0]),
    ]
    schema = ("task_no int, seed_id long, batch_idx long, is_wrapped boolean, sem_types array<int>, is_targets array<boolean>, "
              "number_values array<double>, boolean_values array<double>")
    batches = spark.createDataFrame(rows, schema)
    scores = lambda *x: spark.createDataFrame(list(x), "task_no int, seed_id long, yhat double")
    got = M.predictions(batches, scores((0, 1, 0.2), (0, 2, 0.7)), tasks).collect()
    assert {r.seed_id: (r.sem_type, r.y, r.yhat) for r in got} == {1: (3, -1.0, 0.2), 2: (3, 1.0, 0.7)}
    for bad in ([(0, 1, 0.2)], [(0, 1, 0.2), (0, 2, 0.7), (0, 2, 0.7)], [(0, 1, 0.2), (0, 2, 0.7), (0, 5, 0.1)]):
        with pytest.raises(Exception, match="score"):
            M.predictions(batches, scores(*bad), tasks).collect()


def test_staged_tables_are_dropped(spark):
    from rowloom import session

    # Apart from the tables that other tests still read.
    app = spark.sparkContext.applicationId
    kept = session._STAGED.pop(app, [])
    table = session.stage(spark.range(3), "short")
    (path,) = session._STAGED[app]
    assert table.count() == 3 and session.drop_stages(spark) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    session._STAGED[app] = kept


def test_closure_keeps_one_path_per_ancestor(spark):
    """Seven layers of two rows, each pointing to both rows of the layer above: paths double, pairs do not."""
    from rowloom.operators.closure import ancestors

    edges = [(2 * k + i, j, 2 * (k - 1) + j) for k in range(1, 7) for i in range(2) for j in range(2)]
    nodes = spark.range(14).withColumnRenamed("id", "node_id")
    for max_hops in (6, None):
        got = ancestors(nodes, spark.createDataFrame(edges, "child_id long, fk_pos int, parent_id long"), max_hops).collect()
        assert len(got) == len({(r.node_id, r.ancestor_id) for r in got}) == 98
        # The last key goes first.
        assert {r.path for r in got if (r.node_id, r.ancestor_id) == (4, 1)} == {"998998"}


def test_scorer_is_handed_what_it_reads(spark, cells):
    pool = spark.createDataFrame([(0, "t", 9)], "task_no int, task_id string, seed_id long")
    slots = B.stripe(B.epoch_order(pool, 0), 2, 1)
    whole = B.pad_contexts(cells, 10, ["t", "p", "q"], 5)
    some = B.pad_contexts(cells, 10, ["t", "p", "q"], 5, arrays=("masks", "table_ids", "node_ids"))
    assert some.columns == ["task_no", "seed_id", "n_cells", "node_ids", "table_ids", "masks", "is_padding"]
    assert some.collect() == whole.select(*some.columns).collect()

    class Width:
        reads = ("masks",)

        def __call__(self, batch):
            assert list(batch.columns) == ["task_no", "seed_id", *self.reads]
            return pd.DataFrame({"task_no": batch.task_no, "seed_id": batch.seed_id, "yhat": batch.masks.map(len) * 1.0})

    assert [r.yhat for r in U.score_batches(B.assemble_batches(slots, whole), Width).collect()] == [10.0]
    frame = pd.DataFrame({"task_no": [0, 0], "seed_id": [1, 2], "sem_types": [[0, 1, 0], [1]], "masks": [[False, False, True], [False]]})
    told = U.MeanNumber()(frame.assign(is_padding=[[False] * 3, [False]], number_values=[[2.5, 1.0, 9.0], [3.0]]))
    assert told.yhat.tolist() == [2.5, 0.0]


def test_scores_need_no_dictionary(spark):
    from rowloom.operators import graph as G
    from rowloom.plans import queries as Q

    run = Q.LocalRun(spark, "/root/testdata/sf0.001")
    told = sorted(Q.q_score(run).collect())
    assert told and not {"text_dict", "cells", "churn_cells"} & set(run.__dict__)
    # Whole rows hold the cells that the long table has.
    rows = G.row_cells(run.numbered, run.stats).selectExpr("node_id", "inline(cells)")
    assert rows.exceptAll(run.cells.select(*rows.columns)).isEmpty() and rows.count() == run.cells.count()
    assert run.churn_cells.count() == run.churn_numbers().count()
    assert sorted(Q.q_score(run).collect()) == told
