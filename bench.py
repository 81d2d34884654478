"""Headline jobs, timed: graph build, sampling index, context sampling, batch assembly.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

WIDTH, SEQ_LEN, BATCH, RANKS = 16, 256, 32, 4


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("rowloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from rowloom.operators import assemble as B
    from rowloom.operators.graph import build_graph
    from rowloom.operators.payload import context_cells
    from rowloom.plans import pipeline as PL
    from rowloom.plans.local import CHURN, local_catalog
    from rowloom.session import configure, drop_stages, stage
    from rowloom.sources.tasks import seeds

    configure(spark)
    spent: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        out = run()
        spent[name] = round(time.perf_counter() - start, 3)
        return out

    catalog = local_catalog(spark, SF_DIR, file_order=True)
    graph = timed("graph_build", lambda: PL.stage_graph(build_graph(spark, catalog, spread=int(CPUS))))
    index = timed("sampling_index", lambda: PL.index_graph(graph))
    tasks = PL.resolve_splits(graph, [(CHURN, "test")])
    pool = stage(seeds(graph.nodes, graph.cells, tasks), "seeds")
    config = PL.run_config(tasks, WIDTH, SEQ_LEN)

    def sample():
        rows = PL.contexts(graph, index, tasks, pool, config)
        return stage(context_cells(rows, index.payload, graph.cells, tasks, SEQ_LEN), "contexts")

    cells = timed("context_sampling", sample)

    def assemble():
        padded = B.pad_contexts(cells, SEQ_LEN, [t.name for t in catalog.tables], catalog.max_parents())
        slots = B.stripe(B.epoch_order(pool, 0), BATCH, RANKS)
        B.write_batches(B.assemble_batches(slots, padded), tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/batches")

    timed("batch_assembly", assemble)
    n_cells, n_seeds, n_shown = graph.cells.count(), pool.count(), cells.count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "graph_cells_per_sec": round(n_cells / spent["graph_build"]),
                "contexts": n_seeds,
                "context_cells": n_shown,
                "contexts_per_sec": round(n_seeds / spent["context_sampling"], 1),
            }
        ),
        flush=True,
    )
    drop_stages(spark)
    spark.stop()


if __name__ == "__main__":
    main()
