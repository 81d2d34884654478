"""The stages in sequence: graph, sampling index, contexts, batches."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowloom.operators import assemble as B
from rowloom.operators.adjacency import Adjacency, build_adjacency
from rowloom.operators.closure import parent_closure
from rowloom.operators.graph import Graph, Numbered
from rowloom.operators.lineage import row_closure
from rowloom.operators.payload import context_cells, node_payload
from rowloom.operators.pool import GraphPool, pool_adjacency, pool_closures, pool_payloads, pool_tasks
from rowloom.operators.sampling import SampleConfig, sample_contexts
from rowloom.session import stage, together
from rowloom.sources.catalog import Catalog
from rowloom.sources.tasks import ResolvedTask, Task, hidden_children, hidden_columns, resolve_tasks, seeds


@dataclass(frozen=True)
class SamplingIndex:
    """What every sampling run over one graph shares."""

    adjacency: Adjacency
    closure: DataFrame
    payload: DataFrame


def pool_indexes(parts: list[SamplingIndex]) -> SamplingIndex:
    """The index of a pool from those of its databases, in the order of the pool."""
    return SamplingIndex(
        adjacency=pool_adjacency([p.adjacency for p in parts]),
        closure=pool_closures([p.closure for p in parts]),
        payload=pool_payloads([p.payload for p in parts]),
    )


def index_links(payload: DataFrame, links: DataFrame, numbered: Numbered) -> SamplingIndex:
    """The index from payload and links that come straight from the rows."""

    def ancestors() -> DataFrame:
        found = row_closure(numbered)
        return stage(parent_closure(payload, links, numbered.catalog.max_hops()) if found is None else found, "closure")

    # The payload is read off the rows whenever it is needed: mostly of a few tables or columns.
    made = together({"adjacency": lambda: build_adjacency(links, None), "ancestors": ancestors})
    return SamplingIndex(adjacency=made["adjacency"], closure=made["ancestors"], payload=payload)


def index_graph(graph: Graph | GraphPool) -> SamplingIndex:
    """What sampling looks up; for a pool, of each of its databases."""
    if isinstance(graph, GraphPool):
        return pool_indexes([index_graph(g) for g in graph.members.values()])

    if graph.links is not None and graph.payload is not None:
        return index_links(graph.payload, graph.links, graph.numbered)

    def lookups() -> tuple[DataFrame, Adjacency]:
        payload = stage(node_payload(graph.nodes, graph.edges), "payload")
        return payload, build_adjacency(graph.edges, payload)

    def ancestors() -> DataFrame:
        return stage(parent_closure(graph.nodes, graph.edges, graph.catalog.max_hops()), "closure")

    made = together({"lookups": lookups, "ancestors": ancestors})
    payload, adjacency = made["lookups"]
    return SamplingIndex(adjacency=adjacency, closure=made["ancestors"], payload=payload)


def stage_graph(graph: Graph) -> Graph:
    """Write the tables every later stage reads."""
    written = together(
        {name: (lambda name=name: stage(getattr(graph, name), name)) for name in ("nodes", "edges", "cells")}
    )
    return replace(graph, **written)


def is_parent(catalog: Catalog, table: str) -> bool:
    return any(parent == table for t in catalog.tables for _, parent in t.fkeys)


def run_config(tasks: list[ResolvedTask], width: int, seq_len: int, **options) -> SampleConfig:
    return SampleConfig(width=width, seq_len=seq_len, hidden=hidden_columns(tasks), hidden_children=hidden_children(tasks), **options)


def seed_rows(payload: DataFrame, tasks: list[ResolvedTask]) -> DataFrame:
    """The payload of the tables that seeds come from."""
    return payload.filter(F.col("table_name").isin([t.task.table for t in tasks]))


def contexts(
    graph: Graph | GraphPool,
    index: SamplingIndex,
    tasks: list[ResolvedTask],
    pool: DataFrame,
    config: SampleConfig,
) -> DataFrame:
    """Context rows of every seed of the pool."""
    have_children = any(t.seed_class == 0 and is_parent(graph.member(t.task.db)[1].catalog, t.task.table) for t in tasks)
    return sample_contexts(pool, seed_rows(index.payload, tasks), index.adjacency, index.closure, config, have_children)


def sampled(catalog: Catalog, index: SamplingIndex, tasks: list[ResolvedTask], pool: DataFrame, config: SampleConfig) -> DataFrame:
    """Context rows of every seed of the pool, of one database whose graph need not be at hand."""
    have_children = any(t.seed_class == 0 and is_parent(catalog, t.task.table) for t in tasks)
    return sample_contexts(pool, seed_rows(index.payload, tasks), index.adjacency, index.closure, config, have_children)


def resolve_rows(catalog: Catalog, ranges: dict[tuple[str, str], tuple[int, int]], wanted: list[tuple[Task, str]]) -> list[ResolvedTask]:
    """``resolve_splits`` from a catalog and its node ranges alone."""
    return [pool_tasks(resolve_tasks(catalog, ranges, [task], split)[0], i, 0) for i, (task, split) in enumerate(wanted)]


def resolve_splits(graph: Graph | GraphPool, wanted: list[tuple[Task, str]]) -> list[ResolvedTask]:
    """Tasks with a split each, numbered in the order given; in a pool each in the database that it names."""
    out = []
    for i, (task, split) in enumerate(wanted):
        db_no, own = graph.member(task.db)
        (one,) = resolve_tasks(own.catalog, own.ranges, [task], split)
        out.append(pool_tasks(one, i, db_no))
    return out


def training_batches(
    graph: Graph | GraphPool,
    index: SamplingIndex,
    tasks: list[ResolvedTask],
    width: int,
    seq_len: int,
    batch_size: int,
    world_size: int,
    epoch: int = 0,
    seed: int = 0,
) -> DataFrame:
    """Padded batches of one epoch over the common pool of all tasks, of one database or several."""
    pool = stage(seeds(graph.nodes, graph.cells, tasks), "seeds")
    config = run_config(tasks, width, seq_len, epoch=epoch, seed=seed)
    cells = context_cells(contexts(graph, index, tasks, pool, config), index.payload, graph.cells, tasks, seq_len)
    padded = B.pad_contexts(cells, seq_len, graph.table_names(), graph.max_parents())
    slots = B.stripe(B.epoch_order(pool, epoch, seed), batch_size, world_size)
    return B.assemble_batches(slots, padded)


def write_graph(graph: Graph, path: str) -> None:
    """Persist the graph as parquet, rows by table and split."""
    for name in Graph.TABLES:
        df = getattr(graph, name)
        writer = df.write
        if name == "nodes":
            writer = writer.partitionBy("table_name", "split")
        elif name == "edges":
            writer = writer.partitionBy("child_table", "child_split")
        writer.parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, catalog: Catalog) -> Graph:
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in Graph.TABLES}
    # One row per table of the catalog.
    ranges = {(r.table_name, r.split): (r.node_offset, r.num_nodes) for r in tables["table_info"].collect()}
    return Graph(catalog=catalog, ranges=ranges, **tables)


# Layout of a stored index; other versions are refused.
INDEX_VERSION = 1
INDEX_TABLES = ("entries", "runs", "times", "closure", "payload")


def write_index(index: SamplingIndex, path: str) -> None:
    """Persist a sampling index, so that later runs over the same graph start from it. The manifest is written last: without it there is no index."""
    a = index.adjacency
    tables = {"entries": a.entries, "runs": a.runs, "times": a.times, "closure": index.closure, "payload": index.payload}
    together({name: (lambda name=name, df=df: df.write.parquet(f"{path}/{name}")) for name, df in tables.items()})
    spark = a.runs.sparkSession
    counts = {name: spark.read.parquet(f"{path}/{name}").count() for name in INDEX_TABLES}
    spark.createDataFrame([(INDEX_VERSION, a.height, counts)], "version int, height int, rows map<string,bigint>").write.parquet(f"{path}/manifest")


def read_index(spark: SparkSession, path: str) -> SamplingIndex:
    """A stored index. Another version, or a table with another number of rows than its manifest says, is an error."""
    manifest = spark.read.parquet(f"{path}/manifest").first()
    if manifest.version != INDEX_VERSION:
        raise ValueError(f"the index at {path} has version {manifest.version}, this library reads {INDEX_VERSION}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in INDEX_TABLES}
    for name, df in tables.items():
        if df.count() != manifest.rows[name]:
            raise ValueError(f"the index at {path} is damaged: {name} should have {manifest.rows[name]} rows")
    adjacency = Adjacency(tables["entries"], tables["runs"], tables["times"], manifest.height)
    return SamplingIndex(adjacency=adjacency, closure=tables["closure"], payload=tables["payload"])
