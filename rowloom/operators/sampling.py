"""Bounded, time-consistent neighbourhoods of every seed, level by level.

All seeds advance together. Level d holds the entries that come d steps after
the seed; a level is visited in the order of random keys, each entry followed
by its ancestors. A level never adds entries to an earlier one, so visiting
levels whole gives the order of a walk that always draws a random entry of the
shallowest level.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowloom.functions import scalars as S
from rowloom.operators.adjacency import NO_TIME, Adjacency, children_at, visible_counts
from rowloom.operators.draws import drawn
from rowloom.operators.util import db_of, local_id, union_all
from rowloom.session import stage

# A seed of a run: its task number above its node id.
ITEM = ["item_id"]
TASK_SHIFT = 48
RANK = ["level", "key", "tie", "path"]
# So few visited rows are written before they draw, and so are their draws: their true size lets the index be read without a shuffle.
FEW = 1 << 16


@dataclass(frozen=True)
class SampleConfig:
    """``width``: database children kept per visited row. ``seq_len``: cells per context.

    ``strict_time`` hides rows of the seed's own task that have the seed's
    time. ``hidden`` lists (first node, last node, columns) for tables whose
    rows may lose that many leakage columns, ``hidden_children`` (database number, visibility class, columns)
    for the task tables among them.
    """

    width: int
    seq_len: int
    epoch: int = 0
    seed: int = 0
    strict_time: bool = False
    hidden: tuple[tuple[int, int, int], ...] = field(default=())
    hidden_children: tuple[tuple[int, int, int], ...] = field(default=())

    def sure_cells(self, node: Column, n_cells: Column) -> Column:
        """Cells a row shows whatever the seed: a lower bound used only to stop early."""
        lost = F.lit(0)
        for first, last, columns in self.hidden:
            lost = F.when(node.between(first, last), F.lit(columns)).otherwise(lost)
        return F.greatest(F.lit(0), n_cells - lost)

    def random(self, *parts: Column) -> Column:
        return S.keyed_hash(F.lit(self.seed), F.lit(self.epoch), *parts)


def item_id(task_no: Column, seed_id: Column) -> Column:
    return F.shiftleft(task_no.cast("bigint"), TASK_SHIFT) + seed_id


def task_no() -> Column:
    return F.shiftright("item_id", TASK_SHIFT).cast("int")


def seed_id() -> Column:
    return F.col("item_id").bitwiseAND(F.lit((1 << TASK_SHIFT) - 1))


def ask(visited: DataFrame, strict_time: bool) -> DataFrame:
    """One question per visited row and visibility class: which children may the seed see?

    Database children are always asked for; task rows only those of the seed's
    own task table.
    """
    classes = F.array_distinct(F.array(F.lit(0), F.col("seed_class")))
    asked = visited.select(
        *ITEM, "seed_class", "item_ts", F.col("node_id").alias("parent_id"), F.explode(classes).alias("child_class")
    )
    seed_ts = F.col("item_ts")
    if strict_time:
        seed_ts = F.when((F.col("child_class") > 0) & (seed_ts < NO_TIME), seed_ts - 1).otherwise(seed_ts)
    return asked.withColumn("seed_ts", seed_ts)


def child_draws(counted: DataFrame, config: SampleConfig) -> DataFrame:
    """One row per child to visit: its place, as ``adj_pos``, and its random key.

    Database children: at most ``width`` per parent, uniformly without
    replacement. Task children are all wanted, but a context shows ``seq_len``
    cells at most, so of a very long run only the head of its random order can
    matter: ``seq_len`` rows that show a cell, beside those that show none, per
    foreign key. Their keys are then the smallest of as many keys as the run has rows,
    so they mix with other entries as the whole run would.
    """
    n = F.col("n")
    per_key = (F.col("max_fk_pos") + 1).cast("bigint")
    head = (F.lit(config.seq_len) + F.col("n_bare")) * per_key
    # Children of one class are rows of one task table: only its own leakage columns count.
    for db_no, seed_class, columns in config.hidden_children:
        own = F.when(F.col("min_cells") > columns, F.lit(config.seq_len) * per_key).otherwise(n)
        head = F.when((F.col("child_class") == seed_class) & (db_of(F.col("parent_id")) == db_no), own).otherwise(head)
    is_db = F.col("child_class") == 0
    k = F.least(n, F.when(is_db, F.lit(config.width).cast("bigint")).otherwise(head))
    question = config.random(F.lit("d"), local_id(seed_id()), local_id(F.col("parent_id")), F.col("child_class"))
    asked = counted.withColumns({"k": k, "question": question}).withColumn("of", F.when(is_db, F.col("k")).otherwise(n))
    return drawn(asked.filter("k > 0")).withColumn("adj_pos", F.col("start") + F.col("offset"))


def expand(visited: DataFrame, adjacency: Adjacency, config: SampleConfig, few: bool = False) -> DataFrame:
    """The sampled children of visited rows, one row per edge; ``few`` says that there are at most FEW visited rows."""
    asked = ask(visited, config.strict_time)
    counted = visible_counts(adjacency, stage(asked, "asked") if few else asked)
    picked = child_draws(counted, config).select(*ITEM, "seed_class", "item_ts", "parent_id", "child_class", "adj_pos", "key")
    if few:
        picked = stage(picked, "picked")
    return children_at(adjacency, picked)


def within_budget(rows: DataFrame, config: SampleConfig) -> DataFrame:
    """Keep the first visit of every row and the rows that begin inside the cell budget.

    A seed's rows number at most its budget plus rows without cells.
    """
    item = W.partitionBy(*ITEM)
    first = W.partitionBy(*ITEM, "node_id").orderBy(*RANK)
    earlier = item.orderBy(*RANK).rowsBetween(W.unboundedPreceding, -1)
    sure = config.sure_cells(F.col("node_id"), F.col("n_cells"))
    return (
        rows.repartition(*ITEM)
        .withColumn("rn", F.row_number().over(first))
        .filter("rn = 1")
        .withColumn("before", F.coalesce(F.sum(sure).over(earlier), F.lit(0)).cast("bigint"))
        .filter(F.col("before") < config.seq_len)
        .drop("rn")
    )


def with_ancestors(entries: DataFrame, closure: DataFrame) -> DataFrame:
    """Every entry followed by its ancestors, each one step deeper per hop.

    ``ups`` holds the parents to follow. An entry that came over an edge leaves
    that edge out: its parent and the parent's ancestors have been visited.
    """
    own = F.array(F.struct(F.lit(None).cast("int").alias("fk_pos"), F.lit("").alias("step"), F.lit(None).cast("bigint").alias("parent_id")))
    up = closure.select(
        F.col("node_id").alias("via"), "ancestor_id", "hops", F.col("path").alias("up_path"), F.col("n_cells").alias("up_cells")
    )
    # The entry's own row meets nothing in the closure: no id is negative.
    via = F.coalesce(F.col("u.parent_id"), -F.col("node_id") - 1)
    return (
        entries.withColumn("u", F.explode(F.concat(own, "ups")))
        .withColumn("via", via)
        .join(up, "via", "left")
        .select(
            *ITEM,
            "seed_class",
            "item_ts",
            F.coalesce("ancestor_id", "node_id").alias("node_id"),
            "level",
            "key",
            "tie",
            F.concat("u.step", F.coalesce("up_path", F.lit(""))).alias("path"),
            (F.col("level") + F.coalesce(F.col("hops") + 1, F.lit(0))).alias("depth"),
            F.coalesce("up_cells", "n_cells").alias("n_cells"),
        )
    )


def first_level(seeds: DataFrame, payload: DataFrame) -> DataFrame:
    return (
        seeds.select("task_no", F.col("seed_id").alias("node_id"), "seed_ts", "seed_class")
        .join(payload.select("node_id", "n_cells", "ups"), "node_id")
        .select(
            item_id(F.col("task_no"), F.col("node_id")).alias("item_id"),
            "seed_class",
            F.coalesce("seed_ts", F.lit(NO_TIME)).alias("item_ts"),
            "node_id",
            F.lit(0).alias("level"),
            F.lit(0.0).alias("key"),
            F.lit(0).cast("bigint").alias("tie"),
            "n_cells",
            "ups",
        )
    )


def next_level(
    active: DataFrame, depth: int, adjacency: Adjacency, closure: DataFrame, config: SampleConfig, few: bool = False
) -> DataFrame:
    """All rows of the unfinished seeds after one more level."""
    children = expand(active.filter(F.col("depth") == depth), adjacency, config, few)
    seen = active.drop("before", "done")
    entries = children.select(
        *ITEM,
        "seed_class",
        "item_ts",
        F.col("child_id").alias("node_id"),
        F.lit(depth + 1).alias("level"),
        "key",
        F.col("adj_pos").alias("tie"),
        F.lit("").alias("path"),
        F.lit(depth + 1).alias("depth"),
        F.col("child_cells").alias("n_cells"),
        "ups",
    )
    # Entries beyond the budget by their own cells alone need no ancestors.
    no_ups = F.lit(None).cast(entries.schema["ups"].dataType)
    fresh = within_budget(seen.withColumn("ups", no_ups).unionByName(entries), config)
    fresh = fresh.filter(F.col("level") == depth + 1).drop("before", "path", "depth")
    return seen.unionByName(with_ancestors(fresh, closure))


def sample_contexts(
    seeds: DataFrame,
    payload: DataFrame,
    adjacency: Adjacency,
    closure: DataFrame,
    config: SampleConfig,
    seeds_have_children: bool = True,
) -> DataFrame:
    """The rows of every seed's context in visiting order.

    ``seeds`` has task_no, seed_id, seed_ts and seed_class; ``closure`` lists
    the ancestors of every parent row with their cell counts. Each level is written
    once; seeds whose budget is full leave the loop. The result has one row
    per context row with ``before``, the cells shown before it (exact when no
    columns are hidden). Rows of task tables are nobody's parents, so seeds
    from there (``seeds_have_children`` false) skip the first expansion.
    """
    item = W.partitionBy(*ITEM)
    sure = config.sure_cells(F.col("node_id"), F.col("n_cells"))
    full = F.max(F.col("before") + sure).over(item) >= config.seq_len
    finished = []
    rows = with_ancestors(first_level(seeds, payload), closure)
    depth = 0 if seeds_have_children else 1
    while True:
        level = stage(within_budget(rows, config).withColumn("done", full), "level", partition_by=["done"])
        finished.append(level.filter("done"))
        active = level.filter("NOT done")
        deepest, n_visited = active.agg(F.max("depth"), F.count(F.when(F.col("depth") == depth, 1))).first()
        if deepest is None or deepest < depth:
            finished.append(active)
            break
        rows = next_level(active, depth, adjacency, closure, config, n_visited <= FEW)
        depth += 1
    return union_all(finished).select(
        *ITEM,
        task_no().alias("task_no"),
        seed_id().alias("seed_id"),
        F.nullif(F.col("item_ts"), F.lit(NO_TIME)).alias("seed_ts"),
        "node_id",
        *RANK,
        "depth",
        "n_cells",
        "before",
    )


def with_node_pos(context_nodes: DataFrame) -> DataFrame:
    w = W.partitionBy(*ITEM).orderBy(*RANK)
    return context_nodes.withColumn("node_pos", F.row_number().over(w) - 1)
