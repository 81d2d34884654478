"""Children of every row in time order, and how many of them a moment may see.

All edges lie in one global order by (parent, visibility class, child time,
child). An edge's place in it, ``adj_pos``, is unique, so a join on it is even
however many children a parent has, and the children a seed may see are always
a run of places beginning at the parent's ``start``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowloom.operators.closure import ups_of
from rowloom.operators.index import dense_index
from rowloom.operators.util import union_all
from rowloom.session import stage, together

KEY = ["parent_id", "child_class"]

# Times of a run lie in blocks of so many places, the first times of so many blocks in a block of the level above.
BLOCK = 256

# Stands for the time of a seed that has none: later than everything.
NO_TIME = (1 << 63) - 1


@dataclass(frozen=True)
class Adjacency:
    """``entries``: one row per edge, by ``adj_pos``, with the child's parents over its
    other keys (``ups``, and ``others`` where they are known as plain ids). ``runs``: one row per (parent, class). ``times``: the times of a run in blocks,
    level by level; ``height``: how many levels the longest run has."""

    entries: DataFrame
    runs: DataFrame
    times: DataFrame
    height: int


def child_order(edges: DataFrame) -> DataFrame:
    # The other parents travel as plain ids where the edges have them so.
    known = [c for c in ("others", "ups") if c in edges.columns][:1]
    slim = edges.select(*KEY, "child_ts", "child_id", "fk_pos", "child_cells", *known)
    return dense_index(slim, [*KEY, "child_ts", "child_id", "fk_pos"], "adj_pos")


def with_other_parents(ordered: DataFrame, payload: DataFrame) -> DataFrame:
    ups = payload.select(F.col("node_id").alias("child_id"), "ups")
    others = F.filter("ups", lambda u: u["fk_pos"] != F.col("fk_pos"))
    return ordered.join(ups, "child_id").select("adj_pos", "parent_id", "child_id", "child_cells", others.alias("ups"))


def history(ordered: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``runs``, ``times`` and ``height`` of an adjacency."""
    runs = stage(child_runs(ordered), "runs")
    height = levels_of(runs.agg(F.coalesce(F.max("n_timed"), F.lit(0))).first()[0])
    return runs, stage(time_blocks(ordered, runs, height), "times", partition_by=["level"]), height


def build_adjacency(edges: DataFrame, payload: DataFrame | None) -> Adjacency:
    """Edges that carry the other parents (``ups``) are entries as soon as they are in order; others meet the payload."""
    ordered = child_order(edges)
    if "others" in ordered.columns:
        entries = ordered.select("adj_pos", "parent_id", "child_id", "child_cells", ups_of(F.col("others")).alias("ups"), "others")
        return Adjacency(entries, *history(ordered))
    if "ups" in edges.columns:
        return Adjacency(ordered.select("adj_pos", "parent_id", "child_id", "child_cells", "ups"), *history(ordered))
    made = together(
        {"entries": lambda: stage(with_other_parents(ordered, payload), "entries"), "history": lambda: history(ordered)}
    )
    return Adjacency(made["entries"], *made["history"])


def children_at(adjacency: Adjacency, places: DataFrame) -> DataFrame:
    """Rows with an ``adj_pos`` and the child there, with its cells and other parents; plain ids are named after they have met the places."""
    packed = "others" in adjacency.entries.columns
    met = places.join(adjacency.entries.select("adj_pos", "child_id", "child_cells", "others" if packed else "ups"), "adj_pos")
    return met.withColumn("ups", ups_of(F.col("others"))).drop("others") if packed else met


def levels_of(n_timed: int) -> int:
    """Levels of blocks over so many places; one at least."""
    height = 1
    while BLOCK**height < n_timed:
        height += 1
    return height


def child_runs(ordered: DataFrame) -> DataFrame:
    """First place, length and time span of every parent's children."""
    ts = F.col("child_ts")
    return ordered.groupBy(*KEY).agg(
        F.min("adj_pos").alias("start"),
        F.count("*").alias("degree"),
        F.count(ts).alias("n_timed"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.max("fk_pos").alias("max_fk_pos"),
        F.min("child_cells").alias("min_cells"),
        F.count(F.when(F.col("child_cells") == 0, 1)).alias("n_bare"),
    )


def time_blocks(ordered: DataFrame, runs: DataFrame, height: int) -> DataFrame:
    """parent_id, child_class, level, block, ts: at most ``BLOCK`` times in order, whatever they are.

    On level 0 the times of consecutive places of a run, above the first times of consecutive blocks of the level below. A run
    ends on the level where one block holds it. Runs of one moment need none.
    """
    some = runs.filter("first_ts < last_ts").select(*KEY, (F.col("start") + F.col("degree") - F.col("n_timed")).alias("first"), "n_timed")
    timed = ordered.filter(F.col("child_ts").isNotNull()).select(*KEY, "adj_pos", "child_ts").join(some, KEY)
    below = timed.select(*KEY, "n_timed", (F.col("adj_pos") - F.col("first")).alias("at"), F.col("child_ts").alias("ts"))
    levels = []
    for level in range(height):
        block = F.call_function("div", F.col("at"), F.lit(BLOCK))
        packed = below.groupBy(*KEY, "n_timed", block.alias("block")).agg(F.array_sort(F.collect_list("ts")).alias("ts"))
        # Of a tall index each level is written once: the next one reads its first times only.
        packed = stage(packed, f"times{level}") if level + 1 < height else packed
        levels.append(packed.select(F.lit(level).alias("level"), *KEY, "block", "ts"))
        below = packed.filter(F.col("n_timed") > BLOCK ** (level + 1)).select(*KEY, "n_timed", F.col("block").alias("at"), F.get("ts", F.lit(0)).alias("ts"))
    return union_all(levels)


def times_until(ts: Column, moment: Column) -> Column:
    """How many of the sorted times are at or before a moment, by halving the list."""
    rounds = F.sequence(F.lit(0), F.lit(BLOCK.bit_length() - 1))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.call_function("div", acc["lo"] + acc["hi"], F.lit(2)).cast("int")
        early = F.get(ts, mid) <= moment
        narrowed = F.when(early, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(
            F.struct(acc["lo"].alias("lo"), mid.alias("hi"))
        )
        return F.when(acc["lo"] < acc["hi"], narrowed).otherwise(acc)

    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(ts).alias("hi")), halve)["lo"]


def visible_counts(adjacency: Adjacency, asked: DataFrame) -> DataFrame:
    """Add ``start`` and ``n``, the number of children visible at ``seed_ts``, to every question.

    ``asked`` has parent_id, child_class and a non-null ``seed_ts``; a seed
    without a time asks with NO_TIME and sees every child, as children without
    a time are seen by every seed. Equal questions are answered once: a parent
    that all seeds visit at a few moments costs a few lookups. Questions
    without any visible child drop out.
    """
    moment = F.col("seed_ts")
    runs = adjacency.runs.select(*KEY, "start", "degree", "n_timed", "first_ts", "last_ts", "max_fk_pos", "min_cells", "n_bare")
    inside = (F.col("first_ts") <= moment) & (moment < F.col("last_ts"))
    found = asked.select(*KEY, "seed_ts").distinct().join(runs, KEY).withColumn("block", F.when(inside, F.lit(0).cast("bigint")))
    for level in reversed(range(adjacency.height)):
        # From the top block of each run down to the block that the moment falls in.
        times = adjacency.times.filter(F.col("level") == level).select(*KEY, "block", "ts")
        here = F.col("block") * BLOCK + times_until(F.col("ts"), moment) - (1 if level else 0)
        found = found.join(times, [*KEY, "block"], "left")
        found = found.withColumn("block", F.when(F.col("ts").isNotNull(), here).otherwise(F.col("block"))).drop("ts")
    n = (
        F.when(F.col("n_timed") == 0, F.col("degree"))
        .when(F.col("last_ts") <= moment, F.col("degree"))
        .when(moment < F.col("first_ts"), F.col("degree") - F.col("n_timed"))
        .otherwise(F.col("degree") - F.col("n_timed") + F.col("block"))
    )
    answers = found.select(*KEY, "seed_ts", "start", n.alias("n"), "max_fk_pos", "min_cells", "n_bare").filter("n > 0")
    return asked.join(answers, [*KEY, "seed_ts"])
