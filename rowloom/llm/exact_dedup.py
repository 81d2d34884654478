"""Exact dedup as a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.llm.common import whole_text
from rowloom.session import stage

#: White space that two equal texts may differ in.
SPACES = r"[\x20\x09-\x0D]+"
#: Runs that meet in one merge, as a power of two.
FAN_BITS = 6
#: Rows of a first run, on average. A group of copies is split over all runs.
RUN_ROWS = 1024

#: Two texts are the same if their SHA-256 agree; length and a second hash bear witness at each merge.
DIGEST = ("text_sha256", "n_kept", "witness")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, "")


def digests(docs: DataFrame, n_runs: int) -> DataFrame:
    """One row per document: its run and digest, no text."""
    norm = normalised(whole_text())
    return docs.select(
        "doc_id",
        F.pmod(F.xxhash64("doc_id"), F.lit(n_runs)).alias("run"),
        F.sha2(norm, 256).alias("text_sha256"),
        F.length(norm).alias("n_kept"),
        F.xxhash64(norm).alias("witness"),
        F.length(whole_text()).cast("long").alias("n_chars"),
    )


def _merged(runs: DataFrame) -> DataFrame:
    """Runs with equal numbers become one: the best row and the size of each group of equal texts."""
    return runs.groupBy("run", *DIGEST).agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))


def _written(runs: DataFrame, level: int) -> DataFrame:
    return stage(runs.sortWithinPartitions("run", *DIGEST), f"runs{level}")


def exact_groups(docs: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 - one row per row of ``docs``.

    Documents are dealt to runs. A run keeps, sorted by digest, one row per
    distinct text: the candidate to stay (most code points, then smallest id) and
    the number of rows. In each round the runs whose numbers agree but for the
    lowest ``FAN_BITS`` bits meet and merge, so a group of n copies never meets
    in fewer than log(n) rounds and no key carries more than 2**FAN_BITS rows
    after the first level. The winners then go back down the same tree.

    A null text is the empty text. Rows that repeat a doc_id stay or go together
    and all count in ``group_size``; null ids lose to any other id. An empty table gives no rows.
    Further columns of ``docs`` are ignored.
    """
    n = docs.count()
    n_runs = max(1, -(-n // run_rows))
    rows = stage(digests(docs, n_runs), "digests")
    best = F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("minus_id")).alias("best")
    levels = [_written(_merged(rows.select("run", *DIGEST, best, F.lit(1).cast("long").alias("group_size"))), 0)]
    left = n_runs
    while left > 1:
        up = levels[-1].withColumn("run", F.shiftright("run", FAN_BITS))
        levels.append(_written(_merged(up), len(levels)))
        left = (left + (1 << FAN_BITS) - 1) >> FAN_BITS
    won = levels[-1].select("run", *DIGEST, (-F.col("best.minus_id")).alias("keep_id"), "group_size")
    for level in reversed(levels[:-1]):
        below = level.select(F.col("run").alias("own"), F.shiftright("run", FAN_BITS).alias("run"), *DIGEST)
        won = below.join(won, ["run", *DIGEST]).select(F.col("own").alias("run"), *DIGEST, "keep_id", "group_size")
    return rows.join(won, ["run", *DIGEST]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
