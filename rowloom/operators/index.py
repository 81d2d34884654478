"""Dense row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowloom.session import stage
from rowloom.sources.catalog import FILE_ORDER, Table


# One offset per file: this many take some 200 MB at most and are broadcast;
# the offsets of more files are joined by a shuffle.
BROADCAST_FILES = 1_000_000


def prefix_offsets(counts: DataFrame, key: str, n: str = "n", name: str = "offset") -> DataFrame:
    """Exclusive running sum over a small table of counts (one row per partition, file or table)."""
    w = W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("bigint"))


def dense_index(df: DataFrame, keys: list[str], name: str = "row_idx", keep: list[str] | None = None) -> DataFrame:
    """Number the rows 0..n-1 in the order of ``keys`` (unique, so no key is hot). With ``keep``, only those columns are written.

    A range sort spreads the rows; the sorted rows are written once, because
    range bounds are sampled and a second run could draw others. Positions
    then follow from the counts per partition.
    """
    rows = sorted_rows(df, keys, name, keep)
    part, local = mid_parts()
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    # One row per sorted partition, so the offsets are small by construction.
    offsets = prefix_offsets(counts, "__part").select("__part", "offset")
    return (
        rows.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("offset") + local)
        .drop("__part", "offset", "__mid")
    )


def mid_parts() -> tuple[Column, Column]:
    """Sorted partition of a row of ``sorted_rows``, and its place there."""
    return F.shiftright("__mid", 33), F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))


def sorted_rows(df: DataFrame, keys: list[str | Column], name: str, keep: list[str] | None = None) -> DataFrame:
    """The rows in the order of ``keys``, written once, with ``__mid``, which holds their place."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stage(ordered.select(*(["*"] if keep is None else keep), F.monotonically_increasing_id().alias("__mid")), name)


def known_index(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """``dense_index`` without a join: the offsets, one per sorted partition, become part of the plan, so that the table keeps its true size."""
    rows = sorted_rows(df, keys, name)
    part, local = mid_parts()
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    found = {r.part: r.offset for r in prefix_offsets(counts, "part").collect()}
    offsets = F.lit([found.get(p, 0) for p in range(max(found, default=0) + 1)]).cast("array<bigint>")
    return rows.withColumn(name, (F.get(offsets, part.cast("int")) + local).cast("bigint")).drop("__mid")


def dense_index_by_hash(df: DataFrame, hex_key: Column, tie: list[str], name: str, bits: int = 12) -> DataFrame:
    """Number the rows 0..n-1 in the order of an evenly spread hexadecimal key.

    The leading digits of the key cut the rows into buckets of equal expected
    size, so the order needs no sampled bounds: count the buckets, add them
    up, number the rows within each.
    """
    digits = max(1, bits // 4)
    rows = df.withColumn("__hex", hex_key).withColumn("__bucket", F.substring("__hex", 1, digits))
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("n"))
    offsets = prefix_offsets(counts, "__bucket").select("__bucket", "offset")
    w = W.partitionBy("__bucket").orderBy("__hex", *tie)
    # At most 16^digits rows of offsets.
    return (
        rows.withColumn("__rn", F.row_number().over(w))
        .join(F.broadcast(offsets), "__bucket")
        .withColumn(name, (F.col("offset") + F.col("__rn") - 1).cast("bigint"))
        .drop("__bucket", "__hex", "__rn", "offset")
    )


def file_order(df: DataFrame) -> DataFrame:
    """Keep a row's place in the files, for tables that drop rows later on."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(FILE_ORDER[0]),
        F.col("_metadata.row_index").alias(FILE_ORDER[1]),
    )


def with_row_index(table: Table, rows: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """The table's rows with ``row_idx``, their position 0..n-1.

    Dense primary keys are positions already. The order of the files needs no
    shuffle: only the row counts of the files are added up. ``rows``: the table with other columns than its own;
    ``keep``: those of them that a sort has to write.
    """
    df = table.df if rows is None else rows
    if table.order == "pkey":
        out = df.withColumn("row_idx", F.col(table.pkey).cast("bigint"))
    elif table.order == "file":
        rows = file_order(df)
        counts = rows.groupBy(FILE_ORDER[0]).agg((F.max(FILE_ORDER[1]) + 1).alias("n"))
        offsets = prefix_offsets(counts, FILE_ORDER[0]).select(FILE_ORDER[0], "offset")
        if len(df.inputFiles()) <= BROADCAST_FILES:
            offsets = F.broadcast(offsets)
        out = (
            rows.join(offsets, FILE_ORDER[0])
            .withColumn("row_idx", F.col("offset") + F.col(FILE_ORDER[1]))
            .drop("offset", *FILE_ORDER)
        )
    else:
        out = dense_index(df, list(table.order), "row_idx", keep)
    if table.index_cell:
        out = out.withColumn(table.index_cell, F.col("row_idx"))
    return out
