"""Column statistics: one scan per table, then a table as small as the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowloom.operators.util import union_all
from rowloom.session import stage
from rowloom.sources.catalog import (
    DATETIME,
    TEXT,
    Catalog,
    Table,
    is_cell,
    numeric_value,
    semantic_type,
)


def table_moments(table: Table) -> DataFrame:
    """Count, mean and both variances of every non-text value column of one table."""
    fields = [f for f in table.value_fields() if f.name in table.df.columns]
    timed = [f for f in fields if semantic_type(f.dataType) != TEXT]
    indexed = [f for f in table.value_fields() if f.name == table.index_cell]
    if not timed and not indexed:
        return None
    aggs = []
    if table.index_cell:
        # Positions 0..n-1: their moments are known from the count.
        n = F.count("*")
        i = len(timed)
        aggs += [
            n.alias(f"n{i}"),
            ((n - 1) / 2).alias(f"m{i}"),
            F.when(n > 1, F.sqrt(n * (n + 1) / 12)).alias(f"s{i}"),
            ((n * n - 1) / 12).alias(f"v{i}"),
        ]
    for i, f in enumerate(timed):
        x = F.when(is_cell(f), numeric_value(f))
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"m{i}"),
            F.stddev_samp(x).alias(f"s{i}"),
            F.var_pop(x).alias(f"v{i}"),
        ]
    entries = [
        F.struct(
            F.lit(f.name).alias("col_name"),
            F.lit(semantic_type(f.dataType)).cast("tinyint").alias("sem_type"),
            F.col(f"n{i}").alias("n"),
            F.col(f"m{i}").alias("avg"),
            F.col(f"s{i}").alias("sd"),
            F.col(f"v{i}").alias("var"),
        )
        for i, f in enumerate([*timed, *indexed])
    ]
    return (
        table.df.agg(*aggs)
        .select(F.inline(F.array(*entries)))
        .select(F.lit(table.name).alias("table_name"), F.lit(table.split).alias("split"), "*")
    )


def column_moments(catalog: Catalog) -> DataFrame:
    """The moments of all tables; written once, as every statistic starts from these few rows."""
    parts = [m for m in (table_moments(t) for t in catalog.tables) if m is not None]
    schema = "table_name string, split string, col_name string, sem_type tinyint, n bigint, avg double, sd double, var double"
    return stage(union_all(parts, catalog.spark, schema), "moments")


def datetime_moments(moments: DataFrame, splits: list[str] | None = None) -> DataFrame:
    """One mean and one population deviation over every datetime value of the database.

    Pools all tables and all splits unless ``splits`` narrows them. Group
    moments are merged around the common mean, which does not cancel.
    """
    m = moments.filter((F.col("sem_type") == DATETIME) & (F.col("n") > 0))
    if splits is not None:
        m = m.filter(F.col("split").isin(splits))
    mean = m.agg((F.sum(F.col("n") * F.col("avg")) / F.sum("n")).alias("mean")).scalar()
    d = F.col("avg") - mean
    return m.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"),
        (F.sum(F.col("n") * F.col("avg")) / F.sum("n")).alias("mean"),
        F.sqrt(F.sum(F.col("n") * (F.col("var") + d * d)) / F.sum("n")).alias("std"),
    )


def column_stats(
    catalog: Catalog,
    moments: DataFrame | None = None,
    datetime_splits: list[str] | None = None,
) -> DataFrame:
    """Mean and deviation of every value column of every table and split.

    Numbers: sample deviation, 1 when undefined or zero. Booleans: the same
    guard. Datetimes: the pooled pair. Text: zeros. Validation and test tables
    take the statistics of the train table, by column name.
    """
    moments = column_moments(catalog) if moments is None else moments
    pooled = datetime_moments(moments, datetime_splits).first()
    mean, std = pooled["mean"] or 0.0, pooled["std"] or 1.0
    sem = F.col("sem_type")
    own = moments.select(
        "table_name",
        "split",
        "col_name",
        "sem_type",
        F.when(sem == DATETIME, F.lit(mean))
        .otherwise(F.coalesce("avg", F.lit(0.0))).alias("mean"),
        F.when(sem == DATETIME, F.lit(std))
        .otherwise(F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0))).alias("std"),
    )
    wanted = []
    for t in catalog.tables:
        source = "train" if t.split in ("val", "test") else t.split
        if not catalog.has(t.name, source):
            raise ValueError(f"table {t.name} has split {t.split} but no train table")
        known = {f.name for f in catalog.table(t.name, source).value_fields()}
        for f in t.value_fields():
            sem_type = semantic_type(f.dataType)
            if sem_type != TEXT and f.name not in known:
                raise ValueError(f"column {f.name} of {t.name}/{t.split} is not in its train table")
            key = catalog.stat_keys()[(t.name, t.split, f.name)]
            wanted.append((key, t.name, t.split, f.name, sem_type, source))
    spark = moments.sparkSession
    schema = "stat_key int, table_name string, split string, col_name string, sem_type tinyint, source string"
    names = spark.createDataFrame(wanted, schema)
    o = own.select(
        "table_name", F.col("split").alias("source"), "col_name", "mean", "std"
    )
    return names.join(F.broadcast(o), ["table_name", "source", "col_name"], "left").select(
        "stat_key",
        "table_name",
        "split",
        "col_name",
        "sem_type",
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.coalesce("std", F.lit(0.0)).alias("std"),
    )
