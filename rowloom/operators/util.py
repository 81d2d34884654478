from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def union_all(parts: list[DataFrame], spark: SparkSession | None = None, schema: str | None = None) -> DataFrame:
    """The union by name; with no parts, an empty table of the given schema."""
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b), parts)


# Ids of several databases in one pool: the number of the database above the id that a row, place, column or text has there.
DB_SHIFT = 40


def db_of(id_: Column) -> Column:
    return F.shiftright(id_, DB_SHIFT).cast("int")


def local_id(id_: Column) -> Column:
    return id_.bitwiseAND(F.lit((1 << DB_SHIFT) - 1))


def in_db(id_: Column, db_no: int) -> Column:
    return id_ + F.lit(db_no << DB_SHIFT)
