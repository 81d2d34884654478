"""Column cleaning, applied to a table before its rows are numbered."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from rowloom.operators.index import file_order
from rowloom.sources.catalog import FILE_ORDER, Table


def binarize_first(df: DataFrame, column: str, order: list) -> DataFrame:
    """True where the column, as a string, equals its value in the first row; nulls stay null.

    The first row is found by an aggregate with one small result, read as a
    scalar. A null there is an error.
    """
    as_text = F.col(column).cast("string")
    key = F.struct(*order)
    first = df.agg(F.min(F.struct(key.alias("k"), as_text.alias("v")))["v"].alias("v")).scalar()
    wanted = F.when(first.isNull(), F.raise_error(F.lit(f"{column} is null in the first row"))).otherwise(first)
    return df.withColumn(column, as_text == wanted)


def cast_boolean(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("boolean"))


def first_element(df: DataFrame, column: str) -> DataFrame:
    """A list column by its first element; null and empty lists become null."""
    return df.withColumn(column, F.try_element_at(F.col(column), F.lit(1)))


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


# The cleaning of the known databases, as
# (database, table) -> list of (step, column).
CLEANING = {
    ("rel-stack", "postLinks"): [("binarize", "LinkTypeId")],
    ("rel-trial", "studies"): [("binarize", "has_dmc")],
    ("rel-trial", "eligibilities"): [("binarize", "adult"), ("binarize", "child"), ("binarize", "older_adult")],
    ("rel-amazon", "user-churn"): [("boolean", "churn")],
    ("rel-amazon", "item-churn"): [("boolean", "churn")],
    ("rel-amazon", "product"): [("first", "category")],
    ("rel-stack", "user-engagement"): [("boolean", "contribution")],
    ("rel-stack", "user-badge"): [("boolean", "WillGetBadge")],
    ("rel-stack", "posts"): [("drop", "AcceptedAnswerId")],
    ("rel-trial", "study-outcome"): [("boolean", "outcome")],
    ("rel-f1", "driver-dnf"): [("boolean", "did_not_finish")],
    ("rel-f1", "driver-top3"): [("boolean", "qualifying")],
    ("rel-hm", "user-churn"): [("boolean", "churn")],
    ("rel-event", "event_attendees"): [("dropna", None)],
    ("rel-event", "user_friends"): [("dropna", None), ("index", "dummy")],
    ("rel-event", "user-repeat"): [("drop", "index"), ("boolean", "target")],
    ("rel-event", "user-ignore"): [("drop", "index"), ("boolean", "target")],
    ("rel-event", "user-attendance"): [("drop", "index"), ("boolean", "target")],
    ("rel-avito", "user-visits"): [("boolean", "num_click")],
    ("rel-avito", "user-clicks"): [("boolean", "num_click")],
}


def clean_table(database: str, table: Table) -> Table:
    """Apply the cleaning steps of a known database to one of its tables."""
    df, order, index_cell = table.df, table.order, table.index_cell
    for step, column in CLEANING.get((database, table.name), []):
        if step == "binarize":
            df = binarize_first(df, column, [F.col("_metadata.file_path"), F.col("_metadata.row_index")])
        elif step == "boolean":
            df = cast_boolean(df, column)
        elif step == "first":
            df = first_element(df, column)
        elif step == "drop":
            df = drop_columns(df, column)
        elif step == "dropna":
            if order == "file":
                # Positions of the surviving rows follow their place in the files.
                df, order = file_order(df), FILE_ORDER
            df = drop_null_rows(df)
        elif step == "index":
            index_cell = column
    fkeys = tuple((c, p) for c, p in table.fkeys if c in df.columns)
    return replace(table, df=df, order=order, index_cell=index_cell, fkeys=fkeys)
