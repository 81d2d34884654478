"""Text dictionary with dense ids, and the encoding of text cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.functions import scalars as S
from rowloom.operators.index import known_index
from rowloom.sources.catalog import Catalog

# A text is hot when it makes up more than one part in HOT_SHARE of all text
# cells; there can be no more than HOT_SHARE hot texts, whatever the data.
HOT_SHARE = 10_000


def schema_texts(spark, catalog: Catalog) -> DataFrame:
    """Table names and "<column> of <table>" names, one row each."""
    names = {t.name for t in catalog.tables} | {f"{c} of {t}" for t, c in catalog.columns()}
    return spark.createDataFrame([(n,) for n in sorted(names)], "text string")


def build_dictionary(texts: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Distinct texts with a dense id and their number of uses.

    Uses are added up before the shuffle, so a text that fills a third of all
    cells moves once per task. Ids follow the order of the digests, which is
    evenly spread and the same on every cluster. The result is written once.
    """
    uses = texts.filter(F.col("text").isNotNull()).select("text", F.lit(1).cast("bigint").alias("n"))
    if extra is not None:
        uses = uses.unionByName(extra.select("text", F.lit(0).cast("bigint").alias("n")))
    counted = uses.groupBy("text").agg(F.sum("n").alias("n_uses"))
    # Texts move to their places and are written there once; digests are neither moved nor written.
    digest = S.text_digest(F.col("text"))
    return known_index(counted, [digest], "text_id").select("text_id", "text", digest.alias("digest"), "n_uses")


def encode_texts(cells: DataFrame, dictionary: DataFrame, spread_by: Column) -> DataFrame:
    """Add ``text_id`` to rows that carry a ``digest`` (null digests stay null).

    Hot texts, whose number is bounded, are looked up from a broadcast table,
    and their rows meet no shuffle. The other rows meet the dictionary by digest;
    rows without a text take a key of their own there so that they spread evenly.
    """
    total = dictionary.agg(F.sum("n_uses")).scalar()
    hot = dictionary.filter(F.col("n_uses") * F.lit(HOT_SHARE) > total).select(
        "digest", F.col("text_id").alias("hot_id")
    )
    found = cells.join(F.broadcast(hot), "digest").withColumnRenamed("hot_id", "text_id").drop("digest")
    # Digests have 32 bytes; a spreading key is shorter and matches none.
    key = F.coalesce("digest", F.encode(spread_by.cast("string"), "UTF-8"))
    by_digest = dictionary.select(F.col("digest").alias("__key"), "text_id")
    rare = cells.join(F.broadcast(hot), "digest", "left_anti").withColumn("__key", key)
    return found.unionByName(rare.join(by_digest, "__key", "left").drop("__key", "digest"))


def column_index(spark, catalog: Catalog, dictionary: DataFrame | None = None) -> DataFrame:
    """Column ids by name; with a dictionary, also the text ids of the names."""
    rows = [(i, c, t, f"{c} of {t}") for (t, c), i in catalog.columns().items()]
    index = spark.createDataFrame(rows, "col_id bigint, col_name string, table_name string, text string")
    if dictionary is None:
        return index.drop("text")
    names = F.broadcast(index)
    return (
        dictionary.select("text", "text_id")
        .join(names, "text")
        .select("col_id", "col_name", "table_name", F.col("text_id").alias("name_text_id"))
    )
