"""The operators as stages of the corpus pipeline: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowloom.llm import exact_dedup as exact
from rowloom.llm import language_id as language
from rowloom.llm import mixing as mix
from rowloom.llm import near_dedup as near
from rowloom.llm import packing as pack
from rowloom.session import stage

#: Near-duplicates of the pipeline: five words, a similarity of 0.8 or more.
NEAR = near.Threshold(80, 100)

#: Names of columns that stages put beside all columns of the documents; no table of documents has them.
GONE, MIXED, COPIES, NTH = (f"__rowloom_{name}" for name in ("gone", "mixed", "copies", "nth"))


def _without_dropped(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id some row of ``decided`` (doc_id, kept) keeps; a null doc_id meets a null one.

    What goes is written first: few ids, which Spark broadcasts where their true size allows, so that no text is shuffled; otherwise it joins.
    """
    gone = decided.groupBy(F.col("doc_id").alias(GONE)).agg(F.bool_or("kept").alias("kept")).filter("NOT kept").select(GONE)
    gone = stage(gone, "dropped")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[GONE]), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the model rejects: texts without a letter, and those whose language it cannot tell."""
    return language.accepted(docs, language.train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return _without_dropped(docs, exact.exact_groups(docs).select("doc_id", "kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays."""
    return _without_dropped(docs, near.near_duplicates(docs, NEAR).select("doc_id", "kept"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes its words, on average: 0 to 3 times.

    The mix takes blocks of words; taken / size is rounded up or down by a hash of the id, so that
    the sum over a source stays near its target. Texts without words are never taken.
    """
    mixed = mix.mix(docs).groupBy("doc_id").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("times"))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(mix.SEED + 1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = mixed.select(F.col("doc_id").alias(MIXED), F.floor(F.col("times") + unit).cast("int").alias(COPIES)).filter(F.col(COPIES) > 0)
    copies = stage(copies, "copies")
    met = docs.join(copies, docs["doc_id"].eqNullSafe(copies[MIXED]))
    return met.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), copies[COPIES])).alias(NTH)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    from public_tokenizers import path

    pieces = pack.token_pieces(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    return pack.pack(stage(pieces, "pieces"))
