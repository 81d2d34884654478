"""What several operators share: tables, held-out rows, tolerant input columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A batch handed to Python holds so many rows and bytes at most, so that very long texts do not add up.
BATCH_ROWS = 512
BATCH_BYTES = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_REMEMBERED: dict[str, Callable[[], None]] = {}


def remember_only(kind: str, forget: Callable[[], None]) -> None:
    """Called in a task before it fills a memory of its worker process: what the process remembers for other operators goes.

    Worker processes outlive their stages, so in a pipeline the memories of all operators would add up.
    """
    others = [k for k in _REMEMBERED if k != kind]
    for other in others:
        _REMEMBERED.pop(other)()
    if others:
        pa.default_memory_pool().release_unused()
    _REMEMBERED[kind] = forget


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def remainder(doc_id: str = "doc_id") -> Column:
    return (id_crc(doc_id) % 5).cast("int")


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes: Python's ``bytes.lower`` and ``bytes.split`` are exactly A-Z and ``[\\x20\\x09-\\x0D]``."""
    return whole_text(text).cast("binary")


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chosen_ids(ids: DataFrame, rows: int, skip: int = 0, drawn: int = 0) -> DataFrame:
    """At most ``rows`` of the distinct ids, in the order of a hash, after the first ``skip``.

    Several draws from the same ids are parts of one order only if they look at the same share of them: each then names in
    ``drawn`` how many rows they take in all.
    A share of the hash range that holds some four times as many goes into the sort, so that no task gathers ids from the
    whole table.
    """
    share = min(1.0, 4 * (max(rows + skip, drawn) + 25) / max(1, ids.count()))
    near = ids.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return near.orderBy(F.xxhash64("doc_id"), "doc_id").offset(skip).limit(rows).select("doc_id")


def labelled_rows(docs: DataFrame, labels: DataFrame, mark: str, value: int, rows: int, skip: int = 0, drawn: int = 0) -> DataFrame:
    """Texts (``text``, bytes) of at most ``rows`` documents with this label, after the first ``skip``, outside the held-out fifth; ``drawn``: see ``chosen_ids``.

    The ids are chosen from the labels alone, by a hash; they are at most
    ``rows``, so that they may be broadcast and no text is shuffled.
    """
    marks = labels.filter(remainder() != 0).groupBy("doc_id").agg(F.max(mark).alias(mark))
    ids = chosen_ids(marks.filter(F.col(mark) == value).select("doc_id"), rows, skip, drawn)
    return docs.filter("text IS NOT NULL").join(F.broadcast(ids), "doc_id", "left_semi").select(text_bytes().alias("text"))
