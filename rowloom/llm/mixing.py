"""Mixing sources to target weights: multinomial block counts per output shard, permuted block indexes, a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowloom.llm.common import whole_text
from rowloom.session import stage

#: Words of a block, blocks of an output shard.
BLOCK_WORDS, SHARD_BLOCKS = 64, 4096
#: Weights of the sources in the order of their names; they repeat.
WEIGHTS = (1.0, 2.0, 3.0)
#: A source is used so many times at most.
MOST_EPOCHS = 3
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words: white space comes off the ends and falls in between."""
    inner = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def share_out(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST_EPOCHS) -> list[float]:
    """Targets by weight that add up to the sum of sizes; none above ``most`` times its size, the excess reshared."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    target, left = [0.0] * len(sizes), float(sum(sizes))
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free:
        per = left / sum(weight[i] for i in free)
        full = [i for i in free if per * weight[i] > most * sizes[i]]
        if not full:
            for i in free:
                target[i] = per * weight[i]
            break
        for i in full:
            target[i] = most * float(sizes[i])
            left -= target[i]
        free = [i for i in free if i not in full]
    return target


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and the place of each document's words in the endless tape of its source.

    Documents lie on the tape in the order of a hash of their ids. Offsets are
    running sums within chunks of that order, plus the sums of the chunks before:
    no window holds a source.
    """
    rows = stage(
        docs.select(F.col("doc_id").cast("long"), "source", word_count(whole_text()).alias("size"), F.xxhash64("doc_id", F.lit(SEED)).alias("place")),
        "sizes",
    )
    n_chunks = max(1, int(rows.count() ** 0.5))
    rows = rows.withColumn("chunk", F.pmod(F.shiftrightunsigned("place", 20), F.lit(n_chunks)).cast("int"))
    chunks = rows.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    before = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select(F.col("source").alias("of"), F.col("chunk").alias("nth"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    order = W.partitionBy("source", "chunk").orderBy("place", "doc_id", "size")
    placed = rows.withColumn("rank", F.row_number().over(order)).withColumn(
        "inside", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    )
    met = placed.join(chunks, placed["source"].eqNullSafe(chunks["of"]) & (placed["chunk"] == chunks["nth"]))
    return met.select("doc_id", "source", "size", "chunk", "rank", (F.col("base") + F.col("inside")).alias("offset"))


def permuted(slots: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1, elementwise: Feistel rounds over the next even number of bits, walked back into range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = slots.astype(np.uint64), np.arange(len(slots))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            mixed = (right + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ k
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(33)) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


DRAWN = "shard long, source_no int, n long"
SLOTS = "shard long, source_no int, slot long, block long"


def draw_shards(slots: DataFrame, quota: np.ndarray, total: int, seed: int = SEED) -> DataFrame:
    """shard, source_no, n: how many blocks of each source a shard takes.

    Each shard has its expected counts in whole blocks, and draws the rest of
    its room from the multinomial of what the whole blocks leave, so that the mean is exact and the spread small.
    """
    share = quota / quota.sum()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, sources, counts = [], [], []
            for shard in batch.column(0).to_pylist():
                room = min(SHARD_BLOCKS, total - shard * SHARD_BLOCKS)
                expected = share * room
                whole = np.floor(expected + 1e-9).astype(np.int64)
                rest = np.maximum(expected - whole, 0)
                if (left := int(room - whole.sum())) > 0:
                    odds = rest / rest.sum() if rest.sum() > 0 else share
                    whole = whole + np.random.default_rng([seed, shard]).multinomial(left, odds)
                for source in np.flatnonzero(whole).tolist():
                    shards.append(shard)
                    sources.append(source)
                    counts.append(int(whole[source]))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(sources, pa.int32()), pa.array(counts, pa.int64())], ["shard", "source_no", "n"])

    return slots.mapInArrow(draw, DRAWN)


def draw_blocks(spark, blocks: list[int], targets: list[float], seed: int = SEED) -> DataFrame:
    """shard, source_no, slot, block: which block of its source fills each slot of each shard.

    ``blocks`` and ``targets`` (in blocks) are per source. Slots of a source are
    numbered through all shards; slot j is block j mod n of the (j div n)-th
    pseudorandom permutation of the source's n blocks, so that no block comes a second time before all came once.
    Slots beyond ``MOST_EPOCHS`` permutations, which the draw may exceed by a few, stay empty.
    """
    quota = np.array(targets, float)
    total = int(round(quota.sum()))
    if total <= 0:
        return spark.createDataFrame([], SLOTS)
    n_shards = -(-total // SHARD_BLOCKS)
    shards = spark.range(0, n_shards, 1, max(1, min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    drawn = stage(draw_shards(shards, quota, total, seed), "drawn")
    # Shards in chunks, as for documents: a source has as many rows here as there are shards.
    chunk = F.shiftright("shard", 10)
    order = W.partitionBy("source_no", chunk).orderBy("shard")
    inside = drawn.withColumn("chunk", chunk).withColumn("first", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
    sums = drawn.groupBy("source_no", chunk.alias("chunk")).agg(F.sum("n").alias("words"))
    before = W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source_no", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    runs = inside.join(sums, ["source_no", "chunk"]).select("shard", "source_no", (F.col("base") + F.col("first")).alias("first"), "n")
    sizes = np.array(blocks, np.int64)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, source, first, n = (batch.column(i).to_numpy() for i in range(4))
            of = np.repeat(np.arange(len(n)), n)
            slot = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            size = sizes[source[of]]
            used = slot < MOST_EPOCHS * size
            of, slot, size = of[used], slot[used], size[used]
            turn = (slot // size).astype(np.uint64)
            key = (source[of].astype(np.uint64) * np.uint64(MOST_EPOCHS + 1) + turn + np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
            block = permuted(slot % size, size, key)
            yield pa.RecordBatch.from_arrays([pa.array(shard[of]), pa.array(source[of]), pa.array(slot), pa.array(block)], ["shard", "source_no", "slot", "block"])

    return runs.mapInArrow(fill, SLOTS)


def source_table(rows: DataFrame) -> list[dict]:
    """Name, size and target of each source: by code point, null last. One row per source reaches the driver."""
    found = [(r["source"], r["size"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    targets = share_out([s for _, s in found])
    return [{"source": n, "source_no": i, "size": s, "target": t} for i, ((n, s), t) in enumerate(zip(found, targets))]


def shard_spans(placed: DataFrame, taken: DataFrame) -> DataFrame:
    """shard, slot, doc_id, from_word, n_words: the words themselves, slot by slot, for writing the mix out."""
    return taken.join(_pieces(placed), ["source_no", "block"]).select("shard", "source_no", "slot", "doc_id", "from_word", "n_words")


def _pieces(placed: DataFrame) -> DataFrame:
    """The part of each document in each block that it reaches."""
    first, last = F.expr(f"offset div {BLOCK_WORDS}"), F.expr(f"(offset + size - 1) div {BLOCK_WORDS}")
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest("offset", F.col("block") * BLOCK_WORDS)
    end = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    return cut.withColumn("from_word", begin - F.col("offset")).withColumn("n_words", end - begin)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source - one row per row of ``docs``.

    The words of each source, in fixed-length blocks, are drawn into output
    shards in the proportion of the targets; taken is how many words of the document
    the mix holds, repeats counted, never above ``MOST_EPOCHS`` times its size. The
    draw depends on ids, sizes and sources only, so that reruns agree. A null source is a
    source of its own; null and empty texts have size 0 and are never taken.
    Repeated rows are documents of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = stage(sized(docs), "placed")
    table = source_table(rows)
    numbers = spark.createDataFrame(
        [(t["source"], t["source_no"], t["size"], t["target"]) for t in table], "of string, source_no int, source_size long, target double"
    )
    placed = rows.join(numbers, rows["source"].eqNullSafe(numbers["of"])).drop("of")
    blocks = [-(-t["size"] // BLOCK_WORDS) for t in table]
    # The last block of a source is short: its blocks hold this many words on average.
    targets = [t["target"] / t["size"] * b if t["size"] else 0.0 for t, b in zip(table, blocks)]
    uses = draw_blocks(spark, blocks, targets).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    # The planner takes the slots for as small as the drawn counts; they grow with the words and must not be broadcast.
    uses = uses.hint("merge")
    key = ["source_no", "chunk", "rank"]
    taken = _pieces(placed).select(*key, "block", "n_words").join(uses, ["source_no", "block"]).groupBy(*key).agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    return placed.join(taken, key, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source"
    )
