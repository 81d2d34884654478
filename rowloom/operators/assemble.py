"""Shuffling, sharding and padding of contexts into batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowloom.functions import scalars as S
from rowloom.operators.dictionary import HOT_SHARE
from rowloom.operators.index import dense_index_by_hash


# Array columns of a batch row: name -> (field of a context cell, padding value, type).
BATCH_ARRAYS = {
    "node_ids": ("node_id", -1, "bigint"),
    "table_ids": ("table_id", 0, "int"),
    "col_ids": ("col_id", 0, "bigint"),
    "class_value_ids": ("class_value_id", -1, "bigint"),
    "sem_types": ("sem_type", 0, "tinyint"),
    "number_values": ("number_value", 0.0, "float"),
    "text_ids": ("text_id", 0, "bigint"),
    "datetime_values": ("datetime_value", 0.0, "float"),
    "boolean_values": ("boolean_value", 0.0, "float"),
    "masks": ("mask", False, "boolean"),
    "is_targets": ("is_target", False, "boolean"),
    "is_task_nodes": ("is_task_node", False, "boolean"),
}


def epoch_order(seeds: DataFrame, epoch: int, seed: int = 0) -> DataFrame:
    """A reproducible shuffle: every seed's ``position`` in the given epoch."""
    key = F.md5(
        F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), "task_id", F.col("seed_id").cast("string"))
    )
    return dense_index_by_hash(seeds, key, ["task_id", "seed_id"], "position").withColumn("epoch", F.lit(epoch))


def num_batches(seeds: DataFrame, batch_size: int, world_size: int, by: list[str] | None = None) -> DataFrame:
    return seeds.groupBy(*(by or [])).agg(
        F.count("*").alias("n_items"),
        F.ceil(F.count("*") / F.lit(batch_size * world_size)).cast("bigint").alias("n_batches"),
    )


def stripe(order: DataFrame, batch_size: int, world_size: int, n_items: int | None = None) -> DataFrame:
    """Place every item in (batch_idx, rank, slot), and fill the last batch from the start.

    Places beyond the last item repeat the first ones (``is_wrapped``); a rank
    with no item of its own left in the last batch has no rows there.
    """
    n = order.agg(F.count("*")).scalar() if n_items is None else F.lit(n_items).cast("bigint")
    per = batch_size * world_size

    def div(a: Column, b: int) -> Column:
        return F.call_function("div", a, F.lit(b))

    total = F.ceil(n / F.lit(per)) * per
    j = F.col("j")
    own = n - F.col("batch_idx") * per - F.col("rank") * batch_size
    return (
        order.select("*", F.explode(F.sequence(F.col("position"), total - 1, n)).alias("j"))
        .withColumns(
            {
                "batch_idx": div(j, per).cast("bigint"),
                "rank": (div(j, batch_size) % world_size).cast("int"),
                "slot": (j % batch_size).cast("int"),
                "is_wrapped": j >= n,
            }
        )
        .withColumn("true_batch_size", F.least(F.lit(batch_size), own).cast("int"))
        .filter(F.col("true_batch_size") > 0)
        .drop("j", "position")
    )


def pad_contexts(
    cells: DataFrame, seq_len: int, table_names: list[str], n_parents: int, bf16: bool = False, arrays: tuple[str, ...] | None = None
) -> DataFrame:
    """One row per context: every cell field as an array of ``seq_len``, padded at the end.

    ``n_parents``, the most foreign keys of any table, is the width of the parent lists: no parent is left out.
    ``arrays``: only the named arrays are made, of the same contexts and cells; fields behind the others are not read.
    """
    wanted = {name: of for name, of in BATCH_ARRAYS.items() if arrays is None or name in arrays}
    with_parents = arrays is None or "f2p_nbr_ids" in arrays
    names = F.array(*[F.lit(n) for n in sorted(set(table_names))])
    value = {f: F.col(f) for f in ("number_value", "datetime_value", "boolean_value")}
    if bf16:
        value = {f: S.bf16(c) for f, c in value.items()}
    parents = F.concat("f2p_nbr_ids", F.array_repeat(F.lit(-1).cast("bigint"), n_parents))
    made = {"table_id": (F.array_position(names, F.col("table_name")) - 1).cast("int"), **value}
    fields = [
        F.col("pos"),
        *([F.slice(parents, 1, n_parents).alias("parents")] if with_parents else []),
        *[made.get(f, F.col(f)).alias(f) for f, _, _ in wanted.values()],
    ]
    packed = cells.groupBy("task_no", "seed_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))
    missing = F.lit(seq_len) - F.size("c")
    columns = [
        # A field of an array of structs is the array of that field.
        F.concat(F.col("c")[field], F.array_repeat(F.lit(pad).cast(kind), missing)).alias(name)
        for name, (field, pad, kind) in wanted.items()
    ]
    no_parents = F.array_repeat(F.lit(-1).cast("bigint"), n_parents)
    return packed.select(
        "task_no",
        "seed_id",
        F.size("c").alias("n_cells"),
        *columns,
        *([F.concat(F.col("c")["parents"], F.array_repeat(no_parents, missing)).alias("f2p_nbr_ids")] if with_parents else []),
        F.concat(F.array_repeat(F.lit(False), F.size("c")), F.array_repeat(F.lit(True), missing)).alias("is_padding"),
    )


def assemble_batches(slots: DataFrame, padded: DataFrame) -> DataFrame:
    """Batch rows: the place of every item joined to its padded context."""
    return slots.join(padded, ["task_no", "seed_id"])


def mask_wrapped(batches: DataFrame) -> DataFrame:
    """For evaluation: repeated rows lose their targets and count as padding."""
    w = F.col("is_wrapped")

    def clear(name: str, to: bool) -> Column:
        return F.when(w, F.transform(F.col(name), lambda _: F.lit(to))).otherwise(F.col(name))

    return batches.withColumns(
        {"masks": clear("masks", False), "is_targets": clear("is_targets", False), "is_padding": clear("is_padding", True)}
    )


def limit_batches(batches: DataFrame, max_steps: int) -> DataFrame:
    """The first ``max_steps`` batches; -1 keeps all."""
    return batches if max_steps < 0 else batches.filter(F.col("batch_idx") < max_steps)


def write_batches(batches: DataFrame, path: str) -> None:
    """One folder per epoch and rank; each rank's rows are spread by batch."""
    batches.repartition("epoch", "rank", "batch_idx").write.partitionBy("epoch", "rank").parquet(path)


BATCH = ["epoch", "rank", "batch_idx"]


def vectors_of(ids: DataFrame, vectors: DataFrame, uses: DataFrame) -> DataFrame:
    """``ids`` (any columns and text_id) with the vector ``vec`` of each text.

    The texts that fill most cells (at most HOT_SHARE of them, by ``uses``: text_id, n_uses) come from a broadcast table, so no key of the join is
    hot; the rest meet the vectors by id.
    """
    total = uses.agg(F.coalesce(F.sum("n_uses"), F.lit(0))).scalar()
    hot = uses.filter(F.col("n_uses") * F.lit(HOT_SHARE) > total).select("text_id")
    table = vectors.select("text_id", "vec")
    common = F.broadcast(table.join(F.broadcast(hot), "text_id", "left_semi").withColumnRenamed("vec", "hot_vec"))
    known = ids.join(common, "text_id", "left")
    # Ids found already take a key that no text has, each its own.
    key = F.when(F.col("hot_vec").isNull(), F.col("text_id")).otherwise(-F.abs(F.xxhash64(*ids.columns) % (1 << 62)) - 1)
    cold = table.select(F.col("text_id").alias("__text"), F.col("vec").alias("cold_vec"))
    return known.withColumn("__text", key).join(cold, "__text", "left").select(*ids.columns, F.coalesce("hot_vec", "cold_vec").alias("vec"))


def indexed(batches: DataFrame, ids: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Where each cell of a batch finds its id in the sorted list of the batch's distinct ids (-1: nowhere), and those lists in long form.

    First table: BATCH, slot, ``at`` (one place per cell). Second: BATCH, place, ``text_id``. Padding and negative ids have none.
    """
    cells = batches.select(*BATCH, "slot", F.posexplode(F.arrays_zip(F.col(ids).alias("id"), F.col("is_padding").alias("pad"))).alias("pos", "c"))
    cells = cells.select(*BATCH, "slot", "pos", F.when(~F.col("c.pad") & (F.col("c.id") >= 0), F.col("c.id")).alias("id"))
    order = W.partitionBy(*BATCH).orderBy(F.col("id").asc_nulls_last())
    ranked = cells.withColumn("place", F.when(F.col("id").isNotNull(), F.dense_rank().over(order) - 1).otherwise(-1))
    rows = ranked.groupBy(*BATCH, "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "place"))), lambda c: c["place"]).alias(at))
    return rows, ranked.filter("place >= 0").select(*BATCH, "place", F.col("id").alias("text_id")).distinct()


def batch_vectors(batches: DataFrame, vectors: DataFrame, column_index: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of the texts and of the column names of every batch.

    First table: the batch rows with ``text_at`` and ``name_at``, one place per cell. Second: one row per batch (BATCH) with ``text_block`` and
    ``name_block``, the distinct vectors that the places point to: the cells of B rows and S places have the vectors block[at], of shape (B, S, d),
    and -1 stands for none. Each vector is in a batch once, however many cells share it.
    """
    text_at, text_ids = indexed(batches, "class_value_ids", "text_at")
    name_at, name_ids = indexed(batches, "col_ids", "name_at")
    # One row per column of the schema.
    names = F.broadcast(
        column_index.select("col_id", "name_text_id").join(vectors.select(F.col("text_id").alias("name_text_id"), "vec"), "name_text_id").select("col_id", "vec")
    )

    def block(found: DataFrame, name: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("place", "vec")))
        return found.groupBy(*BATCH).agg(F.transform(listed, lambda v: v["vec"]).alias(name))

    texts = block(vectors_of(text_ids, vectors, uses), "text_block")
    columns = block(name_ids.withColumnRenamed("text_id", "col_id").join(names, "col_id"), "name_block")
    blocks = columns.join(texts, BATCH, "left").withColumn("text_block", F.coalesce("text_block", F.array().cast("array<array<float>>")))
    rows = batches.join(text_at, [*BATCH, "slot"]).join(name_at, [*BATCH, "slot"])
    return rows, blocks.select(*BATCH, "text_block", "name_block")


def attach_embeddings(cells: DataFrame, text_emb: DataFrame, column_index: DataFrame) -> DataFrame:
    """Vectors of the column name and of the text value, looked up for shown cells only."""
    names = column_index.select("col_id", "name_text_id").join(
        text_emb.select(F.col("text_id").alias("name_text_id"), F.col("vec").alias("col_name_vec")), "name_text_id"
    )
    texts = text_emb.select(F.col("text_id").alias("class_value_id"), F.col("vec").alias("text_vec"))
    # Cells without a text share the class id -1: give them keys of their own.
    key = F.when(F.col("class_value_id") >= 0, F.col("class_value_id")).otherwise(-F.col("node_id") - 1)
    return (
        cells.join(names.select("col_id", "col_name_vec"), "col_id", "left")
        .withColumn("__text", key)
        .join(texts.withColumnRenamed("class_value_id", "__text"), "__text", "left")
        .drop("__text")
    )
