"""Rows to nodes, foreign keys to edges, values to typed cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowloom.functions import scalars as S
from rowloom.operators import dictionary as D
from rowloom.operators.closure import path_step, ups_of
from rowloom.operators.index import prefix_offsets, with_row_index
from rowloom.operators.stats import column_stats
from rowloom.operators.util import union_all
from rowloom.session import stage, together
from rowloom.sources.catalog import (
    BOOLEAN,
    DATETIME,
    NUMBER,
    TEXT,
    Catalog,
    Table,
    is_cell,
    numeric_value,
    semantic_type,
)


def key_facts(catalog: Catalog) -> DataFrame:
    """scan_pos, n_keys, n_bits, least, most of each table whose primary key numbers its rows.

    n_keys: rows with a whole number as key. n_bits: distinct keys, as the bits of bitmaps that each cover 32,768
    numbers, so that a hot key costs one bit and no task holds a table's keys.
    """
    parts = []
    for i, t in enumerate(catalog.tables):
        if t.order != "pkey":
            continue
        whole = F.when(F.col(t.pkey) == F.floor(t.pkey), F.col(t.pkey).cast("bigint")).alias("key")
        bits = F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("bits")
        maps = t.df.select(whole).groupBy(F.bitmap_bucket_number("key").alias("span")).agg(
            bits, F.count("key").alias("n_keys"), F.min("key").alias("least"), F.max("key").alias("most")
        )
        parts.append(
            maps.agg(
                F.coalesce(F.sum("n_keys"), F.lit(0)).alias("n_keys"),
                F.coalesce(F.sum(F.when(F.col("n_keys") > 0, F.bitmap_count("bits"))), F.lit(0)).alias("n_bits"),
                F.min("least").alias("least"),
                F.max("most").alias("most"),
            ).select(F.lit(i).alias("scan_pos"), "*")
        )
    return union_all(parts, catalog.spark, "scan_pos int, n_keys bigint, n_bits bigint, least bigint, most bigint")


def table_info(catalog: Catalog) -> DataFrame:
    """Row count, width and first node id of every table, in scan order."""
    counts = union_all(
        [
            t.df.agg(F.count("*").alias("num_nodes")).select(
                F.lit(i).alias("scan_pos"),
                F.lit(t.name).alias("table_name"),
                F.lit(t.split).alias("split"),
                "num_nodes",
                (F.col("num_nodes") * len(t.all_columns())).alias("num_cells"),
            )
            for i, t in enumerate(catalog.tables)
        ]
    )
    return prefix_offsets(counts, "scan_pos", "num_nodes", "node_offset").select(
        "scan_pos",
        S.table_key(F.col("table_name"), F.col("split")).alias("table_key"),
        "table_name",
        "split",
        "node_offset",
        "num_nodes",
        "num_cells",
    )


@dataclass(frozen=True)
class Numbered:
    """A catalog whose rows are numbered: per table, rows with ``node_id`` and its id range."""

    catalog: Catalog
    rows: dict[tuple[str, str], DataFrame]
    ranges: dict[tuple[str, str], tuple[int, int]]
    info: DataFrame

    def node_rows(self, t: Table) -> DataFrame:
        return self.rows[(t.name, t.split)]

    def n_cells(self, t: Table) -> Column:
        """Number of cells of a row: counted already where the rows have come without their values."""
        return F.col(N_CELLS) if N_CELLS in self.node_rows(t).columns else cell_count(t)


# The cells of a row, counted before its values are left behind.
N_CELLS = "__n_cells"


def without_values(t: Table) -> tuple[DataFrame, list[str]]:
    """A table that a sort numbers, without its values: what it is sorted by, and the columns to go on with - keys, time, number of cells."""
    kept = list(dict.fromkeys(c for c in (t.pkey, *t.fkey_cols, t.time_col) if c))
    sorted_by = [c for c in t.order if c not in kept]
    counted = F.lit(1) if t.index_cell else F.lit(0)
    for f in t.value_fields():
        if f.name != t.index_cell:
            counted = counted + F.when(is_cell(f), 1).otherwise(0)
    return t.df.select(*kept, *sorted_by, counted.cast("int").alias(N_CELLS)), [*kept, N_CELLS]


def number_rows(catalog: Catalog, spread: int = 0, values: bool = True, task_values: bool = False) -> Numbered:
    """Assign node ids. Reads back one row per table: the offsets, and what proves that declared dense keys are.

    ``spread`` writes tables that come in fewer pieces again in so many: for tables in a few large files. Without ``values``, tables that a
    sort numbers move and keep only their keys and times: enough for nodes and edges, not for cells. With ``task_values`` that holds for
    tables of the database alone: enough for the seeds of task tables too.
    """
    info = table_info(catalog)
    read = together({"counts": info.collect, "keys": key_facts(catalog).collect})
    ranges = {(r.table_name, r.split): (r.node_offset, r.num_nodes) for r in read["counts"]}
    for facts in read["keys"]:
        refuse_sparse(catalog.tables[facts.scan_pos], ranges, facts)

    def numbered(t: Table) -> tuple[Table, DataFrame]:
        slim = () if values or isinstance(t.order, str) or (task_values and t.is_task) else without_values(t)
        rows = with_row_index(t, *slim).withColumn("node_id", F.col("row_idx") + F.lit(ranges[(t.name, t.split)][0]))
        if spread and t.df.rdd.getNumPartitions() < spread:
            rows = stage(rows.repartition(spread), t.name)
            t = t.with_df(rows.drop("row_idx", "node_id"))
        return t, rows

    done = together({(t.name, t.split): (lambda t=t: numbered(t)) for t in catalog.tables})
    rows = {key: df for key, (_, df) in done.items()}
    tables = [done[(t.name, t.split)][0] for t in catalog.tables]
    return Numbered(Catalog(tuple(tables), catalog.name), rows, ranges, info)


def refuse_sparse(t: Table, ranges: dict[tuple[str, str], tuple[int, int]], facts) -> None:
    """Keys that number the rows must be 0..n-1, each once: else ids would run into those of other tables."""
    n = ranges[(t.name, t.split)][1]
    dense = n == 0 or (facts.n_keys == facts.n_bits == n and facts.least == 0 and facts.most == n - 1)
    if not dense:
        raise ValueError(f"the keys of {t.name} ({t.split}) are not 0 to {n - 1}, each once: give the table another order")


def row_seconds(t: Table):
    return S.epoch_seconds(F.col(t.time_col)) if t.time_col else F.lit(None).cast("bigint")


def cell_count(t: Table):
    """Number of cells of a row, from the row alone."""
    flags = [F.when(is_cell(f), 1).otherwise(0) for f in t.value_fields()]
    total = F.lit(0)
    for flag in flags:
        total = total + flag
    return total.cast("int")


def nodes(
    numbered: Numbered, skip_db: bool = False, compat: bool = False, ups: dict[tuple[str, str], Column] | None = None
) -> DataFrame:
    """One row per table row.

    ``compat`` leaves the timestamp empty on rows without any foreign key
    value; otherwise it always comes from the time column. ``ups`` adds the parents of each table's rows.
    """
    parts = []
    for t in numbered.catalog.tables:
        if skip_db and not t.is_task:
            continue
        ts = row_seconds(t)
        if compat:
            linked = F.lit(False)
            for c in t.fkey_cols:
                linked = linked | F.col(c).isNotNull()
            ts = F.when(linked, ts)
        parts.append(
            numbered.node_rows(t).select(
                "node_id",
                F.lit(t.name).alias("table_name"),
                F.lit(t.split).alias("split"),
                "row_idx",
                ts.alias("ts_sec"),
                F.lit(t.is_task).alias("is_task"),
                numbered.n_cells(t).alias("n_cells"),
                *([ups[(t.name, t.split)].alias("ups")] if ups is not None else []),
            )
        )
    return union_all(parts)


UPS_SCHEMA = "array<struct<fk_pos:int,step:string,parent_id:bigint>>"


def parent_ids(numbered: Numbered, t: Table) -> list[Column] | None:
    """The parent of a row over each of its keys, from the row alone, null where there is none; None where a parent's key is not its row position."""
    out = []
    for col, parent_name in t.fkeys:
        parent = numbered.catalog.table(parent_name, "db")
        if parent.order != "pkey":
            return None
        offset, count = numbered.ranges[(parent.name, "db")]
        key = comparable(t, col, parent)[0].cast("bigint")
        out.append(F.when(key.between(0, count - 1), key + F.lit(offset)))
    return out


def row_ups(numbered: Numbered, t: Table) -> Column | None:
    """The parents of a row with their path steps, from the row alone; None where a parent's key is not its row position."""
    ids = parent_ids(numbered, t)
    if ids is None:
        return None
    entries = []
    for pos, up_id in enumerate(ids):
        up = F.struct(F.lit(pos).alias("fk_pos"), path_step(F.lit(pos)).alias("step"), up_id.alias("parent_id"))
        entries.append(F.when(up_id.isNotNull(), up))
    return F.array_compact(F.array(*entries)).cast(UPS_SCHEMA) if entries else F.array().cast(UPS_SCHEMA)


def row_payload(numbered: Numbered, skip_db: bool = False, compat: bool = False) -> DataFrame | None:
    """What ``node_payload`` makes of nodes and edges, without a shuffle; None where a table's parents need a join."""
    wanted = {(t.name, t.split): row_ups(numbered, t) for t in numbered.catalog.tables if t.is_task or not skip_db}
    if any(ups is None for ups in wanted.values()):
        return None
    rows = nodes(numbered, skip_db, compat, wanted)
    return rows.select("node_id", "table_name", "ts_sec", "is_task", "n_cells", "ups", F.col("ups")["parent_id"].alias("f2p_nbr_ids"))


def row_links(numbered: Numbered) -> DataFrame | None:
    """Edges as the sampling index needs them, without a shuffle: no timestamp of the parent, but the child's other parents.

    ``others`` has the ids of those by the position of their key, null where there is none and at the edge's own key; ``ups`` the same as ``row_ups``.
    """
    parts = []
    for t in numbered.catalog.tables:
        ids = parent_ids(numbered, t)
        if ids is None:
            return None
        if not t.fkeys:
            continue
        own = numbered.node_rows(t).select(
            F.col("node_id").alias("child_id"),
            F.lit(t.name).alias("child_table"),
            F.lit(t.split).alias("child_split"),
            F.lit(numbered.catalog.visibility_class(t)).alias("child_class"),
            row_seconds(t).alias("child_ts"),
            numbered.n_cells(t).alias("child_cells"),
            *[up_id.alias(f"k{pos}") for pos, up_id in enumerate(ids)],
        )
        names = F.array(*[F.lit(c) for c in t.fkey_cols])
        edge = [F.struct(F.lit(pos).alias("fk_pos"), F.col(f"k{pos}").alias("parent_id")) for pos in range(len(ids))]
        others = F.array(*[F.when(F.col("fk_pos") != pos, F.col(f"k{pos}")) for pos in range(len(ids))])
        parts.append(
            own.select("*", F.inline(F.array(*edge))).filter(F.col("parent_id").isNotNull()).select(
                "child_id",
                "fk_pos",
                F.get(names, F.col("fk_pos")).alias("fk_col"),
                "parent_id",
                "child_table",
                "child_split",
                "child_class",
                "child_ts",
                "child_cells",
                others.alias("others"),
                ups_of(others).alias("ups"),
            )
        )
    empty = (
        "child_id bigint, fk_pos int, fk_col string, parent_id bigint, child_table string, child_split string, child_class int, "
        f"child_ts bigint, child_cells int, others array<bigint>, ups {UPS_SCHEMA}"
    )
    return union_all(parts, numbered.catalog.spark, empty)


EDGE_SCHEMA = (
    "child_id bigint, fk_pos int, fk_col string, parent_id bigint, child_table string, child_split string, child_class int, "
    "child_ts bigint, child_cells int, parent_table string, parent_ts bigint"
)


def comparable(child: Table, col: str, parent: Table) -> tuple[Column, Column]:
    """A foreign key and its parent's key in one type: whole numbers of any type, texts, or one same type.

    A number that is not whole, NaN or infinite meets no whole one. Keys that cannot be compared are refused.
    """

    def kind(dtype: T.DataType) -> str:
        if isinstance(dtype, T.NumericType):
            return "number"
        return "text" if isinstance(dtype, T.StringType) else dtype.simpleString()

    def key(df: DataFrame, name: str) -> Column:
        c = F.col(name)
        if isinstance(df.schema[name].dataType, T.IntegralType) or kind(df.schema[name].dataType) != "number":
            return c.cast("bigint") if kind(df.schema[name].dataType) == "number" else c
        whole = (c == F.floor(c)) & (F.abs(c) < F.lit(2.0**63))
        return F.when(whole, c.cast("bigint"))

    kinds = kind(child.df.schema[col].dataType), kind(parent.df.schema[parent.pkey].dataType)
    if kinds[0] != kinds[1]:
        raise ValueError(f"{child.name}.{col} ({kinds[0]}) cannot be compared with {parent.name}.{parent.pkey} ({kinds[1]})")
    return key(child.df, col), key(parent.df, parent.pkey)


def key_report(numbered: Numbered, edges: DataFrame) -> DataFrame:
    """table_name, split, col_name, n_rows, n_set, n_matched of each foreign key: n_set - n_matched values met no parent row."""
    parts = []
    for t in numbered.catalog.tables:
        if t.fkeys:
            entries = [F.struct(F.lit(c).alias("col_name"), F.count(c).alias("n_set")) for c in t.fkey_cols]
            counted = numbered.node_rows(t).agg(F.count("*").alias("n_rows"), F.array(*entries).alias("e"))
            parts.append(counted.select(F.lit(t.name).alias("table_name"), F.lit(t.split).alias("split"), "n_rows", F.inline("e")))
    matched = edges.groupBy(
        F.col("child_table").alias("table_name"), F.col("child_split").alias("split"), F.col("fk_col").alias("col_name")
    ).agg(F.count("*").alias("n_matched"))
    empty = "table_name string, split string, n_rows bigint, col_name string, n_set bigint"
    key = ["table_name", "split", "col_name"]
    return union_all(parts, numbered.catalog.spark, empty).join(matched, key, "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)).cast("bigint"))


def edges(numbered: Numbered, parent_ts: bool = True) -> DataFrame:
    """One row per foreign key value that meets a parent row; several keys to one parent stay apart.

    Where the parent's key is its row position, the parent's id is arithmetic
    and only its timestamp, when there is one, needs a join.
    """
    catalog = numbered.catalog
    parts = []
    for t in catalog.tables:
        if not t.fkeys:
            continue
        base = numbered.node_rows(t)
        common = [
            F.col("node_id").alias("child_id"),
            F.lit(t.name).alias("child_table"),
            F.lit(t.split).alias("child_split"),
            F.lit(catalog.visibility_class(t)).alias("child_class"),
            row_seconds(t).alias("child_ts"),
            numbered.n_cells(t).alias("child_cells"),
        ]
        positional, keyed = [], []
        for pos, (col, parent_name) in enumerate(t.fkeys):
            parent = catalog.table(parent_name, "db")
            needs_ts = parent_ts and parent.time_col is not None
            (positional if parent.order == "pkey" and not needs_ts else keyed).append((pos, col, parent))
        if positional:
            entries = []
            for pos, col, parent in positional:
                offset, count = numbered.ranges[(parent.name, "db")]
                key = comparable(t, col, parent)[0]
                hit = key.between(0, count - 1)
                entries.append(
                    F.struct(
                        F.lit(pos).alias("fk_pos"),
                        F.lit(col).alias("fk_col"),
                        F.when(hit, key + F.lit(offset)).alias("parent_id"),
                        F.lit(parent.name).alias("parent_table"),
                        F.lit(None).cast("bigint").alias("parent_ts"),
                    )
                )
            parts.append(
                base.select(*common, F.explode(F.array(*entries)).alias("e"))
                .select("*", "e.*")
                .drop("e")
                .filter(F.col("parent_id").isNotNull())
            )
        for pos, col, parent in keyed:
            down_key, up_key = comparable(t, col, parent)
            up = numbered.node_rows(parent).select(
                up_key.alias("__key"),
                F.col("node_id").alias("parent_id"),
                row_seconds(parent).alias("parent_ts"),
            )
            down = base.select(*common, down_key.alias("__key")).filter(F.col("__key").isNotNull())
            parts.append(
                down.join(up, "__key")
                .drop("__key")
                .withColumns(
                    {
                        "fk_pos": F.lit(pos),
                        "fk_col": F.lit(col),
                        "parent_table": F.lit(parent.name),
                    }
                )
            )
    return union_all(parts, catalog.spark, EDGE_SCHEMA).select(
        "child_id",
        "fk_pos",
        "fk_col",
        "parent_id",
        "child_table",
        "child_split",
        "child_class",
        "child_ts",
        "child_cells",
        "parent_table",
        "parent_ts",
    )


def parents_list(edges: DataFrame) -> DataFrame:
    """The parents of each node in the order of its keys; as many as the table has keys."""
    pairs = F.array_sort(F.collect_list(F.struct("fk_pos", "parent_id")))
    return edges.groupBy("child_id").agg(F.transform(pairs, lambda p: p["parent_id"]).alias("parent_ids"))


def children_list(edges: DataFrame, span: int = 1 << 20) -> DataFrame:
    """The children of each parent, for export, in chunks of bounded length.

    A chunk covers ``span`` consecutive child ids, so a parent of any size is
    spread over many rows and no list outgrows ``span`` times the key count.
    """
    pairs = F.array_sort(F.collect_list(F.struct("child_id", "fk_pos")))
    return (
        edges.withColumn("chunk", F.floor(F.col("child_id") / F.lit(span)).cast("bigint"))
        .groupBy("parent_id", "chunk")
        .agg(F.transform(pairs, lambda p: p["child_id"]).alias("child_ids"))
    )


KINDS = (NUMBER, TEXT, DATETIME, BOOLEAN)


def raw_cells(numbered: Numbered, t: Table, kinds: tuple[int, ...] = KINDS) -> DataFrame | None:
    """Typed values of one table in long form; nulls and NaN are gone, order is kept.

    With some ``kinds`` only, a cell's place is still counted over all of its row, from the flags of the columns before it.
    """
    catalog = numbered.catalog
    stat_keys, columns = catalog.stat_keys(), catalog.columns()
    entries, place = [], F.lit(0)
    for f in t.value_fields():
        sem = semantic_type(f.dataType)
        if sem in kinds:
            entry = F.struct(
                place.alias("cell_ord"),
                F.lit(columns[(t.name, f.name)]).cast("bigint").alias("col_id"),
                F.lit(stat_keys[(t.name, t.split, f.name)]).alias("stat_key"),
                F.lit(sem).cast("tinyint").alias("sem_type"),
                (F.lit(None).cast("double") if sem == TEXT else numeric_value(f)).alias("raw"),
                (F.col(f.name) if sem == TEXT else F.lit(None).cast("string")).alias("text"),
            )
            entries.append(F.when(is_cell(f), entry))
        place = place + F.when(is_cell(f), 1).otherwise(0)
    if not entries:
        return None
    return numbered.node_rows(t).select("node_id", F.inline(F.array_compact(F.array(*entries))))


def all_raw_cells(numbered: Numbered, skip_db: bool = False, kinds: tuple[int, ...] = KINDS) -> DataFrame:
    parts = [raw_cells(numbered, t, kinds) for t in numbered.catalog.tables if t.is_task or not skip_db]
    schema = "node_id bigint, cell_ord int, col_id bigint, stat_key int, sem_type tinyint, raw double, text string"
    return union_all([p for p in parts if p is not None], numbered.catalog.spark, schema)


def table_texts(catalog: Catalog, skip_db: bool = False) -> DataFrame:
    """Every text value of every table, straight from the columns."""
    parts = []
    for t in catalog.tables:
        if skip_db and not t.is_task:
            continue
        cols = [F.col(f.name) for f in t.value_fields() if semantic_type(f.dataType) == TEXT]
        if cols:
            parts.append(t.df.select(F.explode(F.array(*cols)).alias("text")).filter(F.col("text").isNotNull()))
    return union_all(parts, catalog.spark, "text string")


def cells(numbered: Numbered, stats: DataFrame, dictionary: DataFrame, skip_db: bool = False) -> DataFrame:
    """One row per surviving value: scaled number, datetime or boolean, or a text id.

    Slots of other types hold zero; the class id is -1 unless the cell is text. Numbers, times and booleans go straight to the output;
    texts alone meet the dictionary.
    """
    return value_cells(numbered, stats, skip_db).unionByName(text_cells(numbered, dictionary, skip_db))


def value_cells(numbered: Numbered, stats: DataFrame, skip_db: bool = False) -> DataFrame:
    """The cells that are no texts, without a shuffle."""
    own = all_raw_cells(numbered, skip_db, (NUMBER, DATETIME, BOOLEAN)).drop("text")
    # One row of statistics per column of the schema.
    scaled = own.join(F.broadcast(stats.select("stat_key", "mean", "std")), "stat_key")
    z = S.zscore(F.col("raw"), F.col("mean"), F.col("std"), F.col("col_id"))

    def slot(kind: int, name: str):
        return F.when(F.col("sem_type") == kind, z).otherwise(F.lit(0.0)).cast("float").alias(name)

    return scaled.select(
        "node_id",
        "cell_ord",
        "col_id",
        "sem_type",
        slot(NUMBER, "number_value"),
        F.lit(0).cast("bigint").alias("text_id"),
        slot(DATETIME, "datetime_value"),
        slot(BOOLEAN, "boolean_value"),
        F.lit(-1).cast("bigint").alias("class_value_id"),
    )


def text_cells(numbered: Numbered, dictionary: DataFrame, skip_db: bool = False) -> DataFrame:
    texts = all_raw_cells(numbered, skip_db, (TEXT,)).select("node_id", "cell_ord", "col_id", "sem_type", S.text_digest(F.col("text")).alias("digest"))
    none = lambda name: F.lit(0.0).cast("float").alias(name)
    return D.encode_texts(texts, dictionary, F.col("node_id")).select(
        "node_id",
        "cell_ord",
        "col_id",
        "sem_type",
        none("number_value"),
        F.col("text_id").cast("bigint").alias("text_id"),
        none("datetime_value"),
        none("boolean_value"),
        F.col("text_id").cast("bigint").alias("class_value_id"),
    )


def row_cells(numbered: Numbered, stats: DataFrame) -> DataFrame:
    """node_id, cells: the cells of each row in order, with place, column, type and scaled number, zero unless the cell is one.

    Texts keep their places but not their ids, so nothing meets the dictionary and nothing moves. Rows without cells are left out.
    """
    catalog = numbered.catalog
    stat_keys, columns = catalog.stat_keys(), catalog.columns()
    # One entry per column of the schema.
    entry = F.struct("stat_key", F.struct("mean", "std").alias("s"))
    known = F.broadcast(stats.agg(F.map_from_entries(F.collect_list(entry)).alias("_stats")))
    parts = []
    for t in catalog.tables:
        entries, place = [], F.lit(0)
        for f in t.value_fields():
            sem, col_id = semantic_type(f.dataType), F.lit(columns[(t.name, f.name)]).cast("bigint")
            z = F.lit(0.0)
            if sem == NUMBER:
                s = F.col("_stats")[stat_keys[(t.name, t.split, f.name)]]
                z = S.zscore(numeric_value(f), s["mean"], s["std"], col_id)
            cell = F.struct(place.alias("cell_ord"), col_id.alias("col_id"), F.lit(sem).cast("tinyint").alias("sem_type"), z.cast("float").alias("number_value"))
            entries.append(F.when(is_cell(f), cell))
            place = place + F.when(is_cell(f), 1).otherwise(0)
        if entries:
            rows = numbered.node_rows(t).crossJoin(known)
            parts.append(rows.select("node_id", F.array_compact(F.array(*entries)).alias("cells")).filter(F.size("cells") > 0))
    return union_all(parts, catalog.spark, "node_id bigint, cells array<struct<cell_ord:int,col_id:bigint,sem_type:tinyint,number_value:float>>")


def infinite_cells(numbered: Numbered, stats: DataFrame) -> DataFrame:
    """Number cells that scaling would make infinite, counted per column."""
    raw = all_raw_cells(numbered, kinds=(NUMBER,))
    return (
        raw.join(F.broadcast(stats.select("stat_key", "table_name", "col_name", "mean", "std")), "stat_key")
        .filter(F.abs((F.col("raw") - F.col("mean")) / F.col("std")) == F.lit(float("inf")))
        .groupBy("table_name", "col_name")
        .agg(F.count("*").alias("n_infinite"))
    )


@dataclass(frozen=True)
class Graph:
    """The relational graph as tables."""

    catalog: Catalog
    ranges: dict[tuple[str, str], tuple[int, int]]
    nodes: DataFrame
    edges: DataFrame
    cells: DataFrame
    text_dict: DataFrame
    column_index: DataFrame
    col_stats: DataFrame
    table_info: DataFrame
    # Payload and links straight from the rows, where every parent's key is its row position.
    payload: DataFrame | None = None
    links: DataFrame | None = None
    numbered: Numbered | None = None

    def member(self, db: str) -> tuple[int, "Graph"]:
        """Number and graph of a database: a graph by itself is database 0, whatever its tasks call it."""
        return 0, self

    def table_names(self) -> list[str]:
        return [t.name for t in self.catalog.tables]

    def max_parents(self) -> int:
        return self.catalog.max_parents()

    TABLES = ("nodes", "edges", "cells", "text_dict", "column_index", "col_stats", "table_info")


def build_graph(
    spark: SparkSession,
    catalog: Catalog,
    staged: bool = True,
    skip_db: bool = False,
    compat: bool = False,
    datetime_splits: list[str] | None = None,
    parent_ts: bool = True,
    spread: int = 0,
) -> Graph:
    """Nodes, edges, cells and their dictionaries for a catalog.

    The text dictionary is written once; ``staged`` writes the statistics as well, so that
    every later table starts from them.
    """
    numbered = number_rows(catalog, spread)

    def statistics() -> DataFrame:
        stats = column_stats(numbered.catalog, datetime_splits=datetime_splits)
        return stage(stats, "col_stats") if staged else stats

    def dictionary() -> DataFrame:
        return D.build_dictionary(table_texts(numbered.catalog, skip_db), D.schema_texts(spark, catalog))

    made = together({"stats": statistics, "texts": dictionary})
    stats, texts = made["stats"], made["texts"]
    return Graph(
        catalog=catalog,
        ranges=numbered.ranges,
        nodes=nodes(numbered, skip_db, compat),
        edges=edges(numbered, parent_ts),
        cells=cells(numbered, stats, texts, skip_db),
        text_dict=texts,
        column_index=D.column_index(spark, catalog, texts),
        col_stats=stats,
        table_info=numbered.info,
        payload=row_payload(numbered, skip_db, compat),
        links=row_links(numbered),
        numbered=numbered,
    )
