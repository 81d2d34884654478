"""Tables with roles: primary key, foreign keys, time column, split.

The catalog is the only thing kept on the driver; its size is the number of
tables and columns of the database.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowloom.functions import scalars as S

SPLITS = ("db", "train", "val", "test")

# Hidden columns that hold a row's place in the files.
FILE_ORDER = ("__file__", "__row__")

NUMBER, TEXT, DATETIME, BOOLEAN = 0, 1, 2, 3


@dataclass(frozen=True)
class Table:
    """One source table and the roles of its columns.

    ``order`` says what a row's position is: ``"pkey"`` when the primary key
    already counts the rows 0..n-1, ``"file"`` for the order of rows in the
    files, or a tuple of columns that is unique per row. ``index_cell`` names a
    feature column that repeats the row position, so that a table of nothing
    but foreign keys still has a cell.
    """

    name: str
    df: DataFrame
    split: str = "db"
    pkey: str | None = None
    fkeys: tuple[tuple[str, str], ...] = ()
    time_col: str | None = None
    order: str | tuple[str, ...] = "file"
    index_cell: str | None = None

    @property
    def is_task(self) -> bool:
        return self.split != "db"

    @property
    def fkey_cols(self) -> list[str]:
        return [c for c, _ in self.fkeys]

    def value_fields(self) -> list[T.StructField]:
        """Columns that become cells: all but the primary and foreign keys."""
        keys = {self.pkey, *self.fkey_cols, *FILE_ORDER}
        fields = [f for f in self.df.schema.fields if f.name not in keys]
        if self.index_cell:
            fields.insert(0, T.StructField(self.index_cell, T.LongType()))
        return fields

    def all_columns(self) -> list[str]:
        names = [c for c in self.df.columns if c not in FILE_ORDER]
        return [self.index_cell, *names] if self.index_cell else names

    def with_df(self, df: DataFrame) -> "Table":
        return replace(self, df=df)


@dataclass(frozen=True)
class Catalog:
    """Tables in scan order: database tables by name, then task tables."""

    tables: tuple[Table, ...]
    name: str = "db"
    _cols: dict = field(default_factory=dict, compare=False, repr=False)

    @staticmethod
    def of(tables: Iterable[Table], name: str = "db") -> "Catalog":
        rank = {s: i for i, s in enumerate(("db", "test", "train", "val"))}
        ordered = sorted(tables, key=lambda t: (t.is_task, t.name, rank[t.split]))
        return Catalog(tuple(ordered), name)

    @property
    def spark(self) -> SparkSession:
        return self.tables[0].df.sparkSession

    def table(self, name: str, split: str = "db") -> Table:
        for t in self.tables:
            if (t.name, t.split) == (name, split):
                return t
        raise KeyError(f"no table {name} with split {split}")

    def has(self, name: str, split: str = "db") -> bool:
        return any((t.name, t.split) == (name, split) for t in self.tables)

    def columns(self) -> dict[tuple[str, str], int]:
        """(table, column) -> column id, numbered by table then position.

        Every column counts, keys included; the splits of a task table share
        their column ids.
        """
        if not self._cols:
            seen: dict[tuple[str, str], int] = {}
            for t in sorted(self.tables, key=lambda t: t.name):
                for c in t.all_columns():
                    seen.setdefault((t.name, c), len(seen))
            self._cols.update(seen)
        return self._cols

    def column_id(self, column: str, table: str) -> int:
        try:
            return self.columns()[(table, column)]
        except KeyError:
            raise ValueError(f'column "{column} of {table}" is not in the catalog') from None

    def stat_keys(self) -> dict[tuple[str, str, str], int]:
        """(table, split, column) -> key of a row of the column statistics."""
        keys: dict[tuple[str, str, str], int] = {}
        for t in self.tables:
            for f in t.value_fields():
                keys[(t.name, t.split, f.name)] = len(keys)
        return keys

    def task_classes(self) -> dict[str, int]:
        """Visibility class of each task table; database tables are class 0."""
        names = sorted({t.name for t in self.tables if t.is_task})
        return {n: i + 1 for i, n in enumerate(names)}

    def visibility_class(self, table: Table) -> int:
        return self.task_classes()[table.name] if table.is_task else 0

    def max_parents(self) -> int:
        """The most foreign keys of any table."""
        return max((len(t.fkeys) for t in self.tables), default=0)

    def has_cycle(self) -> bool:
        return self.max_hops() is None

    def max_hops(self) -> int | None:
        """Longest chain of foreign keys between tables; None when cyclic."""
        parents: dict[str, set[str]] = {}
        for t in self.tables:
            parents.setdefault(f"{t.name}/{t.is_task}", set()).update(f"{p}/False" for _, p in t.fkeys)
        depth: dict[str, int | None] = {}
        busy: set[str] = set()

        def walk(n: str) -> int | None:
            if n in depth:
                return depth[n]
            if n in busy:
                return None
            busy.add(n)
            hops: int | None = 0
            for p in parents.get(n, ()):
                below = walk(p)
                if below is None:
                    hops = None
                    break
                hops = max(hops, below + 1)
            busy.discard(n)
            depth[n] = hops
            return hops

        found = [walk(n) for n in parents]
        return None if None in found else max(found, default=0)


def semantic_type(dtype: T.DataType) -> int:
    """Number, text, datetime or boolean; other types are refused."""
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, (T.IntegralType, T.FractionalType)):
        return NUMBER
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(dtype, T.StringType):
        return TEXT
    raise ValueError(f"columns of type {dtype.simpleString()} cannot become cells")


def numeric_value(f: T.StructField) -> Column:
    """A column as a double: numbers widened, booleans 0/1, times in microseconds."""
    c = F.col(f.name)
    sem = semantic_type(f.dataType)
    if sem == DATETIME:
        return S.epoch_micros(c).cast("double")
    return c.cast("double")


def is_cell(f: T.StructField) -> Column:
    """True where the field yields a cell: not null and not NaN."""
    c = F.col(f.name)
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


# -- sources ---------------------------------------------------------------


def is_link_task(path_in_db: str) -> bool:
    """Link-prediction tasks carry exactly two hyphens in their path within the database."""
    return path_in_db.count("-") == 2


def _listing(root: str):
    """All parquet files below ``root``, and the tables they make up: a file or a folder of part files each."""
    from pyarrow import fs

    filesystem, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    infos = filesystem.get_file_info(fs.FileSelector(base, recursive=True))
    files = sorted(i.path for i in infos if i.is_file and i.path.endswith(".parquet"))
    tables: dict[tuple[str, ...], str] = {}
    for path in files:
        parts = path[len(base):].strip("/").split("/")
        ends = [k for k, part in enumerate(parts) if part.endswith(".parquet")]
        tables.setdefault(tuple(parts[: ends[0] + 1]), path)
    return filesystem, tables


def table_of_path(parts: tuple[str, ...]) -> tuple[str, str]:
    """Table name and split of db/<t>.parquet or tasks/<t>/<split>.parquet; anything else is refused."""
    if len(parts) == 2 and parts[0] == "db":
        return parts[1].removesuffix(".parquet"), "db"
    if len(parts) == 3 and parts[0] == "tasks" and (split := parts[2].removesuffix(".parquet")) in SPLITS[1:]:
        return parts[1], split
    raise ValueError(f"{'/'.join(parts)} is neither db/<table>.parquet nor tasks/<table>/<{'|'.join(SPLITS[1:])}>.parquet")


def read_roles(filesystem, path: str, fk_override: dict[str, str] | None = None) -> dict:
    """Roles stored as JSON in the footer of a parquet file (one footer, on the driver)."""
    import pyarrow.parquet as pq

    meta = pq.read_metadata(path, filesystem=filesystem).metadata or {}
    try:
        pkey = json.loads(meta[b"pkey_col"])
        fkeys = json.loads(meta[b"fkey_col_to_pkey_table"])
        time_col = json.loads(meta[b"time_col"])
    except KeyError as missing:
        raise ValueError(f"{path} has no {missing} entry in its footer") from None
    override = fk_override or {}
    fkeys = {c: override.get(c, p) for c, p in fkeys.items()}
    return {"pkey": pkey, "fkeys": tuple(fkeys.items()), "time_col": time_col}


# Foreign keys whose declared parent is replaced, per database.
FK_OVERRIDES = {
    "rel-avito": {"UserID": "UserInfo", "AdID": "AdsInfo"},
}


def load_catalog(
    spark: SparkSession,
    root: str,
    name: str,
    clean: Callable[[str, Table], Table] | None = None,
) -> Catalog:
    """Read a database folder: db/*.parquet first, then tasks/*/*.parquet, each by path.

    A table is a file or a folder of part files. The roles come from the footers. ``clean(name, table)``
    may change a table before its rows are numbered in the order of the files. Link-prediction tasks are left out with a
    warning; any other path is an error.
    """
    filesystem, paths = _listing(root.rstrip("/"))
    tables, left_out = [], []
    for parts, first_file in sorted(paths.items()):
        if is_link_task("/".join(parts)):
            left_out.append("/".join(parts))
            continue
        table, split = table_of_path(parts)
        roles = read_roles(filesystem, first_file, FK_OVERRIDES.get(name))
        df = spark.read.parquet(f"{root.rstrip('/')}/{'/'.join(parts)}")
        # Keys count in the order of the table's columns, whatever the order of the footer.
        roles["fkeys"] = tuple(sorted(roles["fkeys"], key=lambda k: df.columns.index(k[0])))
        found = Table(name=table, df=df, split=split, order="file", **roles)
        tables.append(clean(name, found) if clean is not None else found)
    if left_out:
        warnings.warn(f"link-prediction tables left out of {name}: {', '.join(left_out)}", stacklevel=2)
    return Catalog.of(tables, name)


def table_roles(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """The roles as a table: one row per table, split and role column."""
    rows = []
    for t in catalog.tables:
        if t.pkey:
            rows.append((t.name, t.split, "pkey", t.pkey, None))
        for col, parent in t.fkeys:
            rows.append((t.name, t.split, "fkey", col, parent))
        if t.time_col:
            rows.append((t.name, t.split, "time", t.time_col, None))
    schema = "table_name string, split string, role string, col_name string, parent_table string"
    return spark.createDataFrame(rows, schema)
