"""Task catalogue: what is predicted, from which table, and what would leak."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowloom.functions.scalars import epoch_seconds
from rowloom.operators.util import union_all
from rowloom.sources.catalog import Catalog, is_cell


@dataclass(frozen=True)
class Task:
    """``kind``: forecast (own task table) or autocomplete (a column of a database table).
    ``type``: clf or reg."""

    db: str
    table: str
    target: str
    drop_cols: tuple[str, ...] = ()
    kind: str = "forecast"
    type: str = "clf"

    @property
    def task_id(self) -> str:
        return f"{self.db}/{self.table}/{self.target}"


_ELIGIBILITY_TEXT = ("minimum_age", "maximum_age", "population", "criteria", "gender_description")

# Fixed values: (database, table, target column, leakage columns).
FORECAST_CLF = [
    ("rel-amazon", "user-churn", "churn", ()),
    ("rel-hm", "user-churn", "churn", ()),
    ("rel-stack", "user-badge", "WillGetBadge", ()),
    ("rel-amazon", "item-churn", "churn", ()),
    ("rel-stack", "user-engagement", "contribution", ()),
    ("rel-avito", "user-visits", "num_click", ()),
    ("rel-avito", "user-clicks", "num_click", ()),
    ("rel-event", "user-ignore", "target", ()),
    ("rel-trial", "study-outcome", "outcome", ()),
    ("rel-f1", "driver-dnf", "did_not_finish", ()),
    ("rel-event", "user-repeat", "target", ()),
    ("rel-f1", "driver-top3", "qualifying", ()),
]
FORECAST_REG = [
    ("rel-hm", "item-sales", "sales", ()),
    ("rel-amazon", "user-ltv", "ltv", ()),
    ("rel-amazon", "item-ltv", "ltv", ()),
    ("rel-stack", "post-votes", "popularity", ()),
    ("rel-trial", "site-success", "success_rate", ()),
    ("rel-trial", "study-adverse", "num_of_adverse_events", ()),
    ("rel-event", "user-attendance", "target", ()),
    ("rel-f1", "driver-position", "position", ()),
    ("rel-avito", "ad-ctr", "num_click", ()),
]
AUTOCOMPLETE_CLF = [
    ("rel-avito", "SearchInfo", "IsUserLoggedOn", ()),
    ("rel-stack", "postLinks", "LinkTypeId", ()),
    ("rel-amazon", "review", "verified", ()),
    ("rel-trial", "studies", "has_dmc", ()),
    ("rel-trial", "eligibilities", "adult", ("child", "older_adult", *_ELIGIBILITY_TEXT)),
    ("rel-trial", "eligibilities", "child", ("adult", "older_adult", *_ELIGIBILITY_TEXT)),
    ("rel-event", "event_interest", "not_interested", ("interested",)),
]
AUTOCOMPLETE_REG = [
    ("rel-amazon", "review", "rating", ("review_text", "summary")),
    (
        "rel-f1",
        "results",
        "position",
        ("statusId", "positionOrder", "points", "laps", "milliseconds", "fastestLap", "rank"),
    ),
    ("rel-f1", "qualifying", "position", ()),
    ("rel-trial", "studies", "enrollment", ()),
    ("rel-f1", "constructor_results", "points", ()),
    ("rel-f1", "constructor_standings", "position", ("wins", "points")),
    ("rel-hm", "transactions", "price", ()),
    ("rel-event", "users", "birthyear", ()),
]
# Task tables scored as regression by the name rule; all others are classification.
REGRESSION_TABLES = [
    "item-sales",
    "user-ltv",
    "item-ltv",
    "post-votes",
    "site-success",
    "study-adverse",
    "user-attendance",
    "driver-position",
    "ad-ctr",
]

KNOWN_TASKS = [
    Task(*row, kind=kind, type=type_)
    for group, kind, type_ in (
        (FORECAST_CLF, "forecast", "clf"),
        (FORECAST_REG, "forecast", "reg"),
        (AUTOCOMPLETE_CLF, "autocomplete", "clf"),
        (AUTOCOMPLETE_REG, "autocomplete", "reg"),
    )
    for row in group
]

TASK_SCHEMA = (
    "task_no int, task_id string, db string, table_name string, target string, "
    "drop_cols array<string>, kind string, type string"
)


def task_frame(spark: SparkSession, tasks: list[Task]) -> DataFrame:
    rows = [
        (i, t.task_id, t.db, t.table, t.target, list(t.drop_cols), t.kind, t.type) for i, t in enumerate(tasks)
    ]
    return spark.createDataFrame(rows, TASK_SCHEMA)


def leave_one_db_out(tasks: DataFrame, db: str) -> DataFrame:
    return tasks.filter(F.col("db") != db)


def leave_one_task_out(tasks: DataFrame, db: str, table: str) -> DataFrame:
    return tasks.filter((F.col("db") == db) & (F.col("table_name") != table))


def type_by_name(table: Column) -> Column:
    """The rule that goes by table name; the catalogue's ``type`` is the better source."""
    return F.when(table.isin(REGRESSION_TABLES), "reg").otherwise("clf")


@dataclass(frozen=True)
class ResolvedTask:
    """A task against a catalog: its column ids and the node ids its seeds come from."""

    task_no: int
    task: Task
    split: str
    target_col_id: int
    drop_col_ids: tuple[int, ...]
    seed_class: int
    first_node: int
    num_nodes: int
    hidden_ranges: tuple[tuple[int, int], ...]
    db_no: int = 0


def resolve_tasks(
    catalog: Catalog, ranges: dict[tuple[str, str], tuple[int, int]], tasks: list[Task], split: str
) -> list[ResolvedTask]:
    """Look up tables and columns. A database table of that name wins over the split,
    so such tasks use all of its rows for every split. Unknown names are errors."""
    resolved = []
    for i, t in enumerate(tasks):
        where = (t.table, "db") if (t.table, "db") in ranges else (t.table, split)
        if where not in ranges:
            raise ValueError(f"no table {t.table} for split {split}")
        first, count = ranges[where]
        drops = tuple(catalog.column_id(c, t.table) for c in t.drop_cols)
        spans = tuple((f, f + n - 1) for (name, _), (f, n) in ranges.items() if name == t.table) if drops else ()
        resolved.append(
            ResolvedTask(
                task_no=i,
                task=t,
                split=split,
                target_col_id=catalog.column_id(t.target, t.table),
                drop_col_ids=drops,
                seed_class=catalog.task_classes().get(t.table, 0),
                first_node=first,
                num_nodes=count,
                hidden_ranges=spans,
            )
        )
    return resolved


def hidden_columns(tasks: list[ResolvedTask]) -> tuple[tuple[int, int, int], ...]:
    """Node ranges that may lose leakage columns, with the most a task hides there."""
    most: dict[tuple[int, int], int] = {}
    for t in tasks:
        for span in t.hidden_ranges:
            most[span] = max(most.get(span, 0), len(t.drop_col_ids))
    return tuple((a, b, n) for (a, b), n in sorted(most.items()))


def hidden_children(tasks: list[ResolvedTask]) -> tuple[tuple[int, int, int], ...]:
    """Database numbers and visibility classes of task tables that may lose leakage columns, with the most a task hides there."""
    most: dict[tuple[int, int], int] = {}
    for t in tasks:
        if t.seed_class and t.drop_col_ids:
            where = (t.db_no, t.seed_class)
            most[where] = max(most.get(where, 0), len(t.drop_col_ids))
    return tuple((*where, n) for where, n in sorted(most.items()))


def seed_ranges(tasks: DataFrame, table_info: DataFrame, splits: list[str]) -> DataFrame:
    """Node range per task and split, the database table first."""
    wanted = tasks.select("*", F.explode(F.array(*[F.lit(s) for s in splits])).alias("wanted_split"))
    info = table_info.select("table_name", "split", "node_offset", "num_nodes")
    found = wanted.join(F.broadcast(info), "table_name").filter(
        (F.col("split") == "db") | (F.col("split") == F.col("wanted_split"))
    )
    best = F.min_by(F.struct("split", "node_offset", "num_nodes"), F.when(F.col("split") == "db", 0).otherwise(1))
    return found.groupBy("task_id", F.col("wanted_split")).agg(best.alias("b")).select(
        "task_id", "wanted_split", F.col("b.split").alias("found_split"), "b.node_offset", "b.num_nodes"
    )


def row_seeds(numbered, tasks: list[ResolvedTask]) -> DataFrame:
    """The seeds of ``seeds``, from the rows of the tasks' tables alone: a row has a target cell where its target is a value."""
    parts = []
    for t in tasks:
        # As in resolve_tasks, a database table wins over the split.
        split = "db" if (t.task.table, "db") in numbered.ranges else t.split
        table = numbered.catalog.table(t.task.table, split)
        (target,) = [f for f in table.value_fields() if f.name == t.task.target]
        parts.append(
            numbered.node_rows(table)
            .filter(is_cell(target))
            .select(
                F.lit(t.task_no).alias("task_no"),
                F.lit(t.task.task_id).alias("task_id"),
                F.col("node_id").alias("seed_id"),
                (epoch_seconds(F.col(table.time_col)) if table.time_col else F.lit(None).cast("bigint")).alias("seed_ts"),
                F.lit(t.seed_class).alias("seed_class"),
                F.lit(table.name).alias("seed_table"),
            )
        )
    return union_all(parts)


def seeds(nodes: DataFrame, cells: DataFrame, tasks: list[ResolvedTask]) -> DataFrame:
    """Rows to predict: those of the task's range that still have their target cell.

    The tasks of a run share one pool, so larger tasks weigh more.
    """
    parts = []
    for t in tasks:
        ids = F.col("node_id").between(t.first_node, t.first_node + t.num_nodes - 1)
        has_target = cells.filter(ids & (F.col("col_id") == t.target_col_id)).select("node_id")
        parts.append(
            nodes.filter(ids)
            .join(has_target, "node_id", "left_semi")
            .select(
                F.lit(t.task_no).alias("task_no"),
                F.lit(t.task.task_id).alias("task_id"),
                F.col("node_id").alias("seed_id"),
                F.col("ts_sec").alias("seed_ts"),
                F.lit(t.seed_class).alias("seed_class"),
                F.col("table_name").alias("seed_table"),
            )
        )
    return union_all(parts)
