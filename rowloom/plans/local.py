"""Catalog and tasks over the star-schema tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowloom.plans.params import CUTOFFS, LABEL_DAYS
from rowloom.sources.catalog import Catalog, Table
from rowloom.session import stage
from rowloom.sources.tasks import Task

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")

CHURN = Task("local", "customer-churn", "churn", (), "forecast", "clf")
SPEND = Task("local", "customer-spend", "spend", (), "forecast", "reg")
ORDER_TOTAL = Task("local", "orders", "o_totalprice", ("o_orderstatus",), "autocomplete", "reg")
LINE_OPEN = Task("local", "lineitem", "l_linestatus", ("l_returnflag",), "autocomplete", "clf")
# A second database over some of the same tables, and a task in it.
GEO_TABLES = ["region", "nation", "supplier", "customer"]
GEO_BALANCE = Task("geo", "supplier", "s_acctbal", (), "autocomplete", "reg")
LOCAL_TASKS = [CHURN, SPEND, ORDER_TOTAL, LINE_OPEN]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_customer(orders: DataFrame) -> DataFrame:
    """Per cutoff and customer with an earlier order: no later order in 180 days, and their value.

    The cutoffs are a short list, so each order is copied to those it counts for
    and the rest is one aggregate.
    """
    cutoffs = F.array(
        *[F.struct(F.lit(ts).cast("timestamp_ntz").alias("ts"), F.lit(split).alias("split")) for ts, split in CUTOFFS]
    )
    day = F.col("o_orderdate")
    rows = (
        orders.select("o_custkey", "o_orderdate", "o_totalprice", F.explode(cutoffs).alias("c"))
        .select("o_custkey", "o_orderdate", "o_totalprice", "c.*")
        .filter(day <= F.col("ts") + F.make_dt_interval(F.lit(LABEL_DAYS)))
    )
    later = day > F.col("ts")
    return (
        rows.groupBy("split", F.col("ts").alias("seed_time"), F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.count(F.when(later, 1)).alias("n_later"),
            F.count(F.when(~later, 1)).alias("n_earlier"),
            F.coalesce(F.sum(F.when(later, F.col("o_totalprice").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("spend"),
        )
        .filter(F.col("n_earlier") > 0)
        .select("split", "seed_time", "c_custkey", (F.col("n_later") == 0).alias("churn"), "spend")
    )


def local_catalog(
    spark: SparkSession,
    sf_dir: str,
    tables: list[str] | None = None,
    tasks: bool = True,
    file_order: bool = False,
) -> Catalog:
    """Rows of tables without a dense key are numbered by a unique key, or, with
    ``file_order``, as they lie in the files, which needs no sort."""

    def order(*keys: str):
        return "file" if file_order else keys

    r = lambda name: read(spark, sf_dir, name)
    found = [
        Table("region", r("region"), pkey="r_regionkey", order="pkey"),
        Table("nation", r("nation"), pkey="n_nationkey", fkeys=(("n_regionkey", "region"),), order="pkey"),
        Table("customer", r("customer"), pkey="c_custkey", fkeys=(("c_nationkey", "nation"),), order="pkey"),
        Table("supplier", r("supplier"), pkey="s_suppkey", fkeys=(("s_nationkey", "nation"),), order="pkey"),
        Table("part", r("part"), pkey="p_partkey", order="pkey"),
        Table(
            "orders", r("orders"), pkey="o_orderkey", fkeys=(("o_custkey", "customer"),), time_col="o_orderdate", order="pkey"
        ),
        Table(
            "lineitem",
            r("lineitem"),
            fkeys=(("l_orderkey", "orders"), ("l_partkey", "part"), ("l_suppkey", "supplier")),
            time_col="l_shipdate",
            order=order(*LINE_KEY),
        ),
        Table("events", r("events"), pkey="event_id", fkeys=(("user_id", "customer"),), time_col="ts", order="pkey"),
        Table("documents", r("documents"), pkey="doc_id", order="pkey"),
        Table("labels", r("labels"), fkeys=(("doc_id", "documents"),), order=order("doc_id")),
        Table("conversations", r("conversations"), order=order("conv_id", "turn")),
        Table("pages", r("pages"), pkey="page_id", order="pkey"),
        Table("benchmark", r("benchmark"), pkey="item_id", order="pkey"),
    ]
    if tables is not None:
        found = [t for t in found if t.name in tables]
    if tasks:
        # Task tables are given data: written once, like the tables beside them.
        labelled = stage(task_customer(r("orders")), "task_customer")
        for split in ("train", "val", "test"):
            mine = stage(labelled.filter(F.col("split") == split).drop("split"), split)
            for task, target in (("customer-churn", "churn"), ("customer-spend", "spend")):
                found.append(
                    Table(
                        task,
                        mine.select("seed_time", "c_custkey", target),
                        split=split,
                        fkeys=(("c_custkey", "customer"),),
                        time_col="seed_time",
                        order=order("seed_time", "c_custkey"),
                    )
                )
    return Catalog.of(found, "local")
