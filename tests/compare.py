"""Run registered queries beside their SQL: python tests/compare.py <sf_dir> [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c].dtype) or set(map(type, df[c].dropna().head(50))) == {bool}:
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(bool(v)))
        elif pd.api.types.is_numeric_dtype(df[c].dtype):
            df[c] = df[c].astype("float64")
        else:
            numeric = pd.to_numeric(df[c], errors="coerce") if len(df) and not isinstance(df[c].dropna().head(1).squeeze(), str) else None
            if numeric is not None and numeric.notna().sum() == df[c].notna().sum():
                df[c] = numeric.astype("float64")
            else:
                df[c] = df[c].astype("object").where(df[c].notna(), None).map(lambda v: v if v is None else str(v))
    return df.sort_values(list(df.columns), kind="stable", na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"column {c}: {int((~same).sum())} differ, e.g. {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            t1 = time.time()
            found = difference(got, con.sql(sqls[name]).df()) if name in sqls else "rows only"
        except Exception as e:  # noqa: BLE001
            t1 = time.time()
            got, found = [], f"{type(e).__name__}: {str(e)[:600]}"
        bad += found not in (None, "rows only")
        print(f"{name}: {len(got)} rows, spark {t1 - t0:.1f}s, sql {time.time() - t1:.1f}s: {found or 'same'}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
