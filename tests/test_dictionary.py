import hashlib

from pyspark.sql import functions as F

from rowloom.operators import dictionary as D
from rowloom.session import stage


def same(a, b):
    b = b.select(*a.columns)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_hot_texts_meet_no_shuffle(spark):
    texts = spark.range(30_000).select(
        F.col("id").alias("node_id"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise(F.lit("often")).alias("text")
    )
    known = stage(D.build_dictionary(texts.select("text")), "dictionary")
    rows = texts.select("node_id", F.when(F.col("node_id") != 7, F.sha2("text", 256)).alias("h")).select("node_id", F.unhex("h").alias("digest"))
    told = D.encode_texts(rows, known, F.col("node_id"))
    want = texts.filter("node_id <> 7").join(known.select("text", "text_id"), "text").select("node_id", "text_id")
    same(want, told.filter("text_id IS NOT NULL"))
    assert told.filter("text_id IS NULL").select("node_id").collect()[0][0] == 7
    assert told._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 1


def test_texts_are_numbered_where_they_are_written(spark):
    texts = ["b", "a", "", "b", None, "é", "a b", "b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    told = D.build_dictionary(df, spark.createDataFrame([("a",), ("name",)], "text string"))
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    order = sorted({*texts, "name"} - {None}, key=digest)
    want = [(i, t, digest(t), texts.count(t)) for i, t in enumerate(order)]
    assert [(r.text_id, r.text, bytes(r.digest), r.n_uses) for r in told.orderBy("text_id").collect()] == want
    assert D.build_dictionary(df.limit(0)).count() == 0
