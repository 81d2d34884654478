"""The pipeline's stages, each beside brute force on what its predecessor kept; and the registered queries."""

from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rowloom.llm import mixing, queries
from rowloom.llm.common import read_table
from test_llm_exact import brute
from test_llm_near import brute_components
from test_llm_packing import check_sequences

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert {f"op{n}_" for n in range(1, 14)} == {q[: q.index("_") + 1] for q in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_as_sql(spark, name):
    from compare import connect, difference

    assert difference(entry.queries()[name](spark, SF).toPandas(), connect(SF).sql(entry.oracle_sql()[name]).df()) is None


def test_columns_with_the_names_of_stages(spark):
    docs = read_table(spark, SF, "documents").limit(60)
    more = docs.selectExpr("*", *[f"'mine' AS {c}" for c in ("copies", "language_text", "mixed_id", "gone", "kept", "kept_id", "nth", "text_2")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns, name
        assert {tuple(r)[5:] for r in out.collect()} == {("mine",) * 8}, name


def test_stages(spark, tmp_path):
    docs, kept = read_table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = [tuple(r) for r in docs.collect()]
        kept.append((name, len(rows)))
        if name != "packing":
            assert docs.columns == COLUMNS and set(rows) <= set(before)
        if name == "language_id":
            # Nothing here lacks letters, and prose of known languages stays.
            assert len(rows) >= 0.99 * len(before)
        if name == "exact_dedup":
            assert sorted(r[0] for r in rows) == sorted(b[0] for b in brute([(r[0], r[1]) for r in before]) if b[3])
        if name == "near_dedup":
            want = brute_components([(r[0], r[1]) for r in before], 80, 100)
            assert sorted(r[0] for r in rows) == sorted(i for i, (_, top) in want.items() if i == top)
        if name == "mixing":
            copies, words = Counter(r[0] for r in rows), {r[0]: len(r[1].encode().split()) for r in before}
            assert max(copies.values()) <= 3
            size, mixed = defaultdict(int), defaultdict(int)
            for r in before:
                size[r[3]] += words[r[0]]
            for r in rows:
                mixed[r[3]] += words[r[0]]
            names = sorted(size)
            target = dict(zip(names, mixing.share_out([size[n] for n in names])))
            # Whole documents: as near as the longest one allows.
            longest = {n: max(words[r[0]] for r in before if r[3] == n) for n in names}
            assert all(abs(mixed[n] - target[n]) <= 3 * longest[n] + 0.3 * target[n] for n in names)
            assert abs(sum(mixed.values()) / sum(target.values()) - 1) < 0.15
        if name == "packing":
            assert Counter(r[0] for r in rows if r[1] == 0) == Counter(b[0] for b in before)
            check_sequences(docs.collect())
    assert all(n for _, n in kept)


def test_stages_of_odd_rows_and_nothing(spark, odd_docs, no_docs, tmp_path):
    for docs, label in ((odd_docs, "odd"), (no_docs, "none")):
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{label}-{name}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() == (0 if label == "none" else docs.filter("length > 0").count())


def test_run(spark):
    packed = corpus_pipeline.run(spark, SF)
    assert packed.columns[:2] == ["doc_id", "piece"] and packed.count() > 0


def test_workers_remember_for_one_operator_at_a_time():
    from public_tokenizers import path

    from rowloom.llm import near_dedup, packing, words

    near_dedup.shingles(b"one two")
    assert near_dedup._HASHES
    words.word_rows("m:1", lambda new: [[1.0]] * len(new), 1).rows([b"one"])
    assert not near_dedup._HASHES and words._ROWS
    chunks = packing.chunk_ids(path("byte_bpe_50k.json"))
    assert not words._ROWS and chunks.ids("one two") and chunks is packing.chunk_ids(path("byte_bpe_50k.json"))
    near_dedup.shingles(b"one two")
    assert not packing._CHUNKS and near_dedup._HASHES
