"""The registered queries of the operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from rowloom.llm import (
    exact_dedup,
    grammar_ids,
    language_id,
    mixing,
    near_dedup,
    packing,
    prefix_trie,
    quality,
    spotsigs,
    sql,
    suffix_tree,
    toxicity,
    url_filter,
    whitening,
)
from rowloom.llm.common import read_table, remainder
from rowloom.session import stage


def held_out(rest: int) -> Column:
    return (remainder() == rest).alias("held_out")


def token_pieces(docs: DataFrame) -> DataFrame:
    """Pieces by the public byte-level vocabulary."""
    from public_tokenizers import path

    return packing.token_pieces(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(stage(token_pieces(read_table(spark, sf_dir, "documents")), "pieces"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out(0), "score", "predicted")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    field = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, field).select("doc_id", held_out(0), "score", "predicted")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(read_table(spark, sf_dir, "documents"), windows=True)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    told = suffix_tree.score(docs, remainder() != 1)
    return told.select("doc_id", held_out(1), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("source")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    told = language_id.predict(docs, language_id.train(docs))
    return told.select("doc_id", held_out(0), "lang_pred", "score", "rejected")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    docs = read_table(spark, sf_dir, "documents")
    return grammar_ids.read_documents(stage(grammar_ids.shards(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")), "token_ids"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_dedup, op2_best_fit_packing, op3_toxicity, op4_exact_dedup, op5_quality, op6_fingerprints, op7_lm_scoring, op8_mixing, op9_language_id, op10_url_filter, op11_whitening, op12_prefix_trie, op13_token_ids)
}

SQL: dict[str, str] = {"op4_exact_dedup": sql.EXACT_DEDUP, "op10_url_filter": sql.url_filter(), "op12_prefix_trie": sql.PREFIX_TRIE}
