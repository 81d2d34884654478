"""Surfaces for user models: text embedders and batch scorers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

Embedder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[pd.DataFrame], pd.DataFrame]


class HashedWords:
    """The default embedder: words hashed into ``dim`` counts, scaled to unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        known: dict[str, int] = {}
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in text.split(" "):
                at = known.get(word)
                if at is None:
                    at = known[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
                out[row, at] += 1.0
        norms = np.linalg.norm(out.astype(np.float64), axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).astype(np.float32)


def embed_texts(
    text_dict: DataFrame, make_embedder: Callable[[], Embedder] = HashedWords, batch_size: int = 8192
) -> DataFrame:
    """A vector per text id. The embedder is made once per task and fed whole texts in batches."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make_embedder()
        for texts in batches:
            parts = [
                embedder(texts.iloc[i : i + batch_size].tolist()) for i in range(0, len(texts), batch_size)
            ]
            yield pd.Series([v for part in parts for v in np.asarray(part, dtype=np.float32)])

    return text_dict.select("text_id", embed("text").alias("vec"))


class MeanNumber:
    """The default scorer: the mean of the visible numbers of a context."""

    reads = ("sem_types", "masks", "is_padding", "number_values")

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        sizes = batch["sem_types"].map(len).to_numpy(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        sem, hidden, padding, values = (np.concatenate([*batch[c], []]) for c in self.reads)
        seen = (sem == 0) & ~hidden.astype(bool) & ~padding.astype(bool)
        total = np.bincount(row[seen], weights=values[seen].astype(np.float64), minlength=len(sizes))
        n = np.bincount(row[seen], minlength=len(sizes))
        return pd.DataFrame({"task_no": batch["task_no"], "seed_id": batch["seed_id"], "yhat": total / np.maximum(n, 1)})


def score_batches(batches: DataFrame, make_scorer: Callable[[], Scorer] = MeanNumber) -> DataFrame:
    """One prediction per batch row that is not a repeat: (task_no, seed_id, yhat).

    A scorer that names the columns it ``reads`` is handed those and the keys alone; others get the whole batch.
    """
    own = batches.filter("NOT is_wrapped")
    reads = getattr(make_scorer, "reads", None)
    if reads is not None:
        own = own.select("task_no", "seed_id", *reads)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            yield scorer(frame)

    return own.mapInPandas(run, "task_no int, seed_id bigint, yhat double")
