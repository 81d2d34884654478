"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from rowloom.llm.common import remainder, small_batches, text_bytes
from rowloom.llm.words import word_rows

#: Labelled rows that the model is fitted on, in equal shares of the languages, and words of each, evenly spaced over its text.
TRAIN_ROWS, TRAIN_WORDS = 4000, 300
#: Rows of a language at least, if it has them, however many languages there are.
LEAST_EACH = 40
BUCKETS, DIM = 1 << 15, 16
#: Lengths of subwords; a word is written between marks.
SHORTEST, LONGEST = 2, 4
EPOCHS, RATE, BATCH = 6, 0.5, 32
#: Few rows are gone through more often, for so many steps at least.
LEAST_STEPS = 400
#: Share of fitted rows set aside to calibrate the score and the rejection bound.
CALIBRATION = 0.2
#: The bound rejects this share of correctly labelled rows.
REJECTED = 0.001
MOST_BOUND = 0.4
UNKNOWN = "und"
PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"


def letters(word: bytes) -> str:
    return "".join(c for c in word.decode("utf-8", "replace").lower() if c.isalpha())


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all subwords, and how many each word has; a word without letters has none."""
    marked = [f"<{w}>" if w else "" for w in map(letters, words)]
    sizes = np.array([len(m) for m in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(words)), sizes)
    found, of = [], []
    hashed = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        last = len(codes) - n + 1
        if last <= 0:
            break
        hashed = hashed[:last] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n >= SHORTEST:
            whole = own[:last] == own[n - 1 :]
            mixed = hashed ^ (hashed >> np.uint64(29))
            mixed = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
            found.append((mixed[whole] % np.uint64(BUCKETS)).astype(np.int64))
            of.append(own[:last][whole])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return found[order], np.bincount(of, minlength=len(words))


@dataclass
class LanguageModel:
    languages: list[str]
    embeddings: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    temperature: float = 1.0
    #: Least score that is not rejected.
    bound: float = 0.0
    model_id: str = ""

    def word_logits(self, words: list[bytes]) -> np.ndarray:
        """Per word the sum of its subwords' logits, then their number."""
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        buckets, counts = subwords(words)
        filled = counts > 0
        if filled.any():
            per_bucket = self.embeddings[buckets] @ self.weights
            starts = np.concatenate([[0], np.cumsum(counts[filled])[:-1]])
            out[filled, :-1] = np.add.reduceat(per_bucket, starts, axis=0)
        out[:, -1] = counts
        return out

    def scores(self, sums: np.ndarray) -> np.ndarray:
        """Calibrated probabilities from summed logits and subword counts."""
        logits = sums[:, :-1] / np.maximum(sums[:, -1:], 1) / self.temperature
        logits = logits - logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True)


def _spaced(text: bytes) -> list[bytes]:
    words = text.lower().split()
    if len(words) <= TRAIN_WORDS:
        return words
    return [words[i] for i in np.linspace(0, len(words) - 1, TRAIN_WORDS).astype(int)]


def fit(texts: list[bytes], labels: list[str], seed: int = 7) -> LanguageModel:
    """Mini-batch stochastic gradient descent on the mean subword embedding of each row."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(v) for v in labels], np.int64)
    bags = [subwords(_spaced(t))[0] for t in texts]
    usable = np.array([i for i, b in enumerate(bags) if len(b)], np.int64)
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32)
    model = LanguageModel(languages, embeddings, weights, model_id=f"language:{uuid.uuid4().hex}")
    if not len(usable):
        return model
    rng.shuffle(usable)
    held = usable[: int(len(usable) * CALIBRATION)]
    used = usable[len(held) :]

    def forward(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kinds, counts = np.unique(bags[i], return_counts=True)
        share = (counts / counts.sum()).astype(np.float32)
        return kinds, share, share @ embeddings[kinds]

    seen = [forward(i)[:2] for i in range(len(bags))]
    per_epoch = max(1, -(-len(used) // BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), BATCH):
            own = used[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            means = np.stack([seen[i][1] @ embeddings[seen[i][0]] for i in own])
            logits = means @ weights
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            back = p @ weights.T
            weights -= rate * means.T @ p / len(own)
            for g, i in zip(back, own):
                embeddings[seen[i][0]] -= rate * 4 * seen[i][1][:, None] * g[None, :]
    if len(held):
        logits = np.stack([seen[i][1] @ embeddings[seen[i][0]] for i in held]) @ weights
        truth = y[held]

        def loss(t: float) -> float:
            z = logits / t
            z = z - z.max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]))

        grid = np.exp(np.linspace(np.log(0.02), np.log(20), 80))
        model.temperature = float(grid[np.argmin([loss(t) for t in grid])])
        z = logits / model.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        best = (p / p.sum(1, keepdims=True)).max(1)
        right = logits.argmax(1) == truth
        # Below a coin's toss between two languages: texts that mix two are kept.
        model.bound = float(min(np.quantile(best[right], REJECTED), MOST_BOUND)) if right.any() else 0.0
    return model


def chosen_rows(known: DataFrame, rows: int) -> DataFrame:
    """doc_id, lang of the rows to fit on: of each language as many as make ``rows`` in all, ``LEAST_EACH`` at least, in the order of a hash.

    A rare language is learned from all that it has, in a table of any size. Of each language a share of the hash range that
    holds some four times as many goes into the sort, so that no task gathers a whole language.
    """
    pairs = known.select("doc_id", "lang").distinct()
    sizes = pairs.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(LEAST_EACH, rows // max(1, sizes.count()))
    share = F.least(F.lit(1.0), 4.0 * (each + 25) / F.col("n"))
    near = pairs.join(sizes, "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < share * (1 << 30))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= each).select("doc_id", "lang")


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on labelled documents outside the held-out fifth, about ``rows`` of them in all, drawn per language (``chosen_rows``).

    Only the fitted words of a text reach the driver. Rows that repeat an id and language count once; null and unlabelled texts are left out; of an empty table
    nothing is learned; other columns are not read.
    """
    known = docs.select("doc_id", "lang", "text").filter(remainder() != 0).filter("lang IS NOT NULL AND text IS NOT NULL")
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [b" ".join(_spaced(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *batch.columns[1:]], ["words", "lang", "doc_id"])

    chosen = known.join(chosen_rows(known, rows), ["doc_id", "lang"], "left_semi")
    few = chosen.select(text_bytes().alias("text"), "lang", F.col("doc_id").cast("long")).mapInArrow(cut, "words binary, lang string, doc_id long")
    told = few.groupBy("doc_id", "lang").agg(F.min("words").alias("words")).toArrow()
    # In one order, however the rows arrive.
    pairs = sorted(zip(told["words"].to_pylist(), told["lang"].to_pylist()))
    return fit([t for t, _ in pairs], [v for _, v in pairs])


def _told(model: LanguageModel, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text of a batch."""
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    width = len(model.languages) + 1
    rows = word_rows(model.model_id, model.word_logits, width)
    sums = np.array([rows.table[a].sum(0) if len(a) else np.zeros(width) for a in rows.rows(texts)]).reshape(-1, width)
    known = sums[:, -1] > 0
    p = model.scores(sums)
    score = np.where(known, p.max(1), 0.0)
    return [model.languages[b] if k else UNKNOWN for b, k in zip(p.argmax(1), known)], score, ~known | (score < model.bound)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected - one row per row of ``docs``, from all words of its text.

    score is the calibrated probability of lang_pred. A text that is null or has
    no letter is 'und' with score 0 and rejected; so is every text if no label was there to
    learn from. A score under the model's bound is rejected but keeps its prediction.
    """
    small_batches(docs.sparkSession)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rejected = _told(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"]
            )

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(tell, PREDICTED)


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns as they are, in one pass without a shuffle.

    Without a label to learn from, only texts without a letter are rejected.
    """
    small_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if model.languages:
                rejected = _told(model, texts)[2]
            else:
                rejected = np.array([not letters(t) for t in texts], bool)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(~rejected))

    return docs.select("*", text_bytes().alias("__rowloom_text")).mapInArrow(keep, docs.schema)
