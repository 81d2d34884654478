"""Toxicity: a subsequence string-kernel support vector machine on Nystroem landmarks."""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowloom.llm.common import labelled_rows, small_batches, text_bytes
from rowloom.llm.words import word_rows
from rowloom.session import stage

#: Labelled documents that the model is fitted on at most: toxic ones; clean ones, of which only word counts are
#: gathered; and clean ones that help to calibrate the score.
TOXIC_ROWS, CLEAN_ROWS, CALIBRATION_ROWS = 1500, 6000, 400
#: The kernel counts common subsequences of three characters within SPAN characters, each weighted DECAY**gaps.
SPAN, DECAY = 5, 0.6
GAPS = tuple((i, j) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN))
TABLE_BITS = 20
LANDMARKS = 192
#: Words of clean documents that the machine is trained against.
NEGATIVES = 40_000
#: Rounds in which the words that bear witness against a toxic sentence are chosen anew.
ROUNDS, NEWTON, PENALTY = 4, 20, 1e-5
#: Weight of all positive words against all negative ones.
POSITIVE = 0.1
#: Longest word compared as one; longer ones are compared in overlapping pieces.
LONGEST = 24
#: Steepness of the score around its cut, and the cost of a clean document called toxic against a toxic one missed.
SLOPE, CLEAN_COST = 6.0, 5.0
#: Share of toxic documents set aside to turn margins into scores.
CALIBRATION = 0.2

#: Digits and signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$", "oieastas")


def plain(word: bytes) -> str:
    """Letters of a word, with lookalikes replaced and inserted signs dropped; empty without any letter."""
    text = word.decode("utf-8", "replace").lower()
    if not any(c.isalpha() for c in text):
        return ""
    return "".join(c for c in text.translate(LOOKALIKES) if c.isalpha())


def sentence_words(text: bytes) -> list[bytes]:
    """Words of a text; runs of three or more single characters, as in spelled-out words, are joined.

    The words themselves stay as well.
    """
    words = text.lower().split()
    run: list[bytes] = []
    joined = []
    for at in [i for i, w in enumerate(words) if len(w) == 1 or len(w) == 2 and w[:1].isalpha() and not w[1:].isalnum()] if b" " in text else []:
        if run and at == last + 1:
            run.append(words[at][:1])
        else:
            if len(run) > 2:
                joined.append(b"".join(run))
            run = [words[at][:1]]
        last = at
    if len(run) > 2:
        joined.append(b"".join(run))
    return words + joined


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed gapped subsequences of each word: word number, slot, weight; one entry per distinct pair."""
    marked = [f"<{w}>" if w else "" for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(words)), sizes)
    keys, weights = [], []
    for i, j in GAPS:
        last = len(codes) - j
        if last <= 0:
            continue
        whole = own[:last] == own[j:]
        h = (codes[:last] * np.uint64(0x9E3779B97F4A7C15) + codes[i : last + i]) * np.uint64(0xC2B2AE3D27D4EB4F) + codes[j:]
        h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - TABLE_BITS)
        keys.append((own[:last][whole].astype(np.uint64) << np.uint64(TABLE_BITS)) | h[whole])
        weights.append(np.full(int(whole.sum()), DECAY ** (j - 2)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pairs, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(inverse, weights=np.concatenate(weights))
    return (pairs >> np.uint64(TABLE_BITS)).astype(np.int64), (pairs & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64), weight


def _normed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, slot, weight = features(words)
    norm = np.sqrt(np.bincount(own, weights=weight**2, minlength=len(words)))
    return own, slot, weight / norm[own]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised subsequence kernel of every word with every landmark."""
    l_own, l_slot, l_weight = _normed(landmarks)
    used, at = np.unique(l_slot, return_inverse=True)
    dense = np.zeros((len(used), len(landmarks)), np.float32)
    np.add.at(dense, (at, l_own), l_weight)
    place = np.full(1 << TABLE_BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    own, slot, weight = _normed(words)
    hit = place[slot] >= 0
    own, rows, weight = own[hit], place[slot[hit]], weight[hit]
    if len(own):
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for a in range(0, len(first), 4096):
            b = first[a + 4096] if a + 4096 < len(first) else len(own)
            s = slice(first[a], b)
            out[own[first[a : a + 4096]]] = np.add.reduceat(dense[rows[s]] * weight[s, None], first[a : a + 4096] - first[a], axis=0)
    return out


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode())


def _pieces(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


@dataclass
class ToxicityModel:
    """The machine's decision is linear in the subsequences, so one table of weights holds all landmarks."""

    table: np.ndarray = field(repr=False)
    bias: float = 0.0
    slope: float = 1.0
    offset: float = -4.0
    landmarks: list[str] = field(default_factory=list, repr=False)
    model_id: str = ""

    def margins(self, words: list[bytes]) -> np.ndarray:
        """Decision value of each word; -1 for those without letters."""
        cut = [_pieces(w) for w in map(plain, words)]
        of = np.repeat(np.arange(len(words)), [len(c) for c in cut])
        pieces = [p for c in cut for p in c]
        own, slot, weight = _normed(pieces)
        value = np.bincount(own, weights=self.table[slot] * weight, minlength=len(pieces)) + self.bias
        value[[not p for p in pieces]] = -1.0
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, of, value)
        return out[:, None].astype(np.float32)

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50)))


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on its support vectors."""
    x = np.c_[z, np.ones(len(z))]
    ridge = np.full(x.shape[1], PENALTY * cost.sum())
    ridge[-1] *= 1e-3
    theta = np.zeros(x.shape[1])
    loss = lambda t: 0.5 * ridge @ t**2 + 0.5 * cost @ np.maximum(0, 1 - y * (x @ t)) ** 2
    now = loss(theta)
    for _ in range(NEWTON):
        off = y * (x @ theta) < 1
        own = x[off]
        grad = ridge * theta - own.T @ (cost[off] * y[off] * (1 - y[off] * (own @ theta)))
        step = np.linalg.solve((own * cost[off, None]).T @ own + np.diag(ridge), grad)
        scale = 1.0
        while scale > 1e-4 and (tried := loss(theta - scale * step)) > now:
            scale /= 2
        if scale <= 1e-4 or now - tried < 1e-7 * now:
            break
        theta, now = theta - scale * step, tried
    return theta[:-1], float(theta[-1])


def distinct_pieces(words: list[bytes]) -> list[str]:
    return sorted({p for w in words for p in _pieces(plain(w)) if p})


def fit(toxic: list[list[bytes]], in_good: dict[str, int], n_clean: int, clean: list[list[bytes]], seed: int = 7) -> ToxicityModel:
    """Multiple-instance training: a toxic text holds some toxic sentence, a clean one none.

    toxic, clean: the distinct words of each document; in_good: in how many of ``n_clean`` other clean
    documents each word is. A toxic document is witnessed by its word of the highest decision value
    (at first: the one that the most other toxic and no clean documents have); all words of clean documents are negative.
    """
    rng = np.random.default_rng(seed)
    model = ToxicityModel(np.zeros(1 << TABLE_BITS, np.float32), model_id=f"toxicity:{uuid.uuid4().hex}")
    bad = [d for d in map(distinct_pieces, toxic) if d]
    held_good = [d for d in map(distinct_pieces, clean) if d]
    if not bad or not in_good:
        model.bias = -1.0
        return model
    rng.shuffle(bad)
    n_bad = len(bad) - int(len(bad) * CALIBRATION)
    in_bad = Counter(w for d in bad[:n_bad] for w in d)
    odds = {w: np.log((n + 0.1) / n_bad) - np.log((in_good.get(w, 0) + 0.1) / n_clean) for w, n in in_bad.items()}
    few = min(5, 2 + len(bad) // 100)
    telling = sorted((w for w in odds if odds[w] > 2 and in_bad[w] >= few), key=lambda w: (-odds[w], w))
    often = set(telling)
    witness = {w for d in bad[:n_bad] for w in sorted((w for w in d if w in often), key=lambda w: (-odds[w], w))[:1]} | set(telling[:2000])
    if not witness:  # too few documents for any word to repeat
        witness = {w for d in bad[:n_bad] for w in sorted(d, key=lambda w: (-odds[w], w))[:1]}
    common = sorted(in_good, key=lambda w: (-in_good[w], w))[: LANDMARKS // 4]
    # The commonest words of clean documents, which must not be misjudged, and as many others.
    by_use = sorted(in_good, key=lambda w: (-in_good[w], w))
    negatives = by_use[: NEGATIVES // 2] + sorted(by_use[NEGATIVES // 2 :], key=lambda w: hash_of(w))[: NEGATIVES // 2]
    heavy = 1 + np.log([in_good[w] for w in negatives])
    heads = sorted(witness, key=lambda w: (-odds.get(w, -9), w))
    step = max(1, len(heads) // (LANDMARKS // 2))
    landmarks = list(dict.fromkeys(heads[: LANDMARKS // 4] + heads[LANDMARKS // 4 :: step][: LANDMARKS // 2] + common))
    model.landmarks = landmarks
    k_mm = kernel(landmarks, landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(k_mm + 1e-6 * np.eye(len(landmarks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    z_neg = kernel(negatives, landmarks) @ root
    l_own, l_slot, l_weight = _normed(landmarks)

    def learn(positives: list[str]) -> None:
        z = np.vstack([kernel(positives, landmarks) @ root, z_neg])
        y = np.r_[np.ones(len(positives)), -np.ones(len(z_neg))]
        # Positive words weigh by the documents that have them: words of a few copies say little.
        seen = np.array([in_bad[w] for w in positives], float)
        cost = np.r_[seen / seen.sum() * POSITIVE * heavy.sum(), heavy]
        w, b = _svm(z, y, cost)
        beta = root @ w
        model.table = np.bincount(l_slot, weights=beta[l_own] * l_weight, minlength=1 << TABLE_BITS).astype(np.float32)
        model.bias = float(b)

    def values_of(words: list[str]) -> dict[str, float]:
        return dict(zip(words, model.margins([w.encode() for w in words])[:, 0].tolist()))

    candidates = sorted(in_bad)
    for _ in range(ROUNDS):
        learn(sorted(witness))
        value = values_of(candidates)
        # Words that clean documents have too bear no witness.
        heard = {w for d in bad[:n_bad] for w in sorted((w for w in d if odds[w] > 1), key=lambda w: (-value[w], w))[:1] if w in often or value[w] > 0.5}
        witness = (heard | {w for w in telling if value[w] > 0}) or witness
    held = [max(values_of(d).values()) for d in bad[n_bad:] + held_good]
    truth = np.r_[np.ones(len(bad) - n_bad), np.zeros(len(held_good))]
    if 0 < truth.sum() < len(truth):
        model.slope, model.offset = _calibrated(np.array(held), truth > 0)
    return model


def _calibrated(margin: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic score: 0.5 lies amid the cuts with the fewest errors on documents set aside.

    A clean document that is called toxic counts ``CLEAN_COST`` times.
    """
    cuts = np.linspace(-1.5, 1.5, 301)
    errors = np.array([np.mean(margin[truth] < c) + CLEAN_COST * np.mean(margin[~truth] >= c) for c in cuts])
    best = cuts[errors <= errors.min() + 1e-9]
    return SLOPE, -SLOPE * float(best[len(best) // 2])


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> ToxicityModel:
    """Fit on a bounded number of labelled documents outside the held-out fifth, chosen by a hash of the id."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(sentence_words(t))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], ["words"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct_pieces(sentence_words(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["pieces"])

    def listed(texts: DataFrame) -> list[list[bytes]]:
        # In one order, however the rows arrive.
        return sorted(texts.mapInArrow(words, "words array<binary>").toArrow()["words"].to_pylist())

    small_batches(docs.sparkSession)
    toxic = listed(labelled_rows(docs, labels, "toxic", 1, toxic_rows))
    # No document that the words come from may calibrate: both are parts of one draw.
    drawn = CALIBRATION_ROWS + clean_rows
    calibration = listed(labelled_rows(docs, labels, "toxic", 0, CALIBRATION_ROWS, drawn=drawn))
    clean = stage(labelled_rows(docs, labels, "toxic", 0, clean_rows, CALIBRATION_ROWS, drawn).mapInArrow(pieces, "pieces array<string>"), "clean_words")
    counts = clean.select(F.explode("pieces").alias("word")).groupBy("word").agg(F.count("*").alias("n")).toArrow()
    in_good = dict(zip(counts["word"].to_pylist(), counts["n"].to_pylist()))
    return fit(toxic, in_good, max(1, clean.count()), calibration)


SCORED = "doc_id long, score double, predicted int"


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted - one row per row of ``docs``, from all words of its text.

    A text is as toxic as its worst word in context of the machine: score is the
    calibrated decision value, predicted is 1 from 0.5 on. Null and empty texts have
    the score of a word without letters. Untrained, every score is low.
    """
    small_batches(docs.sparkSession)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = word_rows(model.model_id, model.margins, 1)
        for batch in batches:
            texts = [b" ".join(sentence_words(t)) for t in batch.column(1).to_pylist()]
            at = rows.rows(texts)
            worst = np.array([rows.table[a, 0].max() if len(a) else -1.0 for a in at])
            p = model.score(worst)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(tell, SCORED)
