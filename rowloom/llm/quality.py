"""Quality: a linear-chain conditional random field over the lines of a document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowloom.llm.common import labelled_rows, small_batches, text_bytes

#: Labelled documents of each class that the model is fitted on at most.
TRAIN_ROWS = 2000
#: A line of more words than this is labelled in parts of this many, so that one very long line is no single vote.
LINE_WORDS = 64
STEPS, RIDGE = 150, 1e-3
#: Rounds in which the line labels of bad documents are guessed anew from the field itself.
ROUNDS = 3
#: Scores are moved so that this value separates the classes best.
THRESHOLD = 0.3

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
STOPS = b".,;:?'\"-()"
SPACES = b" \t\n\x0b\x0c\r"
SIGNS = bytes(c for c in range(33, 127) if c not in UPPER + LOWER + DIGITS + STOPS)

#: Marks of a line: shares of its bytes and words, all in 0..1.
MARKS = ("upper", "signs", "digits", "stops", "sign_words", "repeated", "same_next", "distinct", "bars", "short", "seen", "long_words")
#: For each line: its marks, those of the neighbouring lines, whether it is first or last, and one.
WIDTH = 3 * len(MARKS) + 3


def parts(text: bytes) -> list[list[bytes]]:
    """Words of each line; long lines in parts, blank lines left out."""
    out = []
    for line in text.split(b"\n"):
        words = line.split()
        if len(words) <= LINE_WORDS:
            if words:
                out.append(words)
        else:
            out.extend(words[i : i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS))
    return out


def marks(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Marks of each line and its length in bytes."""
    seen: set[bytes] = set()
    rows = np.zeros((len(lines), len(MARKS)))
    lengths = np.zeros(len(lines))
    for k, words in enumerate(lines):
        line = b" ".join(words)
        n, m = len(line), len(words)
        lengths[k] = n
        left = m - 1 + (m == 1)
        signs = n - len(line.translate(None, SIGNS))
        rows[k] = (
            (n - len(line.translate(None, UPPER))) / n,
            signs / n,
            (n - len(line.translate(None, DIGITS))) / n,
            (n - len(line.translate(None, STOPS))) / n,
            sum(w[-1] in SIGNS for w in words) / m if signs else 0.0,
            max(Counter(words).values()) / m if m > 3 else 0.0,
            sum(map(bytes.__eq__, words, words[1:])) / left,
            len(set(words)) / m,
            line.count(b"|") / m,
            1 / m,
            line in seen,
            min(1.0, n / m / 20),
        )
        seen.add(line)
    return rows, lengths


def with_neighbours(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), WIDTH))
    k = len(MARKS)
    out[:, :k] = rows
    out[1:, k : 2 * k] = rows[:-1]
    out[:-1, 2 * k : 3 * k] = rows[1:]
    if len(rows):
        out[0, -3] = out[-1, -2] = 1
    out[:, -1] = 1
    return out


@dataclass
class LineField:
    """Two labels, 0 bad and 1 good. ``weights`` @ features is the score of good over bad; ``pairs`` scores neighbouring labels."""

    weights: np.ndarray
    pairs: np.ndarray
    shift: float = 0.0

    def marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Forward-backward: probability of good per line, of each label pair per step, and the log normaliser."""
        n = len(x)
        up = np.zeros((n, 2))
        up[:, 1] = x @ self.weights
        t00, t01, t10, t11 = self.pairs.ravel().tolist()
        fore, back = np.zeros((n, 2)), np.zeros((n, 2))
        a, b = 0.0, float(up[0, 1])
        fore[0] = a, b
        good = up[:, 1].tolist()
        for i in range(1, n):
            a, b = _add(a + t00, b + t10), good[i] + _add(a + t01, b + t11)
            fore[i] = a, b
        c, d = 0.0, 0.0
        for i in range(n - 2, -1, -1):
            e = good[i + 1] + d
            c, d = _add(t00 + c, t01 + e), _add(t10 + c, t11 + e)
            back[i] = c, d
        total = _add(a, b)
        p = np.exp(np.minimum(fore[:, 1] + back[:, 1] - total, 0))
        joint = np.exp(fore[:-1, :, None] + self.pairs[None] + (up + back)[1:, None, :] - total)
        return p, joint, total

    def document(self, x: np.ndarray, lengths: np.ndarray) -> float:
        """Share of the text, by length, in good lines; a text without lines is good."""
        return float(self.marginals(x)[0] @ lengths / lengths.sum()) if len(x) else 1.0

    def score(self, share: np.ndarray) -> np.ndarray:
        """The share moved on the logistic scale, so that ``THRESHOLD`` separates the classes."""
        s = np.clip(share, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(np.log(s / (1 - s)) + self.shift)))


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b)) of two floats."""
    top, low = (a, b) if a > b else (b, a)
    return top + np.log1p(np.exp(low - top)) if low - top > -40 else top


def fit(texts: list[bytes], good: list[int]) -> LineField:
    """Conditional maximum likelihood by gradient steps with adaptive scales (Adam), in rounds.

    At first every line has its document's label. Then the lines of a bad
    document that the field holds good with their neighbours keep that label, as long as most of the text
    stays bad.
    """
    docs = [(with_neighbours(m), lengths) for m, lengths in (marks(parts(t)) for t in texts)]
    used = [i for i, (x, _) in enumerate(docs) if len(x)]
    field = LineField(np.zeros(WIDTH), np.zeros((2, 2)))
    if not used or len({good[i] for i in used}) < 2:
        field.weights[-1] = 3.0 if not used or good[used[0]] else -3.0
        return field
    labels = {i: np.full(len(docs[i][0]), int(good[i])) for i in used}
    for turn in range(ROUNDS):
        _climb(field, [(docs[i][0], labels[i], 1 / len(docs[i][0]) ** 0.5) for i in used])
        if turn + 1 < ROUNDS:
            for i in used:
                if not good[i]:
                    p = field.marginals(docs[i][0])[0]
                    guess = (p > 0.5).astype(int)
                    if guess @ docs[i][1] < 0.5 * docs[i][1].sum():
                        labels[i] = guess
    share = np.array([field.document(*docs[i]) for i in used])
    logit = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
    truth = np.array([good[i] for i in used], bool)
    cuts = np.linspace(-6, 6, 121)
    # Halfway through the cuts with the fewest errors, good documents counting double: they must not be lost.
    errors = np.array([2 * np.mean(logit[truth] < c) + np.mean(logit[~truth] >= c) for c in cuts])
    best = cuts[errors <= errors.min() + 1e-9]
    field.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - best[len(best) // 2])
    return field


def _climb(field: LineField, docs: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
    """Gradient steps with adaptive scales (Adam) over mini-batches of documents."""
    rng = np.random.default_rng(7)
    theta = np.r_[field.weights, field.pairs.ravel()]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        grad = RIDGE * theta
        own = rng.choice(len(docs), min(64, len(docs)), replace=False)
        for i in own:
            x, y, weight = docs[i]
            p, joint, _ = field.marginals(x)
            scale = weight / len(own)
            grad[:WIDTH] += scale * (x.T @ (p - y))
            told = np.zeros((2, 2))
            np.add.at(told, (y[:-1], y[1:]), 1)
            grad[WIDTH:] += scale * (joint.sum(0) - told).ravel()
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        rate = 0.3 * (1 - step / (STEPS + 1))
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        field.weights, field.pairs = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> LineField:
    """Fit on at most ``rows`` documents of each class outside the held-out fifth, chosen by a hash of the id."""
    texts, good = [], []
    for label in (0, 1):
        chosen = labelled_rows(docs, labels, "quality", label, rows).toArrow()
        # In one order, however the rows arrive.
        texts += sorted(chosen["text"].to_pylist())
        good += [label] * chosen.num_rows
    return fit(texts, good)


SCORED = "doc_id long, score double, predicted int"


def score(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id, score, predicted - one row per row of ``docs``, from all lines of its text.

    score is the share of the text in good lines, moved so that ``THRESHOLD``
    separates the classes; predicted is 1 from there on. Texts that are null, empty or all white
    space have no bad line and score like an all-good one.
    """
    small_batches(docs.sparkSession)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = []
            for text in batch.column(1).to_pylist():
                rows, lengths = marks(parts(text))
                shares.append(field.document(with_neighbours(rows), lengths))
            p = field.score(np.array(shares, float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(tell, SCORED)
