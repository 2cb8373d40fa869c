"""Quality rules: counts of bad signs, and a logistic regression over hashed n-grams.

The base rules count, per text, its words, their code points, symbols, repeated
lines and words in repeated three-word windows. The regression sees the shares
of hashed character triples (over bytes) and of hashed words and word pairs. It
is fitted on at most ``rows`` labelled documents, calibrated on a part of them
held back, and scores texts in Arrow batches; a text is kept if the
base rules do not fail it and its probability reaches ``KEEP``.

A null text has no words and fails. Texts are judged whole; equal texts get
equal verdicts. Without labels of both kinds every text has probability 1, so
that the base rules alone decide.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tidewheel.llm.common import append, labelled, utf8

SYMBOLS = re.compile(rb"[#*$%&|<>]")
CONTINUATION = re.compile(rb"[\x80-\xbf]+")
#: Fixed thresholds.
LEAST_WORDS, MOST_REPEATED_PERCENT, KEEP = 50, 50, 0.5
#: Labelled rows the regression is fitted on, and hash bins per family of n-grams.
FIT_ROWS, BINS_LOG2 = 4000, 11
BINS = 1 << BINS_LOG2
STEPS, DECAY = 200, 1e-3

_ODD = np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - BINS_LOG2)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    hit = np.zeros(len(words), bool)
    again = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    for i in range(3):
        hit[i : i + len(windows)] |= again
    return int(hit.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated windows."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined) - sum(map(len, CONTINUATION.findall(joined)))
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return (
        len(words), chars, len(SYMBOLS.findall(joined)), len(lines) - len(set(lines)), repeated_words(words),
    )


def char_bins(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] * np.uint32(961) + b[1:-1] * np.uint32(31) + b[2:] + np.uint32(1)) * _ODD) >> _SHIFT


def word_bins(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    pairs = h[:-1] * np.uint32(31) + h[1:]
    return (np.concatenate([h, pairs]) * _ODD) >> _SHIFT


def shares(text: bytes) -> np.ndarray:
    """The text's share of n-grams in every bin, character triples first."""
    out = []
    for bins in (char_bins(text), word_bins(text.split())):
        out.append(np.bincount(bins, minlength=BINS) / max(1, len(bins)))
    return np.concatenate(out).astype(np.float32)


@dataclass
class Regression:
    """Weights of character and word bins, intercept, and the calibration of the log odds."""

    chars: np.ndarray
    words: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, text: bytes, words: list[bytes]) -> float:
        z = self.bias
        for weights, bins in ((self.chars, char_bins(text)), (self.words, word_bins(words))):
            if len(bins):
                z += float(weights[bins].mean())
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40))))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int, decay: float) -> np.ndarray:
    """Weights (the last is the intercept) by accelerated gradient descent with a safe step."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.random.default_rng(1).normal(size=x.shape[1]).astype(x.dtype)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    size = float(np.linalg.norm(x @ v)) ** 2 / len(x) / 4 * 1.2 + decay
    w = look = np.zeros(x.shape[1], x.dtype)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        new = look - (x.T @ (p - y) / len(x) + decay * look) / size
        look = new + k / (k + 3) * (new - w)
        w = new
    return w


def fit_regression(x: np.ndarray, y: np.ndarray) -> Regression | None:
    """None without both labels."""
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(y)) % 4 == 0
    if min(len(set(y[held].tolist())), len(set(y[~held].tolist()))) < 2:
        held = np.zeros(len(y), bool)
    mean, scale = x[~held].mean(0), x[~held].std(0) + 1e-4
    z = (x - mean) / scale
    w = _logistic(z[~held], y[~held].astype(x.dtype), STEPS, DECAY * 10)
    raw = z @ w[:-1] + w[-1]
    use = held if held.any() else ~held
    slope, shift = _platt(raw[use], y[use])
    weights = w[:-1] / scale
    return Regression(
        weights[:BINS].astype(np.float64), weights[BINS:].astype(np.float64),
        float(w[-1] - weights @ mean), slope, shift,
    )


def _platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log odds, with the usual softened targets."""
    raw = raw.astype(np.float64)
    up, down = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    t = np.array([1.0, 0.0])
    x = np.stack([raw, np.ones_like(raw)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -40, 40)))
        grad = x.T @ (p - goal) + 1e-3 * (t - [1, 0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        t = t - step / max(1.0, float(np.abs(step).max()))
    return float(max(t[0], 1e-3)), float(t[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Regression | None:
    """The regression from at most ``rows`` labelled rows; features are made in tasks."""

    def make():
        return lambda texts: [[shares(x).astype(np.float16).tobytes() for x in utf8(texts)]]

    table = append(labelled(docs, labels, rows), make, ["text"], "x binary").select("x", "y").toArrow()
    if not table.num_rows:
        return None
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float16).reshape(-1, 2 * BINS).astype(np.float32)
    y = table["y"].to_numpy()
    # The order of rows depends on tasks; the fit must not.
    order = np.lexsort([*x[:, :8].T, y, x.sum(1)])
    return fit_regression(x[order], y[order])


def judge(docs: DataFrame, model: Regression | None, text: str = "text") -> DataFrame:
    """Adds the counts of the base rules, ``base_failed``, ``probability`` and ``kept``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def work(texts):
            rows = []
            for x in utf8(texts):
                words = x.split()
                counts = base_counts(x)
                p = model.probability(x, words) if model else 1.0
                failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED_PERCENT * counts[0]
                rows.append((*counts, failed, p, not failed and p >= KEEP))
            return [list(c) for c in zip(*rows)]

        return work

    return append(
        docs, make, [text],
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, probability double, kept boolean",
    )
