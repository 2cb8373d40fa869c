"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words are runs of letters, digits and underscores, or of other marks, as written. Every word has a
random index vector with an entry of +1 and one of -1, and a word's vector is the sum of the index
vectors of the words near it, brought to length one. Words are counted over all documents; for the
``VOCABULARY`` most frequent ones the sums run over all documents too, and their vectors are sent to
the workers. Any other word has the sum over the text at hand, which for the rarest words,
those of one text, is the same. Index vectors of words outside the table are chosen by a hash of
the word among ``HASHED``, so neither counts nor vectors rest on the labelled rows.
A text is the mean of its words' vectors with the mean's length, the share of
different words and the logarithm of the number of words. A network with one hidden layer is
trained in numpy; a temperature fitted on rows held back makes its output a
probability.

Only the fit sees labels, on at most ``rows`` labelled documents; a score depends on
the text alone. A null text counts as empty, and an empty text has a score too.
Equal texts have equal scores. Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import append, give_back, labelled, prepare

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Labelled rows used, words with vectors of their own, index vectors of other words, entries, window.
FIT_ROWS, VOCABULARY, HASHED, WIDTH, NEAR = 4000, 30_000, 4096, 48, 2
HIDDEN, EPOCHS, RATE, DECAY = 24, 400, 0.01, 1e-3
ACCEPT = 0.7
#: Words are pooled so many at a time.
BLOCK = 1 << 14
#: Distinct words a task counts before it passes them on, and tokens whose contexts it sums at once.
COUNTED, SUMMED = 150_000, 1 << 17


class Words:
    """Numbers of words, the vocabulary's first, then those by hash; and their index vectors."""

    def __init__(self, vocabulary: list[str]):
        self.of = {w: i for i, w in enumerate(vocabulary)}
        self.size = len(vocabulary)
        rng = np.random.default_rng(8)
        # Where each index vector is +1 and where -1.
        self.plus, self.minus = np.argsort(rng.random((self.size + HASHED, WIDTH)), axis=1)[:, :2].T.astype(np.int32)

    def ids(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.of.get, words, repeat(-1)), np.int32, len(words))
        size, crc = self.size, zlib.crc32
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = size + crc(words[i].encode()) % HASHED
        return out

    def summed(self, rows: np.ndarray, near: np.ndarray, size: int) -> np.ndarray:
        """For each of ``size`` rows the sum of the index vectors of the words ``near`` it, as one flat array."""
        at, cells = rows * WIDTH, size * WIDTH
        return np.bincount(at + self.plus[near], minlength=cells) - np.bincount(at + self.minus[near], minlength=cells)

    def contexts(self, texts: list[np.ndarray]) -> np.ndarray:
        """Sums over the texts for the words of the vocabulary, as one flat array."""
        pairs = []
        for step in range(1, NEAR + 1):
            left = np.concatenate([ids[:-step] for ids in texts])
            right = np.concatenate([ids[step:] for ids in texts])
            for a, b in ((left, right), (right, left)):
                known = a < self.size
                pairs.append((a[known], b[known]))
        return self.summed(*[np.concatenate(x) for x in zip(*pairs)], self.size)

    def local(self, words: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one text: where words outside the vocabulary stand, and their vectors from the text itself."""
        at = np.flatnonzero(ids >= self.size)
        number: dict[str, int] = {}
        which = np.array([number.setdefault(words[i], len(number)) for i in at.tolist()], np.int64)
        near = at[:, None] + np.array([*range(-NEAR, 0), *range(1, NEAR + 1)])
        inside = (near >= 0) & (near < len(ids))
        owner = np.broadcast_to(which[:, None], near.shape)[inside]
        sums = self.summed(owner, ids[near[inside]], len(number))
        return at, unit(sums.reshape(-1, WIDTH).astype(float))[which]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


@dataclass
class Network:
    words: Words
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    temperature: float

    def pooled(self, text: str) -> np.ndarray:
        words = TOKEN.findall(text)
        out = np.zeros(WIDTH + 3)
        if words:
            ids = self.words.ids(words)
            known = ids[ids < self.words.size]
            for at in range(0, len(known), BLOCK):
                out[:WIDTH] += self.vectors[known[at : at + BLOCK]].sum(0)
            if len(known) < len(ids):
                out[:WIDTH] += self.words.local(words, ids)[1].sum(0)
            out[:WIDTH] /= len(ids)
            out[WIDTH] = np.linalg.norm(out[:WIDTH])
            out[WIDTH + 1] = len(set(words)) / len(words)
            out[WIDTH + 2] = np.log1p(len(words))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), 0.5)
        a, b, c, d = self.layers
        z = np.tanh((x - self.mean) / self.scale @ a + b) @ c + d
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -40, 40)))


def _train(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Adam over all rows, with decay of the weights."""
    rng = np.random.default_rng(4)
    p = [
        rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1),
    ]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(x @ p[0] + p[1])
        e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y) / len(y)
        back = np.outer(e, p[2]) * (1 - h * h)
        grads = [x.T @ back + DECAY * p[0] / 10, back.sum(0), h.T @ e + DECAY * p[2] / 10, np.array([e.sum()])]
        for q, g, a, b in zip(p, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the log odds with the least loss on rows held back."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
    y = np.clip(y, 0.01, 0.99)

    def loss(t: float) -> float:
        u = np.clip(z / t, -40, 40)
        return float(np.mean(np.logaddexp(0, u) - y * u))

    return float(min(grid, key=loss))


def word_vectors(docs: DataFrame, text: str = "text", vocabulary: int = VOCABULARY) -> tuple[Words, np.ndarray]:
    """The ``vocabulary`` most frequent words of all documents, and their vectors from all documents.

    Whole numbers are summed, so any order gives the same vectors; what reaches the driver is
    bounded by ``vocabulary``.
    """
    spark = docs.sparkSession
    prepare(spark)

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                counts.update(TOKEN.findall(x or ""))
            if len(counts) > COUNTED:
                yield emit(counts)
                counts = Counter()
        if counts:
            yield emit(counts)
        counts = batch = None
        give_back()

    counted = docs.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = Words([r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(vocabulary).collect()])
    sent = spark.sparkContext.broadcast(words)
    entries = [f"c{i}" for i in range(WIDTH)]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        sums, texts, held = np.zeros(known.size * WIDTH, np.int64), [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                texts.append(known.ids(TOKEN.findall(x or "")))
                held += len(texts[-1])
                if held > SUMMED:
                    sums += known.contexts(texts)
                    texts, held = [], 0
        if texts:
            sums += known.contexts(texts)
        if sums.any():
            sums = sums.reshape(-1, WIDTH)
            seen = np.flatnonzero(sums.any(1))
            for at in range(0, len(seen), BLOCK):
                ids = seen[at : at + BLOCK]
                columns = [pa.array(ids, pa.int32()), *[pa.array(c) for c in np.ascontiguousarray(sums[ids].T)]]
                yield pa.RecordBatch.from_arrays(columns, ["id", *entries])
        sums = texts = batch = None
        give_back()

    partial = docs.select(text).mapInArrow(near, "id int, " + ", ".join(f"{c} bigint" for c in entries))
    total = partial.groupBy("id").agg(*[F.sum(c).cast("double").cast("float").alias(c) for c in entries]).toArrow()
    sent.destroy()
    vectors = np.zeros((words.size, WIDTH), np.float32)
    ids = total["id"].to_numpy()
    for i, c in enumerate(entries):
        vectors[ids, i] = total[c].to_numpy()
    return words, unit(vectors).astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, allowed: Column | None = None, rows: int = FIT_ROWS, vocabulary: int = VOCABULARY
) -> Network:
    """Word vectors from all documents, and a network from at most ``rows`` labelled ones that ``allowed`` lets in."""
    spark = docs.sparkSession
    sample = labelled(docs, labels, rows, allowed)
    words, vectors = word_vectors(docs, "text", vocabulary)
    network = Network(words, vectors, np.zeros(WIDTH + 3), np.ones(WIDTH + 3), None, 1.0)
    held = spark.sparkContext.broadcast(network)

    def make():
        net = held.value
        return lambda texts: [[net.pooled(x or "").tobytes() for x in texts.to_pylist()]]

    table = append(sample, make, ["text"], "x binary").select("x", "y").toArrow()
    held.destroy()
    x = np.frombuffer(b"".join(table["x"].to_pylist())).reshape(-1, WIDTH + 3)
    y = table["y"].to_numpy().astype(float) if table.num_rows else np.zeros(0)
    order = np.lexsort([*x.T, y]) if len(y) else np.zeros(0, int)
    x, y = x[order], y[order]
    if len(set(y.tolist())) < 2:
        return network
    aside = np.arange(len(y)) % 5 == 0
    if min(len(set(y[aside].tolist())), len(set(y[~aside].tolist()))) < 2:
        aside = np.zeros(len(y), bool)
    network.mean, network.scale = x[~aside].mean(0), x[~aside].std(0) + 1e-6
    network.layers = _train((x[~aside] - network.mean) / network.scale, y[~aside])
    if aside.any():
        p = np.clip(network.scores(x[aside]), 1e-12, 1 - 1e-12)
        network.temperature = _temperature(np.log(p / (1 - p)), y[aside])
    return network


def score(docs: DataFrame, network: Network, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """Adds ``score`` and ``predicted``, 1 where the score reaches ``accept``."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        net = sent.value

        def work(texts):
            x = np.array([net.pooled(t or "") for t in texts.to_pylist()])
            s = net.scores(x)
            return [s.tolist(), (s >= accept).astype(int).tolist()]

        return work

    return append(docs, make, [text], "score double, predicted int")
