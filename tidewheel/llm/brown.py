"""Class-based bigram scores in Brown's form, with classes found by exchange.

The probability of a word after another is that of its class after the other's
context, times that of the word in its class. Every word has a class of its own choice, found by
exchange: the class that raises the likelihood most, given what stands before the word.

The number of classes grows with the fourth root of the number of words. The exchange starts with the
``words`` most frequent words, and all others pooled by a hash of their last three bytes:
bigrams of these types are counted, and types move one after the other until a sweep moves none or
``sweeps`` are done. Its classes are the contexts. Then, in Spark, all other words choose: a table has each
word's counts after each context; in a round, every second word takes the class that is best for
its own counts under the classes' present probabilities, if it gains more than naming a class costs (words seen
once would else follow chance); the counts of contexts and classes are summed
anew, and rounds go on while they raise the likelihood, ``ROUNDS`` at most. A pool's class is thus only where its words begin,
and what stands for a less frequent word as a context.

Emissions are add-one over all training words, each class having one unknown
word, chosen by ending; transitions are smoothed towards the classes' shares of the text. So the
probabilities of all words after any word sum to one.

Scores need the count and class of every word. Those of the ``held`` most frequent words are sent
to the workers; the rest of a text's words are joined with the table.

Tokens are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case and one end per text. A
null or empty text is one end. A null key counts as the text ``''`` when rows are
dealt to training. Equal rows get equal scores. With no training text the
classes are equal and scores remain finite. Columns but key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import append, prepare, saved

#: A line feed is no word, so it can stand for the end.
END = b"\n"
WORDS, POOLS, SWEEPS, ROUNDS = 1500, 279, 6, 2
#: Classes: so many times the fourth root of the number of words, and not more than there are types.
BREADTH = 8
#: What leaving its pool's class must gain a word, in logarithms of the number of classes.
COST = 2.0
HELD = 150_000
#: Weight of the classes' shares in the transitions, in tokens.
SMOOTHING = 20.0
#: Bytes of text whose words a task counts together, rows of the table taken at once, and words that choose at once.
TOGETHER, ROWS, CHOSEN = 16 << 20, 1 << 15, 512

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_SPACE = (_BYTES == 0x20) | (_BYTES >= 0x09) & (_BYTES <= 0x0D)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


class Words:
    """The tokens of texts: ``distinct`` words, the end first; each token's ``place`` among them; each text's ``sizes``."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.binary()).fill_null(b"")
        _, at, data = texts.buffers()
        cuts = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data or b"", np.uint8)[cuts[0] : cuts[-1]]
        cuts -= cuts[0]
        word = ~_SPACE[data]
        # A word begins and ends beside white space or at an edge of its text.
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts] = True
        edge[0] = edge[-1] = True
        begins = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
        stops = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]])))
        offsets = np.zeros(len(begins) + 1, np.int32)
        np.cumsum(stops - begins + 1, out=offsets[1:])
        listed = pa.Array.from_buffers(
            pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[word]])]
        ).dictionary_encode()
        self.distinct = pa.concat_arrays([pa.array([END], pa.binary()), listed.dictionary])
        self.sizes = np.diff(np.searchsorted(begins, cuts)) + 1
        self.place = np.zeros(len(begins) + len(texts), np.int64)
        inner = np.ones(len(self.place), bool)
        inner[np.cumsum(self.sizes) - 1] = False
        self.place[inner] = listed.indices.to_numpy() + 1

    def before(self, values: np.ndarray) -> np.ndarray:
        """The value of the token before each, given one a token; an end stands before each text."""
        return np.concatenate([[0], values[:-1]])


def _words(batches: Iterator[pa.RecordBatch], together: int = TOGETHER) -> Iterator[Words]:
    """The first column's texts, each time batches of at least ``together`` bytes, but for the last."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch.column(0).cast(pa.binary()))
            size += batch.column(0).nbytes
        if size >= together:
            texts, held, size = pa.concat_arrays(held), [], 0
            yield Words(texts)
    if held:
        yield Words(pa.concat_arrays(held))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at least so many, but for the last."""
    held, number = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            number += batch.num_rows
        if number >= rows:
            whole, held, number = pa.concat_batches(held), [], 0
            yield whole
    if held:
        yield pa.concat_batches(held)


def _parts(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns in batches; rows with the count 0 are left out, counts come last."""
    whole = pa.RecordBatch.from_arrays(columns, names)
    whole = whole.filter(pc.greater(whole.column(len(names) - 1), 0))
    for at in range(0, len(whole), 1 << 16):
        yield whole.slice(at, 1 << 16)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` (binary) and ``n`` over all texts, ends included."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _words(batches):
            counts = pa.array(np.bincount(words.place, minlength=len(words.distinct)))
            yield from _parts([words.distinct, counts], ["word", "n"])

    partial = docs.select(text).mapInArrow(run, "word binary, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


class Types:
    """The type of every word: the end is 0, then frequent words, then pools."""

    def __init__(self, frequent: list[bytes], pools: int):
        self.of = {END: 0, **{w: i for i, w in enumerate(frequent, start=1)}}
        self.first_pool, self.pools = len(self.of), pools
        self.number = len(self.of) + pools

    def __call__(self, words: list[bytes] | pa.Array) -> np.ndarray:
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        out = pc.index_in(words, pa.array(self.of, pa.binary())).fill_null(-1).to_numpy().astype(np.int64)
        rest = np.flatnonzero(out < 0)
        out[rest] = self.first_pool + _ending_crc(words.take(pa.array(rest))) % self.pools
        return out


def _ending_crc(words: pa.Array) -> np.ndarray:
    """crc32 of each word's last three bytes, or of as many as it has."""
    words = pa.concat_arrays([words])
    _, at, data = words.buffers()
    ends = np.frombuffer(at, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    sizes, crc = np.diff(ends), np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        has = np.flatnonzero(sizes >= back)
        crc[has] = _CRC[(crc[has] ^ data[ends[1:][has] - back]) & 0xFF] ^ crc[has] >> 8
    return (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64)


def type_bigrams(docs: DataFrame, types: Types, text: str = "text") -> np.ndarray:
    """Counts of neighbouring types over all texts, each text after an end."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(types)
    n = types.number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, sums = sent.value, np.zeros(n * n, np.int64)
        for words in _words(batches):
            seq = kinds(words.distinct)[words.place]
            sums += np.bincount(words.before(seq) * n + seq, minlength=n * n)
        seen = np.flatnonzero(sums)
        for at in range(0, len(seen), 1 << 16):
            part = seen[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array(sums[part], pa.int64())], ["pair", "n"]
            )

    found = docs.select(text).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    # At most the square of the number of types.
    rows = found.toArrow()
    out = np.zeros(n * n)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(n, n)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each type by exchange; type 0, the end, is class 0 by itself."""
    n = len(pairs)
    heavy = np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")
    heavy = heavy[heavy != 0]
    kind = np.zeros(n, np.int64)
    kind[heavy] = 1 + np.arange(len(heavy)) % max(1, classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), kind] = 1
    grid = member.T @ pairs @ member
    known = _xlogx(grid)
    out_of, into = pairs.sum(1), pairs.sum(0)
    for _ in range(sweeps):
        moved = 0
        for t in heavy:
            if not out_of[t] and not into[t]:
                continue
            a, self_pairs = kind[t], pairs[t, t]
            right = np.bincount(kind, pairs[t], classes)
            left = np.bincount(kind, pairs[:, t], classes)
            # Without the type: its row and column leave its class.
            right[a] -= self_pairs
            left[a] -= self_pairs
            grid[a] -= right
            grid[:, a] -= left
            grid[a, a] -= self_pairs
            known[a], known[:, a] = _xlogx(grid[a]), _xlogx(grid[:, a])
            # All classes keep their pairs with the type, wherever it goes.
            rows, cols = grid.sum(1) + left, grid.sum(0) + right
            # Only pairs with classes that stand beside the type change.
            r, l = np.flatnonzero(right), np.flatnonzero(left)
            across = (_xlogx(grid[:, r] + right[r]) - known[:, r]).sum(1)
            down = (_xlogx(grid[l] + left[l, None]) - known[l]).sum(0)
            own = np.diag(grid)
            apart = _xlogx(own + right) + _xlogx(own + left) - 2 * _xlogx(own)
            gain = (
                across + down - apart
                + _xlogx(own + right + left + self_pairs) - _xlogx(own)
                - _xlogx(rows + out_of[t]) + _xlogx(rows)
                - _xlogx(cols + into[t]) + _xlogx(cols)
            )
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            kind[t] = b
            grid[b] += right
            grid[:, b] += left
            grid[b, b] += self_pairs
            known[b], known[:, b] = _xlogx(grid[b]), _xlogx(grid[:, b])
        if not moved:
            break
    return kind


class ClassModel:
    """Contexts of types, log10 transitions from contexts to classes and log10 masses of classes.

    ``steps`` are the models that words chose by, round after round.
    """

    def __init__(self, types: Types, kind: np.ndarray, classes: int):
        self.types, self.kind, self.classes = types, kind, classes
        self.steps: list[np.ndarray] = []
        self.cost = COST * np.log10(classes)

    def settle(self, grid: np.ndarray, mass: np.ndarray) -> float:
        """Take counts of (context, class) and words' masses; gives the log10 likelihood but for what no class changes."""
        mass = mass.astype(float)
        mass[1:] += 1  # each class but the end's has one unknown word
        mass[0] = max(mass[0], 1)
        share = mass / mass.sum()
        self.step = np.log10((grid + SMOOTHING * share) / (grid.sum(1, keepdims=True) + SMOOTHING))
        self.mass = np.log10(mass)
        return float((grid * (self.step - self.mass)).sum())

    def chosen(
        self, pools: np.ndarray, half: np.ndarray, owner: np.ndarray, contexts: np.ndarray, times: np.ndarray
    ) -> np.ndarray:
        """The classes of words, given their pools and counts (owner, context, times): that of the last round in which each chose."""
        out = self.kind[self.types.first_pool + pools]
        # Entries lie word by word.
        sizes, weight = np.bincount(owner, minlength=len(pools)), times.astype(float)
        starts = np.cumsum(sizes) - sizes
        for part in (0, 1):
            rounds = self.steps[part::2]
            rows = np.flatnonzero(half == part)
            if not rounds or not len(rows):
                continue
            size = sizes[rows]
            # Words with one context choose alike if their counts are.
            one = rows[size == 1]
            alike, same = np.unique(times[starts[one]] * self.classes + contexts[starts[one]], return_inverse=True)
            for at in range(0, len(alike), CHOSEN):
                key = alike[at : at + CHOSEN]
                sums = rounds[-1][key % self.classes] * (key // self.classes)[:, None]
                mine = np.flatnonzero((same >= at) & (same < at + CHOSEN))
                out[one[mine]] = self._moved(sums, same[mine] - at, out[one[mine]])
            more = rows[size > 1]
            more = more[np.argsort(-sizes[more], kind="stable")]
            for at in range(0, len(more), CHOSEN):
                mine = more[at : at + CHOSEN]
                sums = np.zeros((len(mine), self.classes))
                # Entries are added in their order: first those of all words, then the second ones, and so on.
                for k in range(sizes[mine[0]]):
                    entry = starts[mine[: np.searchsorted(-sizes[mine], -k)]] + k
                    sums[: len(entry)] += rounds[-1][contexts[entry]] * weight[entry, None]
                out[mine] = self._moved(sums, np.arange(len(mine)), out[mine])
        return out

    def _moved(self, sums: np.ndarray, row: np.ndarray, old: np.ndarray) -> np.ndarray:
        """The best class by a word's row of sums if it gains more than it costs, else the old one."""
        sums[:, 0] = -np.inf
        best = np.argmax(sums, axis=1)[row]
        return np.where(sums[row, best] > sums[row, old] + self.cost, best, old)


def _listed(words: pa.Array, pairs: np.ndarray, n: np.ndarray, classes: int) -> Iterator[pa.RecordBatch]:
    """A row for each word with its contexts and their counts, from pairs of a word's place and a context."""
    found, at = np.unique(pairs // classes, return_index=True)
    offsets = pa.array(np.append(at, len(pairs)), pa.int32())
    whole = pa.RecordBatch.from_arrays(
        [
            words.take(pa.array(found)),
            pa.ListArray.from_arrays(offsets, pa.array(pairs % classes, pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64())),
        ],
        ["word", "contexts", "times"],
    )
    for at in range(0, len(whole), 1 << 14):
        yield whole.slice(at, 1 << 14)


def context_counts(
    docs: DataFrame, model: ClassModel, text: str = "text", together: int = TOGETHER, rows: int = ROWS
) -> DataFrame:
    """``word``, ``pool``, ``half`` (of the words, by hash), ``contexts`` and ``times`` of all words in pools.

    Contexts and times say how often a word stands after each context.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    c = model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        types = model.types
        for words in _words(batches, together):
            seq = types(words.distinct)
            before = words.before(model.kind[seq][words.place])
            pooled = (seq >= types.first_pool)[words.place]
            pairs, n = np.unique(words.place[pooled] * c + before[pooled], return_counts=True)
            yield from _listed(words.distinct, pairs, n, c)

    def add_up(part: pa.RecordBatch, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        distinct = part.column(0).take(pa.array(np.flatnonzero(np.diff(codes, prepend=-1))))
        owner = np.repeat(codes, np.diff(part.column(1).offsets.to_numpy()))
        pairs, same = np.unique(owner * c + part.column(1).flatten().to_numpy(), return_inverse=True)
        n = np.bincount(same, part.column(2).flatten().to_numpy()).astype(np.int64)
        yield from _listed(distinct, pairs, n, c)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for part in _gathered(batches, rows):
            part = part if rest is None else pa.concat_batches([rest, part])
            # Rows lie by word, and the last word may go on.
            codes = part.column(0).dictionary_encode().indices.to_numpy().astype(np.int64)
            last = int(np.searchsorted(codes, codes[-1]))
            if last:
                yield from add_up(part.slice(0, last), codes[:last])
            rest = part.slice(last)
        if rest is not None:
            yield from add_up(rest, np.zeros(len(rest), np.int64))

    # One row of a task's texts for each of their words, so that a word's rows are few.
    schema = "word binary, contexts array<int>, times array<bigint>"
    partial = docs.select(text).mapInArrow(run, schema)
    listed = partial.repartition("word").sortWithinPartitions("word").mapInArrow(merge, schema)
    return listed.select(
        "word", _pool(model.types.pools).alias("pool"), F.crc32("word").bitwiseAND(F.lit(1)).cast("int").alias("half"),
        "contexts", "times",
    )


def _pool(pools: int) -> Column:
    ending = F.when(F.length("word") <= 3, F.col("word")).otherwise(F.expr("substring(word, -3, 3)"))
    return (F.crc32(ending) % pools).cast("int")


def _entries(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
    """Pools, halves, and for each entry its word's place, context and times, from the columns from ``at`` on."""
    pools, half, contexts, times = batch.columns[at : at + 4]
    owner = np.repeat(np.arange(len(pools)), np.diff(contexts.offsets.to_numpy()))
    return [pools.to_numpy(), half.to_numpy(), owner, contexts.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy()]


def class_counts(table: DataFrame, model: ClassModel, half: int) -> np.ndarray:
    """Counts of (context, class) of the words of one half in the classes they choose, then the classes' masses."""
    sent = table.sparkSession.sparkContext.broadcast(model)
    c = model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = sent.value, np.zeros(c * c + c, np.int64)
        for batch in _gathered(batches):
            pools, half, owner, contexts, times = _entries(batch, 0)
            kinds = model.chosen(pools, half, owner, contexts, times)
            sums[: c * c] += np.bincount(contexts * c + kinds[owner], times, c * c).astype(np.int64)
            # One more for each word: emissions are add-one.
            sums[c * c :] += np.bincount(kinds[owner], times, c).astype(np.int64) + np.bincount(kinds, minlength=c)
        seen = np.flatnonzero(sums)
        for at in range(0, len(seen), 1 << 16):
            part = seen[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(sums[part], pa.int64())], ["at", "n"])

    # At most the square of the number of classes, and that number.
    mine = table.where(F.col("half") == half).drop("word")
    rows = mine.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    out = np.zeros(c * c + c)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def fit(
    counts: DataFrame,
    training: DataFrame,
    text: str = "text",
    words: int = WORDS,
    pools: int = POOLS,
    classes: int | None = None,
    sweeps: int = SWEEPS,
    rounds: int = ROUNDS,
) -> tuple[ClassModel, DataFrame]:
    """The model of ``training``, whose word counts are given, and ``word``, ``n`` and ``kind`` of all its words."""
    of_words = counts.where(F.col("word") != F.lit(bytearray(END)))
    rows = of_words.orderBy(F.desc("n"), "word").limit(words).collect()
    types = Types([bytes(r["word"]) for r in rows], pools)
    if classes is None:
        classes = max(2, min(round(BREADTH * counts.count() ** 0.25), types.number))
    pairs = type_bigrams(training, types, text)
    model = ClassModel(types, exchange(pairs, classes, sweeps), classes)
    # The frequent words and the end stay where the exchange has put them; pools are where words begin.
    own = np.arange(types.number) < types.first_pool
    member = np.zeros((types.number, classes))
    member[np.arange(types.number), model.kind] = 1
    mass = np.array([pairs[:, 0].sum() + 1, *[r["n"] + 1 for r in rows], *[0] * pools], float)
    begun = mass.copy()
    for r in of_words.groupBy(_pool(pools).alias("pool")).agg(F.sum(F.col("n") + 1).alias("mass")).collect():
        begun[types.first_pool + r["pool"]] += r["mass"]
    for r, crc in zip(rows, _ending_crc(pa.array([bytes(r["word"]) for r in rows], pa.binary()))):
        begun[types.first_pool + int(crc) % pools] -= r["n"] + 1
    likelihood = model.settle(member.T @ pairs @ member, begun @ member)
    grid, mass = member.T @ pairs[:, own] @ member[own], mass @ member
    table = saved(context_counts(training, model, text), "brown-contexts")
    # A round changes the counts of the half that chooses; those of the other half stand.
    sums = [None, class_counts(table, model, 1) if rounds else None]
    for r in range(rounds):
        kept = model.step, model.mass
        model.steps.append(model.step - model.mass)
        sums[r % 2] = class_counts(table, model, r % 2)
        more = sum(sums)
        before, likelihood = likelihood, model.settle(
            grid + more[: classes**2].reshape(classes, classes), mass + more[classes**2 :]
        )
        if likelihood <= before:
            model.steps.pop()
            model.step, model.mass = kept
            break
    sent = training.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in _gathered(batches):
            pools, half, owner, contexts, times = _entries(batch, 1)
            n = np.bincount(owner, times, batch.num_rows).astype(np.int64)
            kinds = model.chosen(pools, half, owner, contexts, times)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(kinds, pa.int32())], ["word", "n", "kind"])

    placed = [(bytearray(w), int(n), int(model.kind[i])) for i, (w, n) in enumerate([(END, pairs[:, 0].sum()), *[(bytes(r["word"]), r["n"]) for r in rows]])]
    schema = "word binary, n bigint, kind int"
    first = training.sparkSession.createDataFrame(placed, schema)
    return model, saved(table.mapInArrow(choose, schema).unionByName(first.where("n > 0")), "brown-classes")


def score(
    docs: DataFrame,
    trained: Column,
    key: str = "doc_id",
    text: str = "text",
    held: int = HELD,
    **options,
) -> DataFrame:
    """The key, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``trained`` of every row.

    ``trained`` says of each row whether the model learns from it. ``base_score`` is
    the add-one score of single words, ``score`` the class model's log10 probability.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), trained.alias("_trained"))
    training = rows.where("_trained")
    counts = saved(word_counts(training, "_text"), "brown-words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model, placed = fit(counts, training, "_text", **options)
    top = placed.orderBy(F.desc("n"), "word").limit(held).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(
        (model, top["word"].to_pylist(), top["n"].to_numpy().astype(np.float64), top["kind"].to_numpy())
    )

    def make():
        model, words, n, kinds = sent.value
        at = {w: i for i, w in enumerate(words)}
        # A word's class, and what it is as a context; the last place stands for words that are joined.
        of, context = np.append(kinds, 0), np.append(model.kind[model.types(words)], 0)
        logs = np.append(np.log10(n + 1), 0.0)
        get = at.get

        def work(texts):
            words = Words(texts)
            at_word = np.array([get(w, -1) for w in words.distinct.to_pylist()], np.int64)
            others = np.flatnonzero(at_word < 0)
            as_context = context[at_word]
            as_context[others] = model.kind[model.types(words.distinct.take(pa.array(others)))]
            place, c = words.place, model.classes
            known, before = at_word[place] >= 0, words.before(as_context[place])
            into = of[at_word][place[known]]
            each_log, each_step = logs[at_word][place], model.step[before[known], into] - model.mass[into]
            # Sums of a text are taken over its own stretch, so that equal texts have equal ones.
            ends = np.cumsum(words.sizes)
            met = np.concatenate([[0], np.cumsum(known)])[ends]
            log_sums = [float(x.sum()) for x in np.split(each_log, ends[:-1])]
            step_sums = [float(x.sum()) for x in np.split(each_step, met[:-1])]
            # The words that are joined, with what stands before them, counted for each text.
            text_of = np.repeat(np.arange(len(texts)), words.sizes)[~known]
            rest, times = np.unique((text_of * len(at_word) + place[~known]) * c + before[~known], return_counts=True)
            offsets = pa.array(np.searchsorted(rest // (len(at_word) * c), np.arange(len(texts) + 1)), pa.int32())
            listed = [
                words.distinct.take(pa.array(rest // c % len(at_word))), pa.array(rest % c, pa.int32()), pa.array(times, pa.int64())
            ]
            return [
                pa.array(words.sizes, pa.int64()), pa.array(np.diff(met, prepend=0), pa.int64()), log_sums, step_sums,
                *[pa.ListArray.from_arrays(offsets, x) for x in listed],
            ]

        return work

    per_doc = append(
        rows.withColumn("_hash", F.xxhash64("_text")),
        make,
        ["_text"],
        "n_tokens bigint, _known bigint, _logs double, _chain double, _words array<binary>, _contexts array<int>, _times array<bigint>",
    ).drop("_text")
    per_doc = saved(per_doc, "brown-texts")
    rare = per_doc.select(
        "_key", "_hash", F.posexplode(F.arrays_zip("_words", "_contexts", "_times")).alias("_at", "_one")
    ).select(
        "_key", "_hash", "_at", F.col("_one._words").alias("word"), F.col("_one._contexts").alias("_context"),
        F.col("_one._times").alias("_times"),
    )

    def entering():
        model = sent.value[0]

        def work(words, contexts, kinds):
            into = kinds.fill_null(-1).to_numpy().astype(np.int64)
            unknown = np.flatnonzero(into < 0)
            into[unknown] = model.kind[model.types(words.take(pa.array(unknown)).to_pylist())]
            return [model.step[contexts.to_numpy(), into] - model.mass[into]]

        return work

    # Words are looked up and scored where the table's rows lie.
    met = append(rare.join(placed, "word", "left"), entering, ["word", "_context", "kind"], "_step double")
    # Rows equal in key and text count once each: the sums are divided by their number.
    joined = met.groupBy("_key", "_hash").agg(
        F.sum(F.when(F.col("_at") == 0, 1).otherwise(0)).alias("_copies"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("_times")).otherwise(0)).alias("_more"),
        # Sums of logarithms in whole numbers do not depend on the order of rows.
        F.sum(F.round(F.col("_times") * F.log10(F.coalesce("n", F.lit(0)) + 1) * 1e9).cast("long")).alias("_sum"),
        F.sum(F.round(F.col("_times") * F.col("_step") * 1e9).cast("long")).alias("_steps"),
    )
    joined = joined.select(
        F.col("_key").alias("_k"),
        F.col("_hash").alias("_h"),
        (F.col("_more") / F.col("_copies")).cast("long").alias("_more"),
        (F.col("_sum") / F.col("_copies") / 1e9).alias("_sum"),
        (F.col("_steps") / F.col("_copies") / 1e9).alias("_steps"),
    )
    logs = F.col("_logs") + F.coalesce("_sum", F.lit(0.0))
    scale = F.lit(float(np.log10(float(total + distinct + 1))))
    return per_doc.join(joined, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left").select(
        F.col("_key").alias(key),
        "n_tokens",
        (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * scale).alias("base_score"),
        (logs + F.col("_chain") + F.coalesce("_steps", F.lit(0.0))).alias("score"),
        F.col("_trained").alias("trained"),
    )
