"""Near copies by Order MinHash, verified by banded alignment of words.

A text's shingles are its windows of five words (A-Z in lower case), each
labelled with its occurrence, so that repeats count. A sketch has ``sketches``
keys; each is made of the ``drawn`` shingles with the least hashes under its own hash
function, listed in text order. Two texts agree in a key if they share those
shingles and their order, so the chance grows with their edit similarity.

Sketches miss too much where shingles are few. If the smaller of two texts has at most
``FEW`` words, candidates are exact instead: the keys are a text's rarest words, each labelled
with its occurrence, so many of them that two similar texts always share one (a prefix filter).
Texts above ``FEW`` have sketches, and those that may meet a text on either side have both.

Candidates are verified by alignment of their words: the longest run of words that both have
in order, sought within a band around the diagonal as wide as the similarity allows.
With w words matched the similarity is 2w / (words of both), which edits lower word by word.
Two texts are near copies from ``SIMILAR`` on, if they share five words in a row.

Texts with the same words are one node. In every bucket (the nodes that agree in
a key) each node is compared with the leader, the node that meets most others; the
links found make components. A bucket that then still holds nodes of different
components is compared exactly: it is cut into blocks, and each two blocks are
compared in a task of their own, all pairs of different components. So nodes of one group
are not paired row by row, no bucket is gathered in one task, and none is capped.

A null text counts as empty. Texts of fewer than five words have no five in a row, so they are
near only if equal; texts without words are equal to each other.
Null keys are allowed. Rows are never dropped or merged.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import append, discard, saved, utf8
from tidewheel.llm.components import components

SHINGLE, SIMILAR = 5, 0.8
SKETCHES, DRAWN = 40, 3
#: Pairs whose smaller text has at most so many words are found by exact keys.
FEW = 32
#: Words aligned at once; the band is wider by as many.
STRIDE = 4096
#: Pairs that one copy of a leader's text serves.
PAIRS_PER_COPY = 64
#: Nodes in a block of a bucket, and words counted at once for two blocks.
CELL, COLUMNS = 128, 4096
#: Hash values made at once for a text.
BLOCK = 1 << 21

_RNG = np.random.default_rng(9)
_SEEDS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64)
_ODD = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _hashed(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    h = (h + np.uint64(1)) * _ODD[60]
    return h ^ (h >> _HALF)


def _labelled(marks: np.ndarray) -> np.ndarray:
    """The marks, repeats told apart by their occurrence."""
    n = len(marks)
    order = np.argsort(marks, kind="stable")
    ranked = marks[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if first.all():
        return marks
    place = np.arange(n)
    label = np.empty(n, np.uint64)
    label[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    out = (marks + label * _ODD[61]) * _MIX
    # First occurrences keep their mark, whether or not the text has repeats.
    return np.where(label > 0, out ^ (out >> _HALF), marks)


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the windows of five words, labelled with their occurrence."""
    if not words:
        return np.zeros(0, np.uint64)
    h = _hashed(words)
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(words))):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> _HALF
    return _labelled(out)


def word_marks(words: list[bytes]) -> np.ndarray:
    """Hashes of the words, labelled with their occurrence."""
    return _labelled(_hashed(words)) if words else np.zeros(0, np.uint64)


def sketch(marks: np.ndarray, sketches: int = SKETCHES, drawn: int = DRAWN) -> np.ndarray:
    """The keys of a text from its labelled shingles."""
    n, out = len(marks), np.zeros(sketches, np.uint64)
    if not n:
        return out[:0]
    take = min(drawn, n)
    step = max(1, BLOCK // n)
    for at in range(0, sketches, step):
        rows = slice(at, min(at + step, sketches))
        x = (marks[None, :] ^ _SEEDS[rows, None]) * _ODD[rows, None]
        x ^= x >> _HALF
        least = np.argpartition(x, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(x), 1))
        least.sort(axis=1)
        chosen = marks[least]
        key = _SEEDS[rows] + np.uint64(take)
        for j in range(take):
            key = (key ^ chosen[:, j]) * _MIX
            key ^= key >> _HALF
        out[rows] = key
    return out


def matched(x: list[bytes], y: list[bytes], band: int) -> int:
    """Most words that both lists have in order, matched at most ``band`` places apart (or a little more).

    The row of the alignment is one number with a bit per word of ``y``; a cleared bit is a match won.
    Of a long list the number holds only what the band reaches.
    """
    n, m, ahead, behind = len(x), len(y), 0, 0
    while ahead < min(n, m) and x[ahead] == y[ahead]:
        ahead += 1
    while behind < min(n, m) - ahead and x[n - 1 - behind] == y[m - 1 - behind]:
        behind += 1
    x, y = x[ahead : n - behind], y[ahead : m - behind]
    total, low, high, row = ahead + behind, 0, 0, 0
    for at in range(0, len(x), STRIDE):
        start, end = min(max(0, at - band), len(y)), min(len(y), at + STRIDE + band)
        # Bits that the band has left are settled; those it reaches now are still set.
        gone = start - low
        total += gone - (row & ((1 << gone) - 1)).bit_count()
        row = (row >> gone) | (((1 << (end - high)) - 1) << (high - start))
        low, high = start, end
        full = (1 << (high - low)) - 1
        where: dict[bytes, list[int]] = {}
        for j in range(low, high):
            where.setdefault(y[j], []).append(j - low)
        masks: dict[bytes, int] = {}
        for w in x[at : at + STRIDE]:
            if w in where:
                if w not in masks:
                    masks[w] = sum(1 << j for j in where[w])
                hit = row & masks[w]
                row = ((row + hit) | (row - hit)) & full
    return total + (high - low) - row.bit_count()


def similarity(a: list[bytes], b: list[bytes], least: float = SIMILAR) -> float:
    """Twice the words matched in order, over the words of both; 0 under ``least`` or without five in a row."""
    n, m = len(a), len(b)
    if min(n, m) < SHINGLE:
        return float(a == b)
    needed = least / 2 * (n + m) - 1e-9
    if min(n, m) < needed:
        return 0.0
    if sum((Counter(a) & Counter(b)).values()) < needed:
        return 0.0
    found = matched(a, b, int(n + m - 2 * needed) + 1)
    if found < needed:
        return 0.0
    runs = [zip(*[w[i:] for i in range(SHINGLE)]) for w in (a, b)]
    return 0.0 if set(runs[0]).isdisjoint(runs[1]) else 2 * found / (n + m)


def sketched(
    docs: DataFrame, key: str, text: str, sketches: int, drawn: int, keep: list[str], similar: float = SIMILAR
) -> DataFrame:
    """``_key``, ``node`` (a digest of the words), ``size`` (words), ``keys``, ``marks`` and ``_text``.

    ``keys`` are the sketches of texts above ``FEW`` words; ``marks`` are the labelled words of
    texts that may be similar to one of at most ``FEW``.
    """
    most = FEW * (2 - similar) / similar + 1e-6

    def make():
        def work(texts):
            nodes, sizes, keys, few = [], [], [], []
            for x in utf8(texts):
                words = words_of(x)
                nodes.append(xxhash.xxh3_128_digest(b" ".join(words)))
                none = np.zeros(0, np.uint64)
                sizes.append(len(words))
                keys.append((sketch(shingles(words), sketches, drawn) if len(words) > FEW else none).view(np.int64))
                few.append((word_marks(words) if SHINGLE <= len(words) <= most else none).view(np.int64))
            lists = [
                pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, x)]), pa.int32()),
                    pa.array(np.concatenate(x) if x else [], pa.int64()),
                )
                for x in (keys, few)
            ]
            return [nodes, sizes, *lists]

        return work

    rows = docs.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep]
    )
    return append(rows, make, ["_text"], "node binary, size bigint, keys array<bigint>, marks array<bigint>")


def rarest(nodes: DataFrame, similar: float) -> DataFrame:
    """``node``, ``size`` and ``key``: those of the rarest ``marks`` of a node that other nodes have too.

    Similar texts share ``similar / (2 - similar)`` of each one's words at least, so of all but that many,
    and one more, in any one order of words, they share one. Words of a single node come first in the
    order and need not be listed.
    """
    share = similar / (2 - similar)
    held = nodes.select("node", "size", F.explode("marks").alias("mark"))
    common = held.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1")
    ranked = (
        held.join(common, "mark")
        .groupBy("node", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "mark"))).alias("ranked"))
    )
    single = F.col("size") - F.size("ranked")
    first = F.col("size") - F.ceil(F.col("size") * share - 1e-6) + 1 - single
    return ranked.where(first > 0).select(
        "node", "size", F.explode(F.slice("ranked", F.lit(1), first.cast("int"))["mark"]).alias("key")
    )


def verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose texts are similar, with ``similarity``.

    A text with very many partners is sent in several copies, each for some of them.
    """
    share = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_COPY).cast("int").alias("copies"))
    dealt = pairs.join(share, "a").withColumn("copy", F.pmod(F.xxhash64("b"), "copies").cast("int"))
    led = (
        share.join(texts.select(F.col("node").alias("a"), F.col("_text").alias("text_a")), "a")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .drop("copies")
    )
    both = (
        dealt.join(texts.select(F.col("node").alias("b"), F.col("_text").alias("text_b")), "b")
        .join(led, ["a", "copy"])
        .select("a", "b", "text_a", "text_b")
    )

    def make():
        def work(left, right):
            seen: dict[bytes, list[bytes]] = {}
            out = []
            for x, y in zip(utf8(left), utf8(right)):
                if x not in seen:
                    seen = {x: words_of(x)}
                out.append(similarity(seen[x], words_of(y), similar))
            return [out]

        return work

    return append(both, make, ["text_a", "text_b"], "similarity double").drop("text_a", "text_b").where(
        F.col("similarity") >= similar
    )


def near_links(rows: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Links between nodes, enough to make their components whole; and the components (``node``, ``root``).

    ``rows`` are saved rows of :func:`sketched`.
    """
    nodes = saved(rows.groupBy("node").agg(*[F.min(c).alias(c) for c in ("size", "keys", "marks")]), "nodes")
    sketches = nodes.select("node", "size", F.explode("keys").alias("key"))
    keyed = saved(sketches.unionByName(rarest(nodes, similar)), "keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    bucketed = saved(keyed.join(shared, "key"), "buckets")
    # One text for each node that shares a bucket: rows equal in words are interchangeable. Copies are
    # merged by the tasks that read them, so that no task gets all rows of a frequent text.
    held_keys = bucketed.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    texts = saved(rows.groupBy("node").agg(F.min("_text").alias("_text")).join(held_keys, "node"), "texts")
    # The node that meets most others leads its buckets: an original, say, rather than a copy.
    weight = bucketed.groupBy("node").agg(F.sum("n").alias("weight"))
    led = (
        bucketed.join(weight, "node")
        .groupBy("key")
        .agg(F.max(F.struct("weight", "node", "size")).alias("lead"))
    )
    pairs = saved(
        bucketed.join(led, "key")
        .where("node != lead.node")
        .where(F.least("size", "lead.size") >= similar / (2 - similar) * F.greatest("size", "lead.size") - 1e-6)
        .select(F.col("lead.node").alias("a"), F.col("node").alias("b"))
        .distinct(),
        "pairs",
    )
    first = saved(verified(pairs, texts, similar), "found")
    whole = components(first.select("a", "b"))
    placed = bucketed.join(whole, "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("part")
    )
    mixed = (
        placed.groupBy("key")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
        .where("low < high")
        .select("key", F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
    )
    # A bucket is cut into blocks, and a cell holds two of them, so no cell grows with its bucket.
    cells = (
        placed.join(mixed, "key")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            "block", "node", "part",
        )
        .join(texts, "node")
    )

    def compare(cell: pa.Table) -> pa.Table:
        found = between_parts(cell, similar)
        part = dict(zip(cell["node"].to_pylist(), cell["part"].to_pylist()))
        columns = [*zip(*found)] or [(), (), ()]
        columns += [[part[x] for x in ends] for ends in columns[:2]]
        kinds = (pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary())
        return pa.table(
            [pa.array(x, k) for x, k in zip(columns, kinds)], names=["a", "b", "similarity", "part_a", "part_b"]
        )

    more = saved(
        cells.groupBy("key", "low", "high").applyInArrow(
            compare, "a binary, b binary, similarity double, part_a binary, part_b binary"
        ),
        "more",
    )
    # Only the links and the components are read from here on.
    discard(nodes, keyed, bucketed, texts, pairs)
    if more.isEmpty():
        return first, whole
    # What is new joins whole components, so only their roots are followed further.
    joined = components(more.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))
    moved = whole.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    alone = joined.join(whole, "node", "left_anti")
    return first.unionByName(more.drop("part_a", "part_b")), moved.select(
        "node", F.coalesce("top", "root").alias("root")
    ).unionByName(alone)


def shared_counts(sets: list) -> np.ndarray:
    """How many values each two of the sets share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    values = np.concatenate([np.asarray(x, np.int64) if isinstance(x, list) else x for x in sets])
    out = np.zeros((n, n), np.float32)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    common = times[column] > 1
    owner, column = owner[common], (np.cumsum(times > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((n, COLUMNS), np.float32)
        has[owner[a:b], column[a:b] - at] = 1
        out += has @ has.T
    return out


def between_parts(cell: pa.Table, similar: float) -> list[tuple[bytes, bytes, float]]:
    """Links between nodes of different parts of a cell, enough to join all parts that belong together.

    Shared words of all pairs are counted at once, in matrices; only pairs
    with enough of them are aligned. A pair is judged in its least common bucket.
    """
    key, low, high = (cell[c][0].as_py() for c in ("key", "low", "high"))
    nodes, block = cell["node"].to_pylist(), cell["block"].to_numpy()
    number: dict[bytes, int] = {}
    part = np.array([number.setdefault(p, len(number)) for p in cell["part"].to_pylist()])
    if len(number) < 2:
        return []
    words = [words_of(x or b"") for x in cell["_text"].cast(pa.binary()).to_pylist()]
    marks = [word_marks(w) for w in words]
    size = np.array([len(m) for m in marks])
    keys = [[k for k in x if k < key] for x in cell["keys"].to_pylist()]
    wanted = shared_counts(keys) == 0
    wanted &= part[:, None] != part[None, :]
    wanted &= np.arange(len(nodes))[:, None] < np.arange(len(nodes))[None, :]
    if low != high:
        wanted &= block[:, None] != block[None, :]
    needed = similar / 2 * (size[:, None] + size[None, :]) - 1e-6
    wanted &= np.minimum(size[:, None], size[None, :]) >= needed
    if not wanted.any():
        return []
    shared = shared_counts(marks)
    left, right = np.nonzero(wanted & (shared >= needed))
    root = list(range(len(number)))

    def top(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    out = []
    for at in np.argsort(-shared[left, right], kind="stable").tolist():
        i, j = int(left[at]), int(right[at])
        a, b = top(part[i]), top(part[j])
        if a != b:
            near = similarity(words[i], words[j], similar)
            if near >= similar:
                root[a] = b
                out.append((nodes[i], nodes[j], near))
    return out


def classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similar: float = SIMILAR,
    sketches: int = SKETCHES,
    drawn: int = DRAWN,
    keep: list[str] | None = None,
) -> DataFrame:
    """The key, ``class_id``, ``class_rows``, ``kept``, ``repeats`` and ``digest`` of every row, and the columns ``keep``.

    ``class_id`` is the least key among a row and its near copies. One row of a class is
    kept: the one with the least key, then the least digest. Rows equal in key and words are
    kept alike; ``repeats`` says how many they are. ``digest`` stands for the words, so that key
    and digest tell the kept rows of different classes apart, also where a key is null or repeated.
    """
    # The text is carried once, whether or not it is to be kept.
    carried = {c: "_text" if c == text else f"_keep_{c}" for c in keep or []}
    rows = saved(sketched(docs, key, text, sketches, drawn, [c for c in carried if c != text], similar), "sketches")
    _, whole = near_links(rows, similar)
    per_key = rows.groupBy("node", "_key").agg(F.count("*").alias("repeats"))
    place = per_key.join(whole, "node", "left").select("node", "_key", "repeats", F.coalesce("root", "node").alias("root"))
    place = saved(place, "places")
    lead = place.groupBy("root").agg(
        F.min(F.struct(F.col("_key").isNull(), "_key", "node")).alias("lead"), F.sum("repeats").alias("class_rows")
    )
    judged = place.join(lead, "root").select(
        F.col("node").alias("_node"),
        F.col("_key").alias("_of"),
        F.col("lead._key").alias("class_id"),
        "class_rows",
        "repeats",
        (F.col("_key").eqNullSafe(F.col("lead._key")) & (F.col("node") == F.col("lead.node"))).alias("kept"),
    )
    return rows.join(judged, (F.col("node") == F.col("_node")) & F.col("_key").eqNullSafe(F.col("_of"))).select(
        F.col("_key").alias(key), "class_id", "class_rows", "kept", "repeats", F.col("_node").alias("digest"),
        *[F.col(held).alias(c) for c, held in carried.items()],
    )
