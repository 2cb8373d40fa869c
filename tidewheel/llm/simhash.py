"""SimHash fingerprints and the pairs of fingerprints within a Hamming radius.

Every term of a text has a hash of 128 bits; each bit of a fingerprint is the
sign of a vote in which a term's hash votes for one (its bit is set) or zero
with the term's weight. Terms are words and triples of neighbouring words, in
lower case (A-Z); the weight grows with the logarithm of the term's number, and
triples weigh more, since they are rarer.

Pairs are found with permuted block tables: the bits are cut into ``radius + 2``
blocks, and there is a table for each two blocks, keyed by their bits. Two
fingerprints within the radius differ in at most ``radius`` blocks, so they
share a key in one table at least. A pair is given by the first table that
finds it.

A null text counts as empty; a text without words has the fingerprint of all
zeros. Equal texts have equal fingerprints. Fingerprints are 32 hex digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import append, saved, utf8
from tidewheel.operators import segments

BITS = 128
DIGITS = BITS // 4
#: Weight of a word and of three neighbouring words.
SPAN_WEIGHTS = {1: 0.5, 3: 1.0}
#: Terms are voted on so many at a time.
BLOCK_TERMS = 1 << 16
#: Rows of a range of keys, and ranges whose first keys (three numbers each) are broadcast.
RANGE_ROWS = 50_000
RANGES_SENT = 1_000_000
#: +1 or -1 for each bit of each byte value.
SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0
_PLACES = np.arange(BITS // 8) * 256

_ODD = np.random.default_rng(3).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = h * _ODD[by]
    h ^= h >> np.uint64(29)
    h *= _ODD[by + 1]
    return h ^ (h >> np.uint64(32))


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different terms of a text, and their weights."""
    words = text.lower().split()
    h = _mixed(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1), 0)
    hashes, weights = [], []
    for span, weight in SPAN_WEIGHTS.items():
        if len(h) >= span:
            runs = h[: len(h) - span + 1]
            for i in range(1, span):
                runs = _mixed(runs ^ h[i : len(h) - span + 1 + i], 2)
            found, n = np.unique(runs, return_counts=True)
            hashes.append(found)
            weights.append(weight * (1 + np.log(n)))
    if not hashes:
        return h, np.zeros(0)
    return np.concatenate(hashes), np.concatenate(weights)


def fingerprint(text: bytes) -> str:
    hashes, weights = terms(text)
    votes = np.zeros((BITS // 8, 8))
    for at in range(0, len(hashes), BLOCK_TERMS):
        part, some = hashes[at : at + BLOCK_TERMS], weights[at : at + BLOCK_TERMS]
        both = np.stack([_mixed(part, 4), _mixed(part, 6)], 1).view(np.uint8)
        # Weights are summed per value of each byte first; its bits then share the sums.
        sums = np.bincount((both + _PLACES).ravel(), np.repeat(some, BITS // 8), 32 * BITS)
        votes += sums.reshape(-1, 256) @ SIGNS
    return np.packbits(votes.ravel() > 1e-9).tobytes().hex()


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of ``text``."""

    def make():
        return lambda texts: [[fingerprint(x) for x in utf8(texts)]]

    return append(df, make, [text], f"`{name}` string")


def distance(a: Column, b: Column) -> Column:
    """Number of bits in which two fingerprints differ."""

    def half(c: Column, at: int) -> list[Column]:
        # 60 bits are read at a time, so that a number keeps its sign bit clear.
        return [F.conv(F.substring(c, at + i, 8), 16, 10).cast("long") for i in (0, 8)]

    parts = []
    for at in (1, 17):
        for x, y in zip(half(a, at), half(b, at)):
            parts.append(F.bit_count(x.bitwiseXOR(y)))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def _blocks(radius: int) -> tuple[Callable[[Column, int], Column], list[tuple[int, int]]]:
    """What cuts a block out of a fingerprint, and the pairs of blocks that have a table."""
    if not 0 < radius <= DIGITS - 2:
        raise ValueError(f"radius must be from 1 to {DIGITS - 2}")
    edges = [round(i * DIGITS / (radius + 2)) for i in range(radius + 3)]

    def cut(c: Column, block: int) -> Column:
        return F.substring(c, edges[block] + 1, edges[block + 1] - edges[block])

    return cut, list(combinations(range(radius + 2), 2))


def _keyed(prints: DataFrame, name: str, radius: int) -> DataFrame:
    """Each row once for every table, with the bits of the table's two blocks."""
    cut, tables = _blocks(radius)
    c = F.col(name)
    keys = F.array(*[F.concat(cut(c, x), cut(c, y)) for x, y in tables])
    return prints.select("*", F.posexplode(keys).alias("_table", "_key"))


def _met(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """Rows of two keyed sides, with fingerprints ``a`` and ``b``, that are within the radius, once each."""
    cut, tables = _blocks(radius)
    same = [cut(F.col("a"), i) == cut(F.col("b"), i) for i in range(radius + 2)]
    first = F.lit(None)
    for n, (x, y) in reversed(list(enumerate(tables))):
        first = F.when(same[x] & same[y], n).otherwise(first)
    # Shuffled as numbers and bytes; the table of the left side tells which key was shared.
    shared = F.xxhash64("_table", "_key").alias("_hash")
    left = left.select("*", shared).drop("_key")
    right = right.select("*", shared, F.unhex("b").alias("_b")).drop("_table", "_key", "b")
    return (
        left.join(right, "_hash")
        .withColumn("b", F.lower(F.hex("_b")))
        .where((F.col("a") != F.col("b")) & (F.col("_table") == first))
        .withColumn("bits", distance(F.col("a"), F.col("b")))
        .where(F.col("bits") <= radius)
    )


def near_pairs(df: DataFrame, radius: int, name: str = "fingerprint") -> DataFrame:
    """All pairs of different fingerprints at most ``radius`` bits apart: ``a < b``, ``bits``.

    Rows with equal fingerprints count once; join the result with the rows for
    their members. Null fingerprints have no pairs.
    """
    once = df.select(F.col(name).alias("a")).where(F.col(name).isNotNull()).distinct()
    keyed = _keyed(once, "a", radius)
    return _met(keyed, keyed.withColumnRenamed("a", "b"), radius).where("a < b").select("a", "b", "bits")


def near_rows(df: DataFrame, sought: Column, radius: int, name: str = "fingerprint") -> DataFrame:
    """For each fingerprint of a row that ``sought`` takes: ``near_rows``, the other rows within the radius.

    The rows sought are the questions, all rows of ``df`` are searched. Rows with one
    fingerprint are counted before they meet a table, so copies are never paired; a row is
    not its own neighbour, its copies are. Null fingerprints neither ask nor answer.
    """
    prints = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("b"))
    prints = prints.agg(F.count("*").alias("_n"), F.max(F.coalesce(sought, F.lit(False))).alias("_sought"))
    asked = prints.where("_sought").select(F.col("b").alias("a"), (F.col("_n") - 1).alias("near"))
    met = _met(_keyed(asked.select("a"), "a", radius), _keyed(prints.select("b", "_n"), "b", radius), radius)
    both = asked.unionByName(met.select("a", F.col("_n").alias("near")))
    return both.groupBy(F.col("a").alias(name)).agg(F.sum("near").alias("near_rows"))


def ranges(df: DataFrame, columns: list[str], key: str, depth: int | None = None) -> DataFrame:
    """``_key`` (a whole number), ``_tie``, ``columns`` and the number of the row's range, which rises with them.

    ``_tie`` is a hash of ``columns`` and orders rows of one key, so that a key of many rows is
    cut as well. A range has at most about twice ``depth`` rows, unless more are equal in
    all of it; by default as many ranges as shuffle partitions, and more beyond ``RANGE_ROWS`` rows each.
    """
    rows = df.select(F.col(key).cast("long").alias("_key"), *columns).withColumn("_tie", F.xxhash64(*columns))
    if depth is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        depth = min(RANGE_ROWS, -(-rows.count() // partitions))
    piece = segments.cut(rows, [], [F.col("_key"), F.col("_tie")], depth=float(max(depth, 1)))
    return piece.rows.drop(segments.LARGE) if piece.split else rows.withColumn(segments.SEGMENT, F.lit(1).cast("long"))


def with_next(
    df: DataFrame,
    columns: list[str],
    key: str = "doc_id",
    add: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    depth: int | None = None,
) -> DataFrame:
    """``key``, ``columns`` and what ``add`` gives, each but ``key`` also as ``next_*``: the next row's by ascending key.

    The last row gets the first's. Rows of one key follow each other by a hash of their
    columns, then by the columns; a null key comes first. The rows are cut into ranges
    (see :func:`ranges`), and each range gets the first row of the next one, so the rows
    are shuffled once and no task holds them all. Of the ranges, their first keys alone
    meet in one task. Rows equal in key and columns stay in one range.
    """
    place = segments.SEGMENT
    rows = ranges(df, columns, key, depth)
    lowest = rows.groupBy(place).agg(F.min(F.struct("_key", "_tie")).alias("_low"))
    before = F.coalesce(F.lag(place).over(W.orderBy(place)), F.max(place).over(W.partitionBy()))
    firsts = saved(
        lowest.select(
            F.col(place).alias("_at"), F.col("_low._key").alias("_low_key"),
            F.col("_low._tie").alias("_low_tie"), before.alias("_before"),
        ),
        "ranges",
    )
    if firsts.count() <= RANGES_SENT:
        firsts = F.broadcast(firsts)
    met = (F.col(place) == F.col("_at")) & (F.col("_tie") == F.col("_low_tie"))
    met &= F.col("_key").eqNullSafe(F.col("_low_key"))
    carried = rows.join(firsts, met).groupBy("_before", "_key", "_tie").agg(F.min(F.struct(*columns)).alias("_row"))
    carried = carried.select("_key", "_tie", "_row.*", F.col("_before").alias(place), F.lit(True).alias("_carried"))
    both = add(rows.withColumn("_carried", F.lit(False)).unionByName(carried))
    led = [c for c in both.columns if not c.startswith("_")]
    window = W.partitionBy(place).orderBy("_carried", F.asc_nulls_first("_key"), "_tie", *columns)
    return (
        both.withColumns({f"next_{c}": F.lead(c).over(window) for c in led})
        .where(~F.col("_carried"))
        .select(F.col("_key").alias(key), *led, *[f"next_{c}" for c in led])
    )
