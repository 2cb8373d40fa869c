"""Hard negatives by exact inner products of several candidates at once.

Components are whole numbers, ``floor(256 * x)``. A bias makes them non-negative, and the components
of several candidates are put into separated fields of one wide whole number, wide enough for
the sum over all components. One multiplication by an anchor's (biased) component then
serves all the fields, and the sum's fields, less what the biases add, are the exact
scores. Numbers of up to 53 bits are held in doubles, where whole numbers are exact and products of matrices
fast; wider ones are Python's whole numbers, which have no bound.

Anchors and rows are dealt into blocks, and each two blocks meet in one task: for the
positives blocks of one label, for the negatives all blocks. Each cell passes on its best few
rows for an anchor, or for an anchor and a positive, and the best of all cells are the result. A
common label or a repeated row spreads over blocks; nothing is gathered on the driver.

Rows with a null label, a null vector, or a null or non-finite component take no part. A row
is never a positive or a negative of an anchor with its own id. Anchors equal in id, label and vector
are one anchor; other repeated rows count each. Vectors of unlike length form no pair. Rows with
a null id are candidates, the last among ties. A score beyond a long is given as the nearest long;
order and limits go by the exact score. Empty tables and single labels give no rows; columns besides
id, vector and label are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import prepare, saved

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Percent of the positive's score that a negative's has at least and at most.
LOW, HIGH = 50, 95
#: Rows and anchors of a block.
ROWS, ANCHORS = 4096, 1024
#: Whole numbers up to so many bits are exact in a double.
EXACT = 53
_LONG = (-(1 << 63), (1 << 63) - 1)


def whole_numbers(vectors: pa.Array, scale: int = SCALE) -> np.ndarray:
    """The vectors as a matrix of whole numbers, in doubles if all are exact there, else as Python's."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(scale * flat).reshape(len(vectors), -1)
    return out if not out.size or np.abs(out).max() < 2.0**EXACT else np.frompyfunc(int, 1, 1)(out)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all anchors (m, d) and rows (n, d), of whole numbers: an (m, n) matrix, exact."""
    m, n = len(anchors), len(rows)
    if not m or not n or not anchors.shape[1]:
        return np.zeros((m, n), np.int64)
    lift_a, lift_r = max(0, -int(anchors.min())), max(0, -int(rows.min()))
    top_a = int(anchors.max()) + lift_a
    # No sum of one field is above the largest component of an anchor times a row's sum.
    whole = rows.astype(object) if rows.dtype != object and np.abs(rows).max() * rows.shape[1] >= 2.0**EXACT else rows
    most = top_a * int((whole + lift_r).sum(1).max())
    bits = max(1, most.bit_length())
    exact = bits <= EXACT and anchors.dtype != object and rows.dtype != object
    fields = EXACT // bits if exact else 4
    if not exact:
        anchors, rows = (np.frompyfunc(int, 1, 1)(x) for x in (anchors, rows))
    a, r = anchors + lift_a, rows + lift_r
    each = -(-n // fields)
    r = np.concatenate([r, np.zeros((each * fields - n, r.shape[1]), r.dtype)])
    wide = sum(r[i * each : (i + 1) * each] * (2 ** (bits * i)) for i in range(fields))
    product = a @ wide.T
    product = product.astype(np.int64) if exact else product
    mask = (1 << bits) - 1
    out = np.concatenate([(product >> (bits * i)) & mask for i in range(fields)], axis=1)[:, :n]
    sums = [x.astype(np.int64) if exact else x for x in (anchors.sum(1), rows.sum(1))]
    # (a + A)(r + R) summed over d components is ar + R*sum(a) + A*sum(r) + dAR.
    return out - (lift_r * sums[0][:, None] + lift_a * sums[1][None, :] + anchors.shape[1] * lift_a * lift_r)


def _best(found: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the ``most`` allowed rows with the largest scores, the first among ties: indices of both."""
    m, n = found.shape
    if not allowed.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if found.dtype == object or int(np.abs(found).max()) >= (1 << 62) // n:
        picked = [sorted(np.flatnonzero(allowed[i]).tolist(), key=lambda j: (-int(found[i, j]), j))[:most] for i in range(m)]
        return np.repeat(np.arange(m), [len(p) for p in picked]), np.array([j for p in picked for j in p], np.int64)
    # One number for score and place, so that no two are equal.
    least = np.iinfo(np.int64).min
    order = np.where(allowed, found * n + np.arange(n - 1, -1, -1), least)
    top = np.argpartition(order, n - most, axis=1)[:, n - most :] if n > most else np.tile(np.arange(n), (m, 1))
    i, j = np.nonzero(np.take_along_axis(order, top, 1) > least)
    return i, top[i, j]


def _by_id(cell: pa.Table) -> pa.Table:
    return cell.sort_by([("id", "ascending")])


def _lengths(table: pa.Table) -> np.ndarray:
    return np.array([len(x) for x in table["vector"]], np.int64)


def _longs(values) -> pa.Array:
    return pa.array([min(max(int(x), _LONG[0]), _LONG[1]) for x in values], pa.int64())


def _cells(rows: pa.Table, anchors: pa.Table):
    """Each length of vectors: rows by id, anchors, all scores, and which pairs differ in id."""
    rows = _by_id(rows.combine_chunks())
    size_r, size_a = _lengths(rows), _lengths(anchors)
    for size in sorted(set(size_a.tolist()) & set(size_r.tolist())):
        r, a = rows.filter(pa.array(size_r == size)), anchors.filter(pa.array(size_a == size))
        found = scores(*[whole_numbers(x["vector"].combine_chunks()) for x in (a, r)])
        ids = r["id"].fill_null(0).to_numpy()
        other = (a["id"].to_numpy()[:, None] != ids[None, :]) | ~r["id"].is_valid().to_numpy()[None, :]
        yield r, a, found, other


def _table(names: list[str], kinds: list[pa.DataType], parts: list[list]) -> pa.Table:
    return pa.table([pa.concat_arrays([p[c] for p in parts]) if parts else pa.array([], k) for c, k in enumerate(kinds)], names=names)


def sortable(score: int) -> bytes:
    """A whole number of any size as bytes that order as the numbers do: sign and length, then digits."""
    digits = abs(score).to_bytes(max(1, (abs(score).bit_length() + 7) // 8))
    if score < 0:
        return (0x8000 - len(digits)).to_bytes(2) + bytes(255 - d for d in digits)
    return (0x8000 + len(digits)).to_bytes(2) + digits


def unsorted(key: bytes) -> int:
    """The number that :func:`sortable` made into ``key``."""
    if key[0] < 0x80:
        return -int.from_bytes(bytes(255 - d for d in key[2:]))
    return int.from_bytes(key[2:])


def _keys(values) -> pa.Array:
    return pa.array([sortable(int(x)) for x in values], pa.binary())


def prepared(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``n`` (a number for the row), ``id``, ``label`` and ``vector`` of the rows that take part, saved."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).where(fit)
    moved = (F.col(label).cast("long") + 1) % 10
    return saved(
        rows.select(
            F.monotonically_increasing_id().alias("n"), F.col(key).cast("long").alias("id"),
            F.when(F.col(key) % 7 == 0, moved).otherwise(F.col(label).cast("long")).alias("label"), F.col(vector).alias("vector"),
        ),
        "vectors",
    )


def _blocked(df: DataFrame, number: str, blocks) -> DataFrame:
    return df.withColumn("block", F.pmod(F.xxhash64(number), blocks))


def hard_negatives(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50,
    positives: int = POSITIVES, negatives: int = NEGATIVES, rows_per_block: int = ROWS, anchors_per_block: int = ANCHORS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    Anchors are the rows whose id ``every`` divides.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = prepared(vectors, key, vector, label)
    anchors = saved(
        rows.where(F.col("id") % every == 0).groupBy("id", "label", "vector").agg(F.min("n").alias("anchor")), "anchors"
    )
    blocks = lambda count, most: F.greatest(F.ceil(count / most), F.lit(1)).cast("long")
    # Positives: cells of one label.
    per_label = rows.groupBy("label").agg(blocks(F.count("*"), rows_per_block).alias("row_blocks"))
    per_label = anchors.groupBy("label").agg(blocks(F.count("*"), anchors_per_block).alias("anchor_blocks")).join(per_label, "label")
    every_block = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    dealt = _blocked(rows.join(per_label, "label"), "n", F.col("row_blocks")).withColumn("anchor_block", every_block("anchor_blocks"))
    asked = _blocked(anchors.join(per_label, "label"), "anchor", F.col("anchor_blocks")).withColumn("row_block", every_block("row_blocks"))
    dealt = dealt.select("label", F.col("block").alias("row_block"), "anchor_block", "id", "vector")
    asked = asked.select("label", "row_block", F.col("block").alias("anchor_block"), "anchor", "id", "vector")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            for r, a, found, other in _cells(left, right):
                i, j = _best(found, other, positives)
                parts.append([a["anchor"].take(i).combine_chunks(), r["id"].take(j).combine_chunks(), _keys(found[i, j])])
        return _table(["anchor", "id", "score"], [pa.int64(), pa.int64(), pa.binary()], parts)

    cell = ["label", "row_block", "anchor_block"]
    close = dealt.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(nearest, "anchor bigint, id bigint, score binary")
    order = W.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = close.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    known = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))
    # Negatives: all cells, with the limits that each positive sets.
    asked = saved(anchors.join(known, "anchor"), "asked")
    count = lambda df, most: max(1, -(-df.count() // most))
    row_blocks, anchor_blocks = count(rows, rows_per_block), count(asked, anchors_per_block)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = _blocked(rows, "n", F.lit(row_blocks)).select(F.col("block").alias("row_block"), all_of(anchor_blocks).alias("anchor_block"), "id", "label", "vector")
    asked = _blocked(asked, "anchor", F.lit(anchor_blocks)).select(
        all_of(row_blocks).alias("row_block"), F.col("block").alias("anchor_block"), "anchor", "id", "label", "vector", "positives"
    )

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            for r, a, found, other in _cells(left, right):
                other &= a["label"].to_numpy()[:, None] != r["label"].to_numpy()[None, :]
                wide = found.dtype == object or int(np.abs(found).max(initial=0)) >= 1 << 56
                hundred = (found.astype(object) if wide else found) * 100
                known = a["positives"].to_pylist()
                for p in range(positives):
                    score = [unsorted(k[p]["score"]) if p < len(k) else 0 for k in known]
                    limit = np.array(score, object if wide or max(map(abs, score), default=0) >= 1 << 56 else np.int64)
                    has = np.array([p < len(k) for k in known])
                    allowed = other & has[:, None] & (hundred >= LOW * limit[:, None]) & (hundred <= HIGH * limit[:, None])
                    i, j = _best(found, allowed.astype(bool), negatives)
                    chosen = [known[x][p] for x in i.tolist()]
                    parts.append([
                        a["id"].take(i).combine_chunks(), a["anchor"].take(i).combine_chunks(), pa.array([p] * len(i), pa.int32()),
                        pa.array([c["id"] for c in chosen], pa.int64()), r["id"].take(j).combine_chunks(),
                        _longs(unsorted(c["score"]) for c in chosen), _longs(found[i, j]), _keys(found[i, j]),
                    ])
        names = ["anchor_id", "anchor", "place", "positive_id", "negative_id", "positive_score", "negative_score", "score"]
        return _table(names, [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()], parts)

    cell = ["row_block", "anchor_block"]
    few = dealt.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(
        hard, "anchor_id bigint, anchor bigint, place int, positive_id bigint, negative_id bigint, "
        "positive_score bigint, negative_score bigint, score binary"
    )
    order = W.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("negative_id"))
    ranked = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.id AS anchor_id, r.id AS id, r.label = a.label AS same, list_inner_product(a.c, r.c)::BIGINT AS score
  FROM v a JOIN v r ON a.id % 50 = 0 AND r.id <> a.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
