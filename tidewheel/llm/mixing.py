"""Mixing sources to target weights by hash-random order and prefix sums.

A source's target is its weight's share of all words, but at most ``most`` times
its own words; what is above goes to the other sources by weight until none is
above. Each source gives whole epochs of its documents, then a last part: its
documents in the order of a hash of their id and text, up to the budget's last word.

The order does not depend on partitions or retries. Within a source of n rows the
hash cuts the rows into about sqrt(n) ranges; sums per range give each range's
start, so that no task holds a source and none is sorted whole. Rows with one id but different
texts fall into different ranges. Rows equal in both cannot be told apart by a hash: where a range has
``DEEP`` times the rows of an average one, those that repeat most are cut into ranges of their own.

A null text has 0 words. A null source is a source of its own, the last. Rows equal in
id and text are ordered by the columns carried; rows equal in these too are interchangeable, and each counts.
An empty table gives an empty table. Columns other than the id, the text and
the source do not matter and are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import saved
from tidewheel.operators.ordered import ranks

WEIGHTS = (5, 2, 1)
MOST = 3
#: A range of more than so many times the average, and so many rows, is looked into for repeated rows.
DEEP, FEW = 8, 1000
#: Sources and ranges up to so many bytes, with so many per row besides the name, are broadcast.
SENT_BYTES, ROW_BYTES = 8 << 20, 64
SPACES = "\t\n\x0b\f\r "


def word_count(text: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; each word becomes one letter, so no list of words is made."""
    letters = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), SPACES, "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each row of (source, source_size).

    Sources above their limit are settled round by round; only sums over
    sources reach the driver. Each round settles one source at least, so it ends.
    """
    numbered = ranks(
        sources.withColumn("_named", F.coalesce(F.hex(F.encode("source", "UTF-8")), F.lit("~"))),
        [],
        "_named",
        [],
        F.when(F.col("source").isNull(), F.lit(2.0**33)).otherwise(
            F.conv(F.substring(F.rpad("_named", 8, "0"), 1, 8), 16, 10).cast("double")
        ),
        dense=False,
    )
    weight = F.element_at(
        F.array(*[F.lit(w).cast("long") for w in weights]),
        ((F.col("row_number") - 1) % len(weights) + 1).cast("int"),
    )
    rows = numbered.select("source", "source_size", weight.alias("_weight"))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * F.lit(most).cast("long")
    settled = F.lit(False)
    left, shares = total, None
    while True:
        open_rows = rows.where(~settled)
        shares = open_rows.agg(F.sum("_weight")).first()[0]
        if not shares:
            break
        # Compared in whole numbers, so that no rounding decides who is above.
        wide = "decimal(38,0)"
        above = F.col("_weight").cast(wide) * F.lit(left).cast(wide) > limit.cast(wide) * F.lit(
            shares
        ).cast(wide)
        taken = open_rows.where(above).agg(F.sum(limit)).first()[0]
        if taken is None:
            break
        settled = settled | above
        left -= taken
    share = F.col("_weight").cast("double") * F.lit(float(left)) / F.lit(float(shares or 1))
    return rows.select(
        "source", "source_size", F.when(settled, limit.cast("double")).otherwise(share).alias("target")
    )


def _order(key: str, text: str) -> Column:
    whole = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), whole).cast("binary"))


def _apart(placed: DataFrame, deep: DataFrame) -> DataFrame:
    """``placed`` with ranges cut at the rows that repeat most in the ``deep`` ranges: ``_part`` and ``_share``.

    Parts follow each other in the order: what lies below the first such row, the row and its like, what lies
    between it and the next, and so on. Like rows are dealt into shares of about ``FEW``; they are
    interchangeable, so any share may come first.
    """
    inside = placed.join(deep, placed["_source"].eqNullSafe(deep["_deep_source"]) & (placed["_range"] == deep["_deep_range"]))
    often = (
        inside.groupBy("_source", "_range", "_order").agg(F.count("*").alias("_n")).where(F.col("_n") > FEW)
        .groupBy(F.col("_source").alias("_deep_source"), F.col("_range").alias("_deep_range"))
        .agg(F.sort_array(F.collect_list(F.struct("_order", "_n"))).alias("_often"))
    )
    # A deep range has few orders that repeat so often: at most its rows over FEW.
    often = saved(often, "mix-often")
    met = placed.join(often, placed["_source"].eqNullSafe(often["_deep_source"]) & (placed["_range"] == often["_deep_range"]), "left")
    like = F.filter("_often", lambda x: x["_order"] == F.col("_order"))
    below = F.size(F.filter("_often", lambda x: x["_order"] < F.col("_order")))
    is_one = F.coalesce(F.size(like), F.lit(0)) > 0
    shares = F.ceil(F.element_at(like, 1)["_n"] / FEW)
    part = F.when(F.col("_often").isNull(), 0).otherwise(2 * below + is_one.cast("int"))
    share = F.when(is_one, F.pmod(F.xxhash64("_number"), shares)).otherwise(0)
    return met.withColumns({"_part": part.cast("int"), "_share": share.cast("long")}).drop("_deep_source", "_deep_range", "_often")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    keep: list[str] | None = None,
) -> DataFrame:
    """The id, ``size``, ``source_size``, ``target`` and ``taken`` of every row.

    ``taken`` counts words with repeats: whole epochs and what the last part has of the
    row. ``keep`` names further columns to carry (they are shuffled with the row).
    """
    keep = keep or []
    rows = docs.select(
        F.col(key).alias("_id"),
        F.col(source).alias("source"),
        word_count(text).alias("size"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
        _order(key, text).alias("_order"),
        F.monotonically_increasing_id().alias("_number"),
    )
    if not keep:
        rows = saved(rows, "mix-sizes")
    sources = saved(
        rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")),
        "mix-sources",
    )
    wanted = targets(sources.select("source", "source_size"), weights, most)
    # The first 32 bits of the hash, scaled, are the range.
    ranges = F.ceil(F.sqrt("_rows")).cast("long")
    plan = sources.select(F.col("source").alias("_source"), ranges.alias("_ranges")).join(
        wanted, F.col("_source").eqNullSafe(F.col("source"))
    )
    plan = plan.select("_source", "_ranges", "source_size", "target")
    # What is joined to the rows is measured; only under the bound is it sent to every task.
    named = F.coalesce(F.length("source"), F.lit(0)) * 4 + ROW_BYTES
    size = sources.agg(F.sum(named), F.sum(named * ranges)).first()
    plan = F.broadcast(plan) if (size[0] or 0) <= SENT_BYTES else plan
    head = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    placed = rows.join(plan, rows["source"].eqNullSafe(plan["_source"])).withColumn(
        "_range", F.shiftright(head * F.col("_ranges"), 32)
    )
    # Ranges are cut where rows repeat; each range's rows are counted first, which only reads hashes.
    sizes = placed.groupBy("_source", "_range", "_ranges").agg(F.count("*").alias("_n"), F.sum("size").alias("_words"))
    rows_of = W.partitionBy("_source")
    sizes = saved(sizes.withColumn("_mean", F.sum("_n").over(rows_of) / F.col("_ranges")), "mix-ranges")
    deep = sizes.where((F.col("_n") > DEEP * F.col("_mean")) & (F.col("_n") > FEW)).select(
        F.col("_source").alias("_deep_source"), F.col("_range").alias("_deep_range")
    )
    at = ["_range"]
    if deep.isEmpty():
        per_range = sizes.select("_source", "_range", "_words")
    else:
        at = ["_range", "_part", "_share"]
        # Rows are dealt by their number, so it must not change between the two reads of them.
        placed = _apart(saved(placed, "mix-rows") if keep else placed, deep)
        per_range = placed.groupBy("_source", *at).agg(F.sum("size").alias("_words"))
    before = per_range.select(
        F.col("_source").alias("_of"),
        *[F.col(c).alias(f"_at{c}") for c in at],
        (F.sum("_words").over(W.partitionBy("_source").orderBy(*at)) - F.col("_words")).alias("_start"),
    )
    before = F.broadcast(before) if (size[1] or 0) <= SENT_BYTES and len(at) == 1 else before
    same = F.col("_source").eqNullSafe(F.col("_of"))
    for c in at:
        same = same & (F.col(c) == F.col(f"_at{c}"))
    located = placed.join(before, same)
    carried = [f"_keep_{c}" for c in keep if c not in (key, source)]
    last = [F.xxhash64(*carried)] if carried else []
    order = W.partitionBy("_source", *at).orderBy("_order", "_id", "size", *last)
    ahead = F.col("_start") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    whole = F.least(epochs, F.lit(most)).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_ahead"))).cast("long")
    return located.withColumn("_ahead", ahead).select(
        F.col("_id").alias(key),
        "size",
        "source_size",
        "target",
        (whole * F.col("size") + part).alias("taken"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep if c not in (key, "size", "source_size", "target", "taken")],
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source),
-- From the lowest limit per weight upwards, a source is above while its limit is under its share of what is left.
o AS (
  SELECT *, sum(3 * source_size) OVER before AS settled, sum(w) OVER before AS weights,
         (SELECT sum(source_size) FROM s)::BIGINT AS total, (SELECT sum(w) FROM s)::BIGINT AS all_w
  FROM s WINDOW before AS (ORDER BY source_size / w, encode(source) NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT *, (w::HUGEINT * (total - coalesce(settled, 0))::HUGEINT
             > 3 * source_size::HUGEINT * (all_w - coalesce(weights, 0))::HUGEINT) AS above FROM o),
g AS (
  SELECT coalesce(sum(3 * source_size) FILTER (above), 0)::BIGINT AS settled,
         coalesce(sum(w) FILTER (above), 0)::BIGINT AS weights FROM f),
t AS (
  SELECT source, source_size,
         CASE WHEN above THEN (3 * source_size)::DOUBLE
              ELSE w::DOUBLE * (total - g.settled)::DOUBLE / (all_w - g.weights)::DOUBLE END AS target
  FROM f, g),
p AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS budget,
         (sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || digest), doc_id, size
                          ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(budget // source_size, 3) ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)))::BIGINT AS taken
FROM e
"""


def materialized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: each as often as it is taken.

    The row at which a source's budget ends is cut after its last word taken. If there is a
    column ``n_chars`` it gets the code points of what is left.
    """
    names = docs.columns
    carried = docs.select("*", F.col(key).alias("_mix_key"), F.col(source).alias("_mix_source"), F.col(text).alias("_mix_text"))
    rows = mix(carried, "_mix_key", "_mix_text", "_mix_source", keep=names)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    left = F.col("taken") - whole * F.col("size")
    # A text without words takes no part of a budget and stays once.
    parts = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), whole),
        F.when((F.col("size") > 0) & (left > 0), F.array(left)).otherwise(F.array().cast("array<bigint>")),
    )
    cut = F.expr(r"array_join(slice(regexp_extract_all(_cut_text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, cast(_words as int)), '')")
    rows = rows.withColumn("_words", F.explode(parts)).withColumn("_cut_text", F.col(text))
    rows = rows.withColumn("_cut_text", F.when(F.col("_words") < 0, F.col(text)).otherwise(cut))
    new = {text: F.col("_cut_text")}
    if "n_chars" in names and "n_chars" != text:
        new["n_chars"] = F.when(F.col("_words") < 0, F.col("n_chars")).otherwise(F.length("_cut_text")).cast("long")
    return rows.withColumns(new).select(*names)
