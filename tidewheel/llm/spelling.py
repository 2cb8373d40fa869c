"""Spelling variants: words one edit apart, by states that walk a trie kept as a table.

The words of a table form a trie; its edges (node, character, next node) are rows, and so
are the states (word, position, node, edits) of the walk. Level by level all states at one
position are joined with the edges below their nodes: a state without an edit goes on by its
word's character, or takes another one and has an edit; it may also skip its own character, which
needs no edge; a state with an edit goes on by its own characters only. States that end
at a word's node with one edit have found a neighbour. A pair is found from one of its words:
by a skipped character from the longer one, by a greater character from the lesser one.

Near the root a node has many edges. So edits begin in the second half of a word: the trie has
the words read forward and backward, an edit in the first half being one in the second half of
the word backward, and a walk begins at the node of its first half. Nodes are 64-bit hashes
of their path; what is found is compared once more, so that equal hashes of unlike paths do no harm.

The number of levels is that of the characters of the longest word, so words of ``LONG`` or
more characters are compared in another way that is exact too: each way to leave out one character has a hash,
made from sums over the characters before and after, and words that agree in one are compared.

No join makes more rows of a state than a node has edges, or of a word than it has
characters and neighbours; nodes with very many words under them are spread by Spark's skew join.

Null texts have no words; a null key counts as the text ``''``. Rows equal in key and text
count each. An empty table gives an empty result; columns but key and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import append, discard, saved

LEAST, REPEATED, OFTEN, MOVED = 7, 2, 10, 31
#: Words from this length on are compared by what is left without one character.
LONG = 32
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An odd number, so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``word`` and ``n`` of the words of at least ``least`` characters, one run in ``MOVED`` losing a character."""
    # Shorter runs give shorter words, so only longer ones are taken out of the text.
    low = F.translate(F.coalesce(F.col(text), F.lit("")), _CAPITALS, _SMALL)
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
        F.explode(F.regexp_extract_all(low, F.lit(f"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"),
    )
    marked = runs.withColumn("h", F.crc32(F.concat_ws(":", "key", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    one = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = marked.select(F.when(F.col("h") % MOVED == 0, one).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def _node(way: Column, path: Column) -> Column:
    return F.xxhash64(way, path)


def short_pairs(words: DataFrame, longest: int) -> DataFrame:
    """Pairs (``a``, ``b``) of words one edit apart, in one order each, among words of at most ``longest`` characters.

    ``words`` has ``word``, saved.
    """
    short = words.where(F.length("word") <= longest).select("word")
    ways = short.select(F.lit(0).alias("way"), F.col("word").alias("path")).unionByName(
        short.select(F.lit(1).alias("way"), F.reverse("word").alias("path"))
    )
    ways = ways.withColumn("size", F.length("path"))
    half = F.floor(F.col("size") / 2).cast("int")
    ways = saved(ways.withColumn("from", F.when(F.col("way") == 0, half).otherwise(F.col("size") - half)), "trie-words")
    bounds = ways.agg(F.min("from"), F.max("size")).first()
    if bounds[0] is None:
        return short.select(F.col("word").alias("a"), F.col("word").alias("b")).where("false")
    first, last = bounds
    # Walks begin at `first` characters or deeper, so edges above are never read; one that skipped is a node higher.
    path = F.substring("path", F.lit(1), F.col("depth"))
    edges = (
        ways.withColumn("depth", F.explode(F.sequence(F.lit(first), F.greatest(F.col("size") - 1, F.lit(first)))))
        .where("depth < size")
        .select(
            "depth", _node(F.col("way"), path).alias("node"), F.substring("path", F.col("depth") + 1, F.lit(1)).alias("by"),
            _node(F.col("way"), F.substring("path", F.lit(1), F.col("depth") + 1)).alias("next"),
        )
        .distinct()
    )
    edges = saved(edges, "trie-edges")
    start = ways.select(
        "way", "path", "size", "from", _node(F.col("way"), F.substring("path", F.lit(1), F.col("from"))).alias("node"),
        F.lit(0).alias("edits"),
    )
    columns = ["way", "path", "size", "node", "edits"]
    steps, at = [], None
    for level in range(first, last):
        states = start.where(F.col("from") == level).select(*columns)
        if at is not None:
            states = states.unionByName(at.where(F.col("size") > level))
        own = F.substring("path", level + 1, 1)
        below = edges.where(F.col("depth").isin(level - 1, level)).select(F.col("node").alias("above"), "by", "next")
        walked = (
            states.join(below, F.col("node") == F.col("above"))
            .where(F.when(F.col("edits") == 1, F.col("by") == own).otherwise(F.col("by") >= own))
            .select("way", "path", "size", F.col("next").alias("node"), F.greatest("edits", (F.col("by") != own).cast("int")).alias("edits"))
        )
        skipped = states.where("edits = 0").withColumn("edits", F.lit(1))
        done = (F.col("size") > level + 1) | (F.col("edits") == 1)
        at = saved(walked.unionByName(skipped).where(done), "trie-states")
        steps.append(at.where(F.col("size") == level + 1))
    found = steps[0]
    for more in steps[1:]:
        found = found.unionByName(more)
    ends = ways.select(_node(F.col("way"), F.col("path")).alias("node"), F.col("path").alias("other"))
    pairs = found.join(ends, "node").where(F.levenshtein("path", "other", 1) == 1)
    forward = lambda c: F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(c))
    return pairs.select(forward("path").alias("a"), forward("other").alias("b")).distinct()


def _left_out(words: pa.Array) -> list[pa.Array]:
    """For each word its hash, and the hashes of it without each character in turn."""
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    whole, without = [], []
    for w in words.to_pylist():
        points = np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(len(points), _BASE, np.uint64))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(points * powers, dtype=np.uint64)])
            whole.append(int(sums[-1].astype(np.int64)))
            without.append((sums[:-1] + (sums[-1] - sums[1:]) * inverse).astype(np.int64).tolist())
    return [pa.array(whole, pa.int64()), pa.array(without, pa.list_(pa.int64()))]


def long_pairs(words: DataFrame, least: int) -> DataFrame:
    """As :func:`short_pairs`, among words of at least ``least`` characters."""
    long = words.where(F.length("word") >= least).select("word", F.xxhash64("word").alias("id"), F.length("word").alias("size"))
    hashed = append(long, lambda: _left_out, ["word"], "whole bigint, without array<bigint>")
    hashed = saved(hashed.select("id", "size", "whole", F.posexplode("without").alias("at", "rest")), "long-words")
    u, v = hashed.alias("u"), hashed.alias("v")
    replaced = u.join(v, ["size", "at", "rest"]).where("u.whole < v.whole").select(
        F.col("u.id").alias("id_a"), F.col("v.id").alias("id_b")
    )
    shorter = hashed.where("at = 0").select(F.col("id").alias("id_b"), (F.col("size") + 1).alias("size"), F.col("whole").alias("rest"))
    deleted = hashed.join(shorter, ["size", "rest"]).select(F.col("id").alias("id_a"), "id_b")
    # Numbers until here: long words themselves are joined only for pairs that agree.
    ids = replaced.unionByName(deleted).distinct()
    side = lambda c: long.select(F.col("id").alias(f"id_{c}"), F.col("word").alias(c))
    pairs = ids.join(side("a"), "id_a").join(side("b"), "id_b")
    return pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def neighbours(words: DataFrame, long: int = LONG) -> DataFrame:
    """``word`` and ``near`` for all words one inserted, deleted or replaced character apart, both ways round.

    ``words`` has distinct ``word``, saved.
    """
    # Both ways take the words of `long` characters, so no pair falls between them.
    pairs = short_pairs(words, long).unionByName(long_pairs(words, long)).distinct()
    return saved(pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"))
    )).alias("p")).select("p.*").distinct(), "near-words")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` from ``word`` and ``form``: forms followed to the last.

    Each round doubles the steps a word has gone, and counts rise along them, so a few rounds do.
    """
    at = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("top"))
        new = saved(
            at.join(ahead, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")),
            "roots",
        )
        discard(at)
        moved = new.where("moved").limit(1).count()
        at = new.drop("moved")
        at._saved_at = new._saved_at
        if not moved:
            return at


def variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, repeated: int = REPEATED, often: int = OFTEN, long: int = LONG
) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word that occurs ``repeated`` times."""
    words = saved(word_counts(docs, key, text, least).where(F.col("n") >= repeated), "words")
    near = neighbours(words, long).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= often * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("n"))).alias("to"),
    )
    judged = saved(judged.select("word", "n", "n_near", F.col("to.form").alias("form"), F.col("to.n").alias("form_n")), "forms")
    followed = roots(judged.where("form is not null"))
    return judged.join(followed, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


#: crc32 has no function there: a table of 256 remainders, then a step for each byte.
ORACLE = r"""
WITH t AS (
  SELECT list(list_reduce(list_prepend(b, range(8)),
                          lambda x, i: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS tab
  FROM (SELECT unnest(range(256)) AS b)),
r AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run FROM documents)
  GROUP BY ALL),
x AS (SELECT run, times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM r),
c AS (
  SELECT run, times, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM x, t),
m AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
         times FROM c),
w AS (SELECT word, sum(times)::BIGINT AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
v AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS near FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT v.word, w.word FROM v JOIN w ON v.rest = w.word
  UNION SELECT w.word, v.word FROM v JOIN w ON v.rest = w.word),
q AS (
  SELECT p.word, count(*) AS n_near, max(w.n) AS form_n, min(w.word) FILTER (w.n = top) AS form
  FROM (SELECT p.word, p.near, max(w.n) OVER (PARTITION BY p.word) AS top FROM p JOIN w ON w.word = p.near) p
  JOIN w ON w.word = p.near GROUP BY p.word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form,
         CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM w LEFT JOIN q ON q.word = w.word),
g AS (
  WITH RECURSIVE s AS (
    SELECT word, word AS root, form FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON f.word = s.form)
  SELECT word, root FROM s WHERE form IS NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, g.root FROM f JOIN g ON g.word = f.word
"""
