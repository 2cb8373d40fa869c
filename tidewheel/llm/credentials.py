"""Secrets: fixed patterns, and weak candidates that count only beside their other parts.

The patterns give the base spans (assign, access, hex), which stay. Weak candidates are of
three kinds: ``ident`` (a user, account or client assignment, or the form of an access
identifier), ``key`` (an assignment to a word like ``pwd``, or a bare run of twenty or more
letters and digits with capitals, small letters and digits) and ``endpoint`` (a url, or an
assignment to a word like ``host``). Each part plays a role: access and ident identify,
assign, hex and key are secret, an endpoint is where they are used. A part's scope reaches
``REACH`` code points to either side. A weak key is reported if an identifier or an endpoint
lies in its scope, an ident if a secret does, an endpoint if both an identifier and a
secret do. Weak candidates that meet a base span are dropped.

All of it is DataFrame functions. Matches become rows; running sums of the gaps between them
give their places. Scopes and parts are joined by slots of ``REACH`` code points, and of
all parts of one role in a slot only the first and the last are kept, which decide whether
any lies in the scope: so no pairs are made, however many parts a text has. What one task
must hold together is at most the matches of one text.

Spans are code point offsets, end exclusive. A null text counts as empty; texts without
spans have zero counts and empty lists. Rows are never merged or dropped: equal rows give
equal results, and null or repeated keys are allowed. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import saved

KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
BASE_KINDS = KINDS[:3]
REACH = 256


def _spelled(word: str) -> str:
    """The word in either case of each ASCII letter."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _any_of(*words: str) -> str:
    return "|".join(map(_spelled, words))


_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""

# The forms of the parts. They use nothing that differs between regular expression libraries.
ASSIGN = f"({_any_of('password', 'passwd', 'secret', 'token', 'api_?key')}){_GIVEN}([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
URL = r"[a-z][a-z0-9+]{1,11}://[^\x20\x09-\x0D\"'<>]+"
HOST = f"(?:{_any_of('hostname', 'host', 'server', 'endpoint', 'url')}){_GIVEN}[A-Za-z0-9._:/-]+"
USER = f"(?:{_any_of('user_?name', 'user', 'login', 'account', 'client_?id', 'key_?id')}){_GIVEN}[A-Za-z0-9._@-]+"
CODE = "A(?:KI|SI|RO|ID)A[A-Z0-9]{8,}"
WORD = f"(?:{_any_of('pass', 'pwd', 'pin', 'auth', 'credentials?', 'private_?key', 'key')}){_GIVEN}[A-Za-z0-9+/_.=-]{{6,}}"
RUN = "[A-Za-z0-9+/_=-]{20,}"
#: One search for all weak parts, so that they never overlap: group 1 endpoint, 2 ident, 3 key, 4 key by its form only.
WEAK = f"({URL}|{HOST})|({USER}|{CODE})|({WORD})|({RUN})"


def _matches(
    text: str, pattern: str, kind: Callable[[Column], Column], good: Callable[[Column], Column], groups: tuple[int, ...]
) -> Column:
    """An array of structs (kind, number, gap before, size, good) of the matches of ``pattern``.

    ``kind`` and ``good`` are made from a match's text ``whole`` and its groups ``g1`` and so on.
    """
    source = F.col(text)
    whole = F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
    gaps = F.split(source, pattern, -1)
    found = F.arrays_zip(
        whole.alias("whole"),
        F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"),
        *[F.regexp_extract_all(source, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups],
    )
    out = F.transform(
        found,
        lambda x, i: F.struct(
            kind(x).cast("int").alias("kind"),
            i.alias("number"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["whole"]).alias("size"),
            good(x).alias("good"),
        ),
    )
    # Most texts have no match, and one search tells.
    return F.when(source.rlike(pattern), out).otherwise(F.array().cast(_MATCHES))


_MATCHES = "array<struct<kind:int,number:int,gap:int,size:int,good:boolean>>"


def _likely(x: Column) -> Column:
    """Of weak parts: all but bare runs without a capital, a small letter or a digit."""
    run = x["g4"]
    return (run == "") | (run.rlike("[0-9]") & run.rlike("[A-Z]") & run.rlike("[a-z]"))


def parts(rows: DataFrame, matches: str) -> DataFrame:
    """``_row``, ``kind`` (its place in ``KINDS``), ``start`` and ``end`` of all matches that pass."""
    found = rows.select("_row", F.explode(matches).alias("m")).select("_row", "m.*")
    # Matches of one search follow each other; weak parts of three kinds come from one search.
    order = W.partitionBy("_row", F.least("kind", F.lit(3))).orderBy("number")
    ran = F.sum(F.col("gap").cast("long") + F.col("size")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return found.withColumn("end", ran).where("good").select(
        "_row", "kind", (F.col("end") - F.col("size")).alias("start"), "end"
    )


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """``_row``, ``kind``, ``start`` and ``end`` of the weak parts whose complements lie in their scope.

    ``found`` is a saved result of :func:`parts` without weak parts that meet base spans.
    """
    role = F.when(F.col("kind").isin(1, 3), 0).when(F.col("kind") == 5, 2).otherwise(1)
    slot = lambda at: F.floor(at / reach)
    played = found.withColumn("role", role)
    # A part ahead of a scope's own part counts by its end, one after it by its start.
    sides = played.select(
        "_row", "role", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("end").alias("at")),
                                          F.struct(F.lit(1).alias("side"), F.col("start").alias("at")))).alias("s")
    ).select("_row", "role", "s.*")
    slots = sides.groupBy("_row", "role", "side", slot(F.col("at")).alias("slot")).agg(
        F.min("at").alias("low"), F.max("at").alias("high")
    )
    wanted = F.when(F.col("kind") == 3, F.array(F.lit(1))).when(F.col("kind") == 4, F.array(F.lit(0), F.lit(2))).otherwise(
        F.array(F.lit(0), F.lit(1))
    )
    scopes = (
        found.where("kind >= 3")
        .withColumn("role", F.explode(wanted))
        .withColumn("s", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), (F.col("start") - reach).alias("from")),
            F.struct(F.lit(1).alias("side"), F.col("end").alias("from")),
        )))
        .select("_row", "kind", "start", "end", "role", "s.side", "s.from")
        # A scope's side is as wide as a slot, so it lies in two.
        .withColumn("upper", F.explode(F.array(F.lit(False), F.lit(True))))
        .withColumn("slot", slot(F.col("from")) + F.col("upper").cast("int"))
    )
    inside = F.when(F.col("upper"), F.col("low") <= F.col("from") + reach).otherwise(F.col("high") >= F.col("from"))
    met = scopes.join(slots, ["_row", "role", "side", "slot"]).where(inside)
    has = met.groupBy("_row", "kind", "start", "end").agg(F.countDistinct("role").alias("roles"))
    return has.where("kind < 5 or roles = 2").drop("roles")


def _apart(found: DataFrame) -> DataFrame:
    """``found`` without weak parts that meet a base span."""
    # Base spans so far reach furthest to a place; the next one starts at another.
    before = W.partitionBy("_row").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("_row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    base = F.col("kind") < 3
    seen = found.withColumn("_reach", F.max(F.when(base, F.col("end"))).over(before)).withColumn(
        "_next", F.min(F.when(base, F.col("start"))).over(after)
    )
    clear = (F.coalesce("_reach", F.lit(0)) <= F.col("start")) & (F.coalesce("_next", F.col("end")) >= F.col("end"))
    return seen.where(base | clear).drop("_reach", "_next")


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, with commas."""
    names = F.array(*map(F.lit, KINDS))
    named = F.transform(
        F.array_sort(spans),
        lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")),
    )
    return F.concat_ws(",", named)


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """``n_assign``, ``n_access``, ``n_hex`` (base spans), ``base_spans`` and ``spans`` of every row, and the columns ``keep``.

    A carried column with the name of a result gives way to it.
    """
    results = ["n_assign", "n_access", "n_hex", "base_spans", "spans"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in results and c != text]
    rows = docs.select(
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("_text")
    )
    searches = [
        _matches("_text", ASSIGN, lambda x: F.lit(0), lambda x: F.length(x["g2"]) >= 6, (2,)),
        _matches("_text", ACCESS, lambda x: F.lit(1), lambda x: F.lit(True), ()),
        _matches("_text", HEX, lambda x: F.lit(2), lambda x: F.lit(True), ()),
        _matches(
            "_text", WEAK, lambda x: F.when(x["g1"] != "", 5).when(x["g2"] != "", 3).otherwise(4), _likely, (1, 2, 4)
        ),
    ]
    # Written once: from here on a row's number stays the same, and the texts are not read again.
    rows = saved(
        rows.withColumn("_found", F.concat(*searches)).drop("_text").withColumn("_row", F.monotonically_increasing_id()),
        "matches",
    )
    found = saved(_apart(parts(rows, "_found")), "parts")
    spans = found.where("kind < 3").unionByName(linked(found, reach))
    whole = F.collect_list(F.struct("start", "kind", "end"))
    held = spans.groupBy("_row").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"_n{i}") for i in range(3)], whole.alias("_spans")
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    every = F.coalesce("_spans", none)
    named = {c: F.col(f"_keep_{i}") for i, c in enumerate(keep)}
    out = rows.drop("_found").join(held, "_row", "left")
    return out.select(
        *[x.alias(c) for c, x in named.items()],
        *[F.coalesce(f"_n{i}", F.lit(0)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        joined(F.filter(every, lambda x: x["kind"] < 3)).alias("base_spans"),
        joined(every).alias("spans"),
    )


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_search(name: str, pattern: str, groups: int) -> str:
    picked = "".join(f", regexp_extract_all(text, {_sql_text(pattern)}, {g}) AS g{g}" for g in range(1, groups + 1))
    ones = "".join(f", g{g}[i] AS g{g}" for g in range(1, groups + 1))
    lists = "".join(f", g{g}" for g in range(1, groups + 1))
    return f"""
{name}_a AS (
  SELECT doc_id, regexp_extract_all(text, {_sql_text(pattern)}, 0) AS m,
         string_split_regex(text, {_sql_text(pattern)}) AS gaps{picked} FROM d WHERE regexp_matches(text, {_sql_text(pattern)})),
{name}_b AS (SELECT doc_id, m, gaps{lists}, unnest(range(1, len(m) + 1)) AS i FROM {name}_a),
{name} AS (
  SELECT doc_id, m[i] AS m{ones}, (sum(length(gaps[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e
  FROM {name}_b)"""


#: The same spans in SQL, with the scopes as a plain join of intervals; ids are unique there.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_sql_search("f0", ASSIGN, 2)},
{_sql_search("f1", ACCESS, 0)},
{_sql_search("f2", HEX, 0)},
{_sql_search("f3", WEAK, 4)},
base AS (
  SELECT doc_id, 0 AS k, e - length(m) AS s, e FROM f0 WHERE length(g2) >= 6
  UNION ALL SELECT doc_id, 1, e - length(m), e FROM f1
  UNION ALL SELECT doc_id, 2, e - length(m), e FROM f2),
weak AS (
  SELECT doc_id, CASE WHEN g1 <> '' THEN 5 WHEN g2 <> '' THEN 3 ELSE 4 END AS k, e - length(m) AS s, e
  FROM f3 WHERE g4 = '' OR (regexp_matches(g4, '[0-9]') AND regexp_matches(g4, '[A-Z]') AND regexp_matches(g4, '[a-z]'))),
apart AS (
  SELECT * FROM weak w WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)),
part AS (SELECT *, CASE WHEN k IN (1, 3) THEN 0 WHEN k = 5 THEN 2 ELSE 1 END AS r FROM (
  SELECT * FROM base UNION ALL SELECT * FROM apart)),
met AS (
  SELECT w.doc_id, w.k, w.s, w.e, count(DISTINCT p.r) AS roles
  FROM apart w JOIN part p ON p.doc_id = w.doc_id AND p.s <= w.e + {REACH} AND p.e >= w.s - {REACH}
   AND CASE w.k WHEN 3 THEN p.r = 1 WHEN 4 THEN p.r IN (0, 2) ELSE p.r IN (0, 1) END
  GROUP BY ALL),
spans AS (SELECT * FROM base UNION ALL SELECT doc_id, k, s, e FROM met WHERE k < 5 OR roles = 2),
named AS (SELECT *, ['assign', 'access', 'hex', 'ident', 'key', 'endpoint'][k + 1] || ':' || s || ':' || e AS t FROM spans),
held AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
         string_agg(t, ',' ORDER BY s, k, e) FILTER (k < 3) AS b, string_agg(t, ',' ORDER BY s, k, e) AS a
  FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access,
       coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN held ON held.doc_id = d.doc_id
"""
