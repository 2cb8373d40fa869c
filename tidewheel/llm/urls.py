"""URL filter: allow and block entries in a trie, the longest match decides.

An entry is a host and a path. It fits a url if the url's host is the entry's
or a subdomain of it, and the url's path starts with the entry's. Of the
entries that fit, the one with the longest text (host and path together) wins,
then the one with the longer host; of two equal entries, block wins.

The trie's edges are host labels from the last to the first, and below each
host the segments of paths; what an entry's path has after its last ``/`` is
kept at the node and compared as a prefix. It is sent to the workers if the
entries stay under ``trie_bytes``; beyond that the same answers come from a join
of each url's possible hosts with the entries.

A null url, or one without ``://``, has an empty host and path and fits no
entry. Urls that fit none get ``otherwise``. Repeated urls each get their
answer; an empty table gives an empty table; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import append

ALLOW, BLOCK = "allow", "block"
#: Entries beyond so many bytes of text are joined rather than sent whole.
TRIE_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Entries by reversed host label, then by path segment."""

    def __init__(self, entries: list[tuple[str, str, str]]):
        self.hosts: dict = {}
        for verdict, host, path in sorted(entries, key=lambda e: e[0] == BLOCK):
            node = self.hosts
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *segments, rest = path.split("/")
            place = node.setdefault(None, {})
            for segment in segments:
                place = place.setdefault(segment, {})
            place.setdefault(None, {})[rest] = (len(host) + len(path), len(host), host + path, verdict)

    @staticmethod
    def _deepest(place: dict, segments: list[str]) -> tuple | None:
        best = None
        for depth in range(len(segments)):
            for rest, entry in place.get(None, {}).items():
                if segments[depth].startswith(rest) and (best is None or entry[:2] > best[:2]):
                    best = entry
            # The last piece has no slash behind it, so it leads to no further node.
            place = place.get(segments[depth]) if depth + 1 < len(segments) else None
            if place is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning entry and its verdict."""
        node, best, segments = self.hosts, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                entry = self._deepest(node[None], segments)
                if entry and (best is None or entry[:2] > best[:2]):
                    best = entry
        return best and best[2:]


def judge(
    df: DataFrame,
    entries: list[tuple[str, str, str]] | DataFrame,
    url: str = "url",
    otherwise: str = ALLOW,
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    ``entries`` are (verdict, host, path), as a list or as a table with these columns.
    """
    found = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop(
        "rule", "verdict"
    )
    if isinstance(entries, DataFrame):
        size = entries.select(F.sum(F.length("host") + F.length("path") + 8)).first()[0] or 0
        if size > trie_bytes:
            return _joined(found, entries, otherwise)
        entries = [tuple(r) for r in entries.select("verdict", "host", "path").toLocalIterator()]
    elif sum(len(h) + len(p) + 8 for _, h, p in entries) > trie_bytes:
        given = df.sparkSession.createDataFrame(entries, "verdict string, host string, path string")
        return _joined(found, given, otherwise)
    sent = df.sparkSession.sparkContext.broadcast(entries)

    def make():
        trie = Trie(sent.value)

        def work(hosts, paths):
            hits = [trie.find(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            return [[h and h[0] for h in hits], [h[1] if h else otherwise for h in hits]]

        return work

    return append(found, make, ["host", "path"], "rule string, verdict string")


def _joined(found: DataFrame, entries: DataFrame, otherwise: str) -> DataFrame:
    """The same by a join on every parent host of a url, one result per distinct place."""
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    places = found.select("host", "path").distinct()
    rules = entries.select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict")
    )
    best = (
        places.withColumn("_host", F.explode(parents))
        .join(rules, "_host")
        .where(F.col("path").startswith(F.col("_path")))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length(F.concat("_host", "_path")).alias("n"),
                    F.length("_host").alias("h"),
                    (F.col("_verdict") == BLOCK).alias("b"),
                    F.concat("_host", "_path").alias("rule"),
                    F.col("_verdict").alias("verdict"),
                )
            ).alias("_best")
        )
    )
    return (
        found.join(best, ["host", "path"], "left")
        .withColumns(
            {"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(otherwise))}
        )
        .drop("_best")
    )
