"""URL filtering with a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import attach

#: Rules up to this many bytes are broadcast as one trie; beyond that the rules are joined on the same keys.
MOST_TRIE_BYTES = 64 << 20
DEFAULT_VERDICT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased ASCII) and path of a URL; both empty if it has no ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"^(?s).*?://", ""))
    host = F.coalesce(F.regexp_extract(rest, r"^(?s)([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^(?s)[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class Trie:
    """Nodes are dicts. Host labels from the right, then path segments; ``None`` as a key leads to host and path ends."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})  # how the last, possibly partial, segment begins
            if ends.get(last) != "block":
                ends[last] = verdict

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule and verdict of the longest match: most host labels first, then the longest path."""
        labels, node, starts = host.split("."), self.root, []
        for depth in range(len(labels) - 1, -1, -1):
            node = node.get(labels[depth])
            if node is None:
                break
            if None in node:
                starts.append((depth, node[None]))
        for depth, paths in reversed(starts):
            best, at = None, 0
            for segment in path.split("/"):
                ends = paths.get(None, {})
                for size in range(len(segment), -1, -1):
                    if segment[:size] in ends:
                        best = (".".join(labels[depth:]) + path[: at + size], ends[segment[:size]])
                        break
                paths = paths.get(segment)
                if paths is None:
                    break
                at += len(segment) + 1
            if best:
                return best
        return None


def filter_urls(
    df: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, url_column: str = "url",
    most_bytes: int = MOST_TRIE_BYTES,
) -> DataFrame:
    """Every row with `host`, `path`, `rule` and `verdict`.

    `rules` are (verdict, host, path), as tuples or as a frame with these three columns. A rule fits its host and all
    subdomains, if the path starts with the rule's. More host labels win, then the longer path; between equal rules
    block wins. Without a rule `rule` is NULL and the verdict is allow.

    Rules of a frame are measured before they go to the driver: up to `most_bytes` they become one broadcast trie,
    beyond that URLs meet them in a shuffle join. A missing URL, or one without ``://``, has an empty host and path.
    Rules with a missing part are ignored. Repeated rows and empty tables give the same; columns of the input with the
    names of added columns are replaced.
    """
    added = ("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(url_column))
    passed = [c for c in df.columns if c not in added]
    rows = df.select(*passed, host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        rules = rules.select("verdict", F.lower("host").alias("host"), "path").dropna()
        size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 200)).first()[0] or 0
        if size > most_bytes:
            return _joined(rows, rules, df.count())
        rules = [tuple(r) for r in rules.collect()]
    return rows.withColumn("_judged", _judge(df.sparkSession, rules)("host", "path")).select(
        *passed, "host", "path", "_judged.rule", "_judged.verdict"
    )


def _judge(spark: SparkSession, rules: Sequence[tuple[str, str, str]]):
    shared = spark.sparkContext.broadcast([(v, h.lower(), p) for v, h, p in rules if None not in (v, h, p)])

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)
        for hosts, paths in parts:
            found = [trie.find(h, p) or (None, DEFAULT_VERDICT) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return judge


def _joined(rows: DataFrame, rules: DataFrame, total: int) -> DataFrame:
    """The same by a join: each distinct host and path meets the rules of the host and of its parents."""
    key = F.concat("host", F.lit("\0"), "path")
    pairs = rows.groupBy("host", "path").agg(F.count("*").alias("_n"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rules = rules.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.max("verdict").alias("_verdict"))
    met = pairs.withColumn("_parent", F.explode(parents)).join(rules, F.col("_parent") == F.col("_host"), "left")
    fits = F.startswith("path", F.col("_path"))
    order = F.struct(F.size(F.split("_host", r"\.")).alias("h"), F.length("_path").alias("p"), "_host", "_path", "_verdict")
    best = met.groupBy("host", "path", "_n").agg(F.max(F.when(fits, order)).alias("_best"))
    table = best.select(
        key.alias("_pair"), "_n", F.concat("_best._host", "_best._path").alias("rule"),
        F.coalesce("_best._verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"),
    )
    met = attach(rows.withColumn("_pair", key), table, "_pair", "_n", total, "path")
    return met.drop("_pair", "_n")
