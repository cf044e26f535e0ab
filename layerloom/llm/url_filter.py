"""URL rules judged through cascades of Bloom filters.

A rule is a host (which also covers its subdomains), a path prefix and an action. A URL is expanded into its candidate
keys, every suffix of its host joined with every prefix of its path that is as long as some rule's path, and the
longest candidate that is listed decides. "Is this key listed?" is answered without a join: for each action a cascade
encodes, over the complete universe of candidate keys of the corpus, first the listed keys, then the unlisted keys
that pass the first filter, then the listed keys that pass the second, until no false positive is left. Within that
universe the answer is exact.

Only the first level meets the whole universe; its false positive rate is set to listed/universe, so later levels are
about as large as the list. Bit arrays are OR-ed by an aggregation over their words, and their summed size is checked
against ``max_bytes`` before they are sent to the executors; a list beyond it is joined instead (``judge`` picks).

Nulls, edges: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed. An empty
table or an empty rule list work. Repeated rows are judged one by one. Where the same key is listed with both actions,
block wins. Extra columns are kept unless they are named like a result column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerloom.llm.bloom import Level
from layerloom.llm.common import stored

#: (host, path, action)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_BYTES = 64 << 20
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, "(?s)^.*?://([^/?#]*)", 1), *_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Longest first: every host suffix with every path prefix of the given lengths that the path has."""
    labels = F.split(host, "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)]))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    sized = F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(sized), lambda x: x["k"]))


class Cascade:
    """Exact membership of the listed keys within the universe it was built over."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @property
    def bytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)

    def has(self, h: np.ndarray) -> np.ndarray:
        """By the first level that lacks the key: an odd level lacks only unlisted keys, an even one only listed keys."""
        out = np.full(len(h), len(self.levels) % 2 == 1)
        left = np.arange(len(h))
        for i, level in enumerate(self.levels):
            passed = level.has(h[left])
            out[left[~passed]] = i % 2 == 1
            left = left[passed]
            if not len(left):
                break
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 64, max_bytes: int | None = None) -> Cascade | None:
    """listed and universe: distinct keys with their hash h (long). Keys of one hash count as one key.

    Each level's filter is built over executors; the driver holds only bit arrays. A level's size follows from its keys;
    where the levels would come to more than max_bytes, there is no cascade (None), and that level is not even begun.
    """
    inside = listed.select("h").distinct()
    outside = universe.select("h").distinct().join(inside, "h", "left_anti")
    n_in, n_out = inside.count(), outside.count()
    if not n_in:
        return Cascade([])
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * n_in / max(1, n_out)))
    levels: list[Level] = []
    encoded, other, n = inside, outside, n_in
    while n and len(levels) < max_levels:
        if max_bytes is not None and Cascade(levels).bytes + n * -math.log(rate) / math.log(2) ** 2 / 8 > max_bytes:
            return None
        level = Level(len(levels), n, rate)
        level.fill(encoded)
        levels.append(level)
        caught = stored(other.mapInPandas(_kept_by(level), "h long"), "cascade-level")
        encoded, other, rate = caught, encoded, 0.5
        n = caught.count()
    if n:
        raise ValueError("the cascade did not end: distinct keys with equal hashes")
    return Cascade(levels)


def _kept_by(level: Level):
    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf[level.has(pdf["h"].to_numpy().view(np.uint64))]

    return part


def key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def with_keys(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> DataFrame:
    """pages with host, path and the array _keys."""
    lengths = sorted({len(p) for _, p, _ in rules}) or [0]
    out = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    return out.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), lengths))


def universe_of(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.explode("_keys").alias("key")).distinct().withColumn("h", key_hash(F.col("key")))


def listed_keys(spark: SparkSession, rules: tuple[Rule, ...], action: str) -> DataFrame:
    keys = sorted({h.lower() + p for h, p, a in rules if a == action})
    return spark.createDataFrame([(k,) for k in keys], "key string").withColumn("h", key_hash(F.col("key")))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """pages with host, path, rule (the key that decided, else null) and verdict (allow or block)."""
    spark = pages.sparkSession
    plain = pages.drop(*[c for c in ("host", "path", "rule", "verdict", "_keys") if c in pages.columns and c != url])
    keyed = with_keys(plain, rules, url)
    universe = stored(universe_of(keyed).select("h"), "url-universe")
    cascades = {a: build_cascade(listed_keys(spark, rules, a), universe, max_bytes=max_bytes) for a in ("block", "allow")}
    if any(c is None for c in cascades.values()) or sum(c.bytes for c in cascades.values()) > max_bytes:
        return _judge_by_join(keyed, rules, default)
    held = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("array<int>")
    def actions(hashes: pd.Series) -> pd.Series:
        sizes = [0 if x is None else len(x) for x in hashes]
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in hashes if x is not None] or [np.zeros(0, np.int64)]).view(np.uint64)
        code = np.zeros(len(flat), dtype=np.int32)
        for n, a in ((2, "allow"), (1, "block")):
            code[held.value[a].has(flat)] = n
        return pd.Series(np.split(code, np.cumsum(sizes)[:-1]) if sizes else [])

    coded = keyed.withColumn("_codes", actions(F.transform("_keys", key_hash)))
    hits = F.filter(F.arrays_zip("_keys", "_codes"), lambda x: x["_codes"] > 0)
    hit = coded.withColumn("_hit", F.get(hits, F.lit(0)))
    return (
        hit.withColumn("rule", F.col("_hit._keys"))
        .withColumn("verdict", F.when(F.col("_hit._codes") == 1, "block").when(F.col("_hit._codes") == 2, "allow").otherwise(default))
        .drop("_keys", "_codes", "_hit")
    )


def _judge_by_join(keyed: DataFrame, rules: tuple[Rule, ...], default: str) -> DataFrame:
    """The same result where the bit arrays would be too large to send: distinct URLs' keys joined with the rules."""
    spark = keyed.sparkSession
    table = spark.createDataFrame([(h.lower() + p, a) for h, p, a in rules], "key string, action string").groupBy("key").agg(F.max("action").alias("action"))
    found = (
        keyed.select("host", "path", F.explode("_keys").alias("key")).distinct().join(table, "key")
        .groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "action")).alias("_hit"))
    )
    out = keyed.drop("_keys").join(found, ["host", "path"], "left")
    return out.withColumn("rule", F.col("_hit.key")).withColumn("verdict", F.coalesce("_hit.action", F.lit(default))).drop("_hit")
