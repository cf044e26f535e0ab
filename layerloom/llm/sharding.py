"""Two-pass external shuffle into shards.

Pass one scatters rows by seeded hashes of their key: first to a shard, by rendezvous hashing (the shard whose hash
with the key is largest), then to one of the shard's buckets. The number of buckets follows from the bytes of the
whole table, so that a bucket fits in memory at every size. Pass two collects each bucket, puts it in a fixed order and
runs Spark's seeded Fisher-Yates ``shuffle`` over it; rows come out in that order and a row's slot is its place there
after the buckets before it. Only DataFrame functions are used and texts are shuffled once.

``shuffle`` draws by partition and row, so the buckets of a partition are sorted first: a task that is run again gives
the same permutation.

Law ``key``: the key and the number of shards decide the shard; a further shard takes rows only into itself.

Nulls, edges: a null text counts 8 bytes; null keys all go to one shard. Rows with the same key (and so repeated rows)
land in one bucket and get slots of their own. An empty table gives an empty result. Columns named like a result
column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BYTES = 32 << 20
SEED = 20_011


def row_bytes(text: str = "text") -> Column:
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 8).cast("long")


def _draw(key: str, shard: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key), shard)


def shard_of(key: str, shards: int, seed: int = SEED) -> Column:
    """The shard of a key: an int in 0..shards-1 that depends on both alone."""
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(_draw(key, s, seed).alias("h"), (-s).alias("s"))))
    return (-best["s"]).cast("int")


def shuffle_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """docs with shard, slot (gapless from 0 within the shard) and grown_shard (the shard if there were one more)."""
    total = docs.agg(F.sum(row_bytes(text))).first()[0] or 0
    per_shard = max(1, math.ceil(total / shards / bucket_bytes))
    kept = [c for c in docs.columns if c not in ("shard", "slot", "grown_shard")]
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), F.col(key)), F.lit(per_shard)).cast("int")
    scattered = docs.select(shard_of(key, shards, seed).alias("_s"), bucket.alias("_b"), F.xxhash64(F.col(text)).alias("_h"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"))
    by_row = lambda a, b: (  # noqa: E731  nulls first, then by key and text hash
        F.when(a["k"].isNull() & b["k"].isNull(), _sign(a["h"], b["h"]))
        .when(a["k"].isNull(), F.lit(-1))
        .when(b["k"].isNull(), F.lit(1))
        .when(a["k"] == b["k"], _sign(a["h"], b["h"]))
        .otherwise(_sign(a["k"], b["k"]))
    )
    n_parts = max(1, min(shards * per_shard, 100_000))
    buckets = (
        scattered.repartition(n_parts, "_s", "_b")
        .groupBy("_s", "_b")
        .agg(F.collect_list(F.struct(F.col(f"_row.`{key}`").alias("k"), F.col("_h").alias("h"), F.col("_row").alias("row"))).alias("_rows"))
        .withColumn("_rows", F.array_sort("_rows", by_row))
    )
    sizes = docs.select(shard_of(key, shards, seed).alias("_s"), bucket.alias("_b")).groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    dealt = (
        buckets.join(starts, ["_s", "_b"])
        .sortWithinPartitions("_s", "_b")
        .select("_s", "_from", F.shuffle("_rows", F.lit(seed)).alias("_rows"))
        .select("_s", "_from", F.posexplode("_rows").alias("_i", "_r"))
    )
    grown = F.when(_draw("_key", F.lit(shards), seed) > F.col("_best"), F.lit(shards)).otherwise(F.col("_s"))
    return (
        dealt.select(F.col("_r.row").alias("_row"), F.col("_s"), (F.col("_from") + F.col("_i")).alias("_slot"))
        .withColumn("_key", F.col(f"_row.`{key}`"))
        .withColumn("_best", _draw("_key", F.col("_s"), seed))
        .select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], F.col("_s").alias("shard"), F.col("_slot").cast("long").alias("slot"), grown.cast("int").alias("grown_shard"))
    )


def _sign(a: Column, b: Column) -> Column:
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shuffled rows below path, a folder for each shard, in slot order within each bucket's file."""
    shuffle_shards(docs, **options).write.partitionBy("shard").parquet(path)
