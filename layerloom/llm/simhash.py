"""SimHash near-duplicates found by multi-index hashing.

A 64-bit fingerprint has a bit set where over half the shingle hashes have it. Two fingerprints within ``distance``
bits agree, in one of their two halves, up to half that distance; so each fingerprint probes one table per half with
the small Hamming ball around its half, fetches the fingerprints that stand there and keeps those whose complete
distance fits. Only distinct fingerprints are indexed, so copies cost one row.

A table entry with more than ``bucket`` fingerprints would give pairs by the square. Such entries are taken out of the
tables, and the fingerprints that probe them are linked by another exact way: each is written to every value within
``distance/2`` bits of it, and all that meet at a value lie within ``distance`` of each other and are linked to the
least of them. No link is lost and rows stay in proportion to fingerprints. Groups are connected components.

Nulls, edges: a null, empty or blank text has fingerprint zero and links like any other; fewer words than a shingle
make one shingle. Texts of any length are read whole. Rows that repeat an id have that id's component; a null id is
in the component of its fingerprint, and counts only if no other id does. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerloom.llm.arrays import trimmed
from layerloom.llm.bloom import Level
from layerloom.llm.common import release, small, stored, unused
from layerloom.llm.components import components
from layerloom.llm.substring_dedup import shingles

SHINGLE = 3
DISTANCE = 2
BUCKET = 64
HASH_SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(ws)
    if len(ws) <= shingle:
        return digest(joined, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1) - 1
    starts = np.r_[0, ends[: -shingle] + 1]
    counts, n = np.zeros(64, dtype=np.int64), len(starts)
    a, b = starts.tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, n, 1 << 15):
        hashes = np.array([digest(joined[i:j], HASH_SEED) for i, j in zip(a[at : at + (1 << 15)], b[at : at + (1 << 15)], strict=True)], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps)], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(trimmed(part), f"`{key}` {kind}, fp long")


def fp_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _ball(bits: int, radius: int) -> list[int]:
    """Masks of up to radius of the lowest bits."""
    return [sum(1 << i for i in s) for r in range(radius + 1) for s in combinations(range(bits), r)]


def _halves(distance: int) -> list[tuple[int, int]]:
    """(shift, ball radius) of each half: within distance, one half differs in no more bits than its radius."""
    a, b = divmod(distance, 2)
    return [(32, a), (0, a if b else a - 1)] if distance else [(32, 0)]


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) whose connected components are those of all pairs of the distinct fps within distance bits."""
    half = lambda shift: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF))
    used = [(s, r) for s, r in _halves(distance) if r >= 0]
    table = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), half(s).alias("val")) for i, (s, _) in enumerate(used)])).alias("t")).select("t.seg", "t.val", "fp")

    def ball(seg: int, shift: int, radius: int) -> Column:
        masks = F.array(*[F.lit(m).cast("long") for m in _ball(32, radius)])
        return F.transform(masks, lambda m: F.struct(F.lit(seg).alias("seg"), half(shift).bitwiseXOR(m).alias("val")))

    balls = F.concat(*[ball(i, s, r) for i, (s, r) in enumerate(used)])
    probes = fps.select("fp", F.explode(balls).alias("t")).select("t.seg", "t.val", F.col("fp").alias("probe"))
    full = stored(table.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).drop("n"), "simhash-full")
    n_full = full.count()
    if n_full:
        table = table.join(small(full, n_full), ["seg", "val"], "left_anti")
    near = F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= distance
    found = probes.join(table, ["seg", "val"]).where((F.col("probe") < F.col("fp")) & near).select(F.col("fp").alias("u"), F.col("probe").alias("v"))
    if n_full:
        among = probes.join(small(full, n_full), ["seg", "val"], "left_semi").select(F.col("probe").alias("fp")).distinct()
        found = found.unionByName(_meet(among, distance))
    return found.distinct()


def _meet(fps: DataFrame, distance: int) -> DataFrame:
    """Links of all fps within an even distance by the values that lie half-way between them."""
    if distance % 2:
        raise ValueError("full table entries need an even distance")
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in _ball(64, distance // 2)]
    at = fps.select("fp", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    least = at.groupBy("z").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return at.join(least, "z").where("fp != v").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(key, fp, component_id): one row for each row of docs; the component is named by its least key."""
    prints = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    per_fp = stored(prints.groupBy("fp").agg(F.min(key).alias("least")), "fp-least")
    comps = components(links(per_fp.select("fp"), distance, bucket))
    moved = per_fp.join(comps.withColumnRenamed("node", "fp"), "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(comps.join(moved, "component").select(F.col("node").alias("fp"), F.col("component_id").alias("_moved")), "fp-component")
    per_fp_named = per_fp.join(small(named), "fp", "left").select("fp", F.coalesce("_moved", "least").alias("component_id"))
    return prints.join(per_fp_named, "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float | None = None, **options) -> DataFrame:
    """docs without the rows whose component is named by another row's key.

    With a similarity, documents also belong together whose sets of five-word shingles reach it (similar_links). Rows
    that repeat a key stay or go together. A row without a key goes if its fingerprint's component has a key."""
    found = stored(near_duplicates(docs, key, text, **options).select(F.col(key).alias("did"), "fp", "component_id"), "simhash-components")
    links_ = found.where("did <> component_id").select(F.col("did").alias("u"), F.col("component_id").alias("v"))
    if similarity is not None:
        links_ = links_.unionByName(similar_links(docs, key, text, similarity, links_))
    gone = stored(components(links_).where("node <> component").select(F.col("node").alias(unused(docs, "gone"))), "near-copies")
    kept = docs.where(F.col(key).isNotNull()).join(small(gone), F.col(key) == F.col(gone.columns[0]), "left_anti")
    bare = docs.where(F.col(key).isNull())
    if not bare.isEmpty():
        texts = fingerprints(bare.select(F.xxhash64(text).alias("th"), F.col(text).alias("text")).distinct(), "th", "text")
        named = found.where("component_id is not null").select("fp").distinct()
        copies = texts.join(named, "fp", "left_semi").select(F.col("th").alias(unused(docs, "gone")))
        kept = kept.unionByName(bare.join(copies, F.xxhash64(text) == F.col(copies.columns[0]), "left_anti"))
    return kept


# Links by shingle similarity: prefix filtering over the shingle sets, which misses no pair.

SAMPLE_DOCS = 2000
BLOCK = 256
SKETCH = [f"p{i}" for i in range(8)]
FILTER_BITS = 1 << 27


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes (uint64) of five-word shingles, sorted; a shorter text is one shingle of all its words."""
    return _set_of(text, shingles(text))


def _set_of(text: str | None, base: np.ndarray) -> np.ndarray:
    if len(base):
        return np.unique(base)
    return np.array([xxhash.xxh64_intdigest(" ".join((text or "").lower().split()), HASH_SEED)], dtype=np.uint64)


def prefix(found: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in an order of all shingles, those that are ``often`` last: sets that reach the similarity
    share one of them. A partner has at least similarity * n of the n, so it lacks at most the others."""
    rank = np.searchsorted(often, found)
    late = often[np.minimum(rank, len(often) - 1)] == found if len(often) else np.zeros(len(found), dtype=bool)
    order = np.concatenate([found[~late], found[late]])
    return order[: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]


def _often(texts: DataFrame) -> np.ndarray:
    """Shingles that several documents of a sample have. They only set an order, so results do not depend on them."""
    rows = texts.select("text").limit(SAMPLE_DOCS).toLocalIterator()
    values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(shingle_set(r.text) for r in rows)]), return_counts=True)
    return values[n > 2]


def _sets(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle set) of a batch's texts."""
    for i, t in enumerate(b.column(b.schema.get_field_index("text")).to_pylist()):
        yield i, shingle_set(t)


def _identity(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _prefix_keys(texts: DataFrame, often, similarity: float) -> DataFrame:
    """(key, n): the shingles of prefixes, n the number of documents of a batch that have it, at most 2."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [prefix(x, often.value, similarity) for _, x in _sets(b)]
            k, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(np.minimum(n, 2))], names=["key", "n"])

    return texts.select("text").mapInArrow(trimmed(part), "key long, n long")


def _prefix_docs(texts: DataFrame, often, held, similarity: float) -> DataFrame:
    """(did, r1, r2, n, keys, places, sketch, whole): the documents that share shingles (keys, at places) of their prefix, by a hash of their shingle set.

    The sketches are the parity of the shingles that fall on each of their bits, so two of them differ in no more bits
    than their sets have different shingles. The whole one has a bit for each shingle or more."""
    kind = texts.schema["did"].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = held.value
        for b in batches:
            rows, ids, sizes, keys, places, sketches, wholes = [], [], [], [], [], [], []
            for i, x in _sets(b):
                shared = prefix(x, often.value, similarity)
                at = np.flatnonzero(level.has(shared))
                shared = shared[at]
                if len(shared):
                    places.append(at)
                    rows.append(i)
                    ids.append(_identity(x))
                    sizes.append(len(x))
                    keys.append(shared.view(np.int64))
                    wholes.append(parities(x))
                    sketches.append(_folded(wholes[-1], 8 * len(SKETCH)).tobytes())
            id_ = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            sketch = np.frombuffer(b"".join(sketches), np.int64).reshape(-1, len(SKETCH))
            cut = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(k))) for x, k in ((keys, np.int64), (places, np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(id_[:, 0]), pa.array(id_[:, 1]), pa.array(sizes, pa.int32()), *lists, *map(pa.array, sketch.T.copy()), pa.array([x.tobytes() for x in wholes], pa.binary())], names=["did", "r1", "r2", "n", "keys", "places", *SKETCH, "whole"])

    return texts.select("did", "text").mapInArrow(trimmed(part), f"did {kind}, r1 long, r2 long, n int, keys array<long>, places array<int>, " + ", ".join(f"{x} long" for x in SKETCH) + ", whole binary")


def parities(found: np.ndarray) -> np.ndarray:
    """The parity of the shingles on each bit, in bytes: a power of two of bits, as many as shingles at least."""
    bits = max(64 * len(SKETCH), 1 << (len(found) - 1).bit_length())
    return np.packbits(np.bincount((found >> np.uint64(32)).astype(np.int64) % bits, minlength=bits) & 1)


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of size bytes that a longer one holds."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def may_be_similar(a: np.ndarray, b: np.ndarray, shingles_: int, similarity: float) -> bool:
    """Whether the parities of two sets, of so many shingles together, leave room for the similarity."""
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())
    return differ * (1 + similarity) <= shingles_ * (1 - similarity) + 1e-9


def _sets_named(texts: DataFrame, held) -> DataFrame:
    """(r1, r2, s): the shingle sets whose hash the filter lets through."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = held.value
        for b in batches:
            found = [(_identity(x), x.tobytes()) for _, x in _sets(b)]
            ids = np.frombuffer(b"".join(x for x, _ in found), np.int64).reshape(-1, 2)
            keep = np.flatnonzero(level.has(ids[:, 0].copy().view(np.uint64))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep, 0]), pa.array(ids[keep, 1]), pa.array([found[i][1] for i in keep], pa.binary())], names=["r1", "r2", "s"])

    return texts.select("text").mapInArrow(trimmed(part), "r1 long, r2 long, s binary")


def _filter(keys: DataFrame, number: int) -> object:
    n = keys.count()
    level = Level(number, max(1, n), 0.01, FILTER_BITS)
    if n:
        level.fill(keys)
    return keys.sparkSession.sparkContext.broadcast(level)


def similar_links(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, known: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) that link documents whose sets of five-word shingles have a Jaccard similarity of at least similarity:
    with the known ones their components are those of all such pairs. Rows without a key have no links.

    Two sets that reach the similarity share a shingle of their prefixes. One reading counts these shingles, and a
    bounded Bloom filter carries those of several documents to the next, which keeps the documents that have one.
    Documents with equal sets are linked and go on as one. First each document is held against the first one at each of
    its shingles. What these edges and the known ones (u, v) connect is one component; then all documents at a shingle
    that are in different components are held against each other, in blocks. Pairs whose sizes, places or sketches
    rule out the similarity end there; for the others the sets are read and decide."""
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("did"), F.col(text).alias("text"))
    often = docs.sparkSession.sparkContext.broadcast(_often(texts))
    shared = stored(_prefix_keys(texts, often, similarity).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("key").alias("h")), "shared-shingles")
    held = _filter(shared, 5)
    release(shared)
    found = stored(_prefix_docs(texts, often, held, similarity), "prefix-docs")
    rest = [F.first(c).alias(c) for c in ("n", "keys", "places", *SKETCH, "whole")]
    sets = stored(found.groupBy("r1", "r2").agg(F.min("did").alias("did"), *rest), "first-sets")
    equal = found.select("did", "r1", "r2").join(sets.select("r1", "r2", F.col("did").alias("v")), ["r1", "r2"]).where("did <> v").select(F.col("did").alias("u"), "v").distinct()
    equal = stored(equal, "equal-sets")
    release(found)
    half = len(SKETCH) // 2
    folded = [F.col(SKETCH[i]).bitwiseXOR(F.col(SKETCH[i + half])).alias(f"q{i}") for i in range(half)]
    rows = stored(sets.select("did", "r1", "r2", "n", F.explode(F.arrays_zip("keys", "places")).alias("e"), *folded).select("did", "r1", "r2", "n", F.col("e.keys").alias("seg"), F.col("e.places").alias("at"), *[f"q{i}" for i in range(half)]), "prefixes")
    least = rows.groupBy("seg").agg(F.min(F.struct("did", "r1", "r2", "n")).alias("f"), F.count(F.lit(1)).alias("k")).where("k > 1").select("seg", F.col("f.r1").alias("o1"), F.col("f.r2").alias("o2"), F.col("f.n").alias("m"))
    near = F.least("n", "m") >= similarity * F.greatest("n", "m")
    met = rows.join(least, "seg").where(near & ((F.col("r1") != F.col("o1")) | (F.col("r2") != F.col("o2")))).select("r1", "r2", "o1", "o2").distinct()
    one = stored(_similar(met, sets, texts, similarity).unionByName(equal), "first-links")
    release(equal)
    named = stored(components(one if known is None else one.unionByName(known.select("u", "v"))), "first-components")
    labelled = rows.join(small(named), F.col("did") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "did")).drop("node", "component")
    mixed = labelled.groupBy("seg").agg(F.min("comp").alias("a"), F.max("comp").alias("z"), F.count(F.lit(1)).alias("k")).where("a < z").select("seg", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    members = stored(labelled.join(mixed, "seg"), "mixed-prefixes")
    release(rows)
    release(named)
    mine = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    theirs = members.select("seg", F.expr("cast(pmod(xxhash64(r1), blocks) as int)").alias("block"), F.col("did").alias("v"), F.col("r1").alias("o1"), F.col("r2").alias("o2"), F.col("n").alias("m"), F.col("at").alias("_at"), F.col("comp").alias("other"), *[F.col(f"q{i}").alias(f"_q{i}") for i in range(half)])
    # at the first shingle that two sets share, all that they share is still to come
    total, left = F.col("n") + F.col("m"), F.least(F.col("n") - F.col("at"), F.col("m") - F.col("_at"))
    differ = sum((F.bit_count(F.col(f"q{i}").bitwiseXOR(F.col(f"_q{i}"))) for i in range(half)), F.lit(0))
    may = near & (left * (1 + similarity) >= total * similarity - 1e-9) & (differ * (1 + similarity) <= total * (1 - similarity) + 1e-9)
    across = mine.join(theirs, ["seg", "block"]).where((F.col("did") > F.col("v")) & (F.col("comp") != F.col("other")) & may).select("r1", "r2", "o1", "o2").distinct()
    out = stored(one.unionByName(_similar(across, sets, texts, similarity)), "similar-links")
    for t in (members, one, sets):
        release(t)
    return out


def _similar(pairs: DataFrame, sets: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) of the pairs (r1, r2, o1, o2) of sets that reach the similarity.

    Pairs are thinned out by short sketches, then by whole ones, a 64th of the sets or little more; only what is left of
    them takes its sets through a shuffle."""
    kind = texts.schema["did"].dataType.simpleString()
    own = sets.select("r1", "r2", F.col("did").alias("u"), "n", *SKETCH)
    other = sets.select(F.col("r1").alias("o1"), F.col("r2").alias("o2"), F.col("did").alias("v"), F.col("n").alias("m"), *[F.col(x).alias(f"_{x}") for x in SKETCH])
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"_{x}"))) for x in SKETCH), F.lit(0))
    fits = (F.least("n", "m") >= similarity * F.greatest("n", "m")) & (differ * (1 + similarity) <= (F.col("n") + F.col("m")) * (1 - similarity) + 1e-9)
    short = stored(pairs.join(own, ["r1", "r2"]).join(other, ["o1", "o2"]).where(fits & (F.col("u") != F.col("v"))).select("r1", "r2", "o1", "o2", "u", "v", (F.col("n") + F.col("m")).alias("both")), "prefix-pairs")

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(*(b.column(i).to_pylist() for i in (6, 7, 8)), strict=True)
            keep = [may_be_similar(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), n, similarity) for n, x, y in both]
            yield b.select(range(6)).filter(pa.array(keep, pa.bool_()))

    whole = sets.select("r1", "r2", "whole")
    sketched = short.join(whole, ["r1", "r2"]).join(whole.select(F.col("r1").alias("o1"), F.col("r2").alias("o2"), F.col("whole").alias("_whole")), ["o1", "o2"])
    sketched = sketched.select("r1", "r2", "o1", "o2", "u", "v", "both", "whole", "_whole")
    near = stored(sketched.mapInArrow(trimmed(thinned), f"r1 long, r2 long, o1 long, o2 long, u {kind}, v {kind}"), "sketched-pairs")
    release(short)
    due = stored(near.select(F.col("r1").alias("h")).unionByName(near.select(F.col("o1").alias("h"))).distinct(), "pair-sets")
    named = stored(_sets_named(texts, _filter(due, 6)).groupBy("r1", "r2").agg(F.first("s").alias("s")), "sets")
    release(due)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both >= similarity * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    with_sets = near.join(named, ["r1", "r2"]).join(named.select(F.col("r1").alias("o1"), F.col("r2").alias("o2"), F.col("s").alias("t")), ["o1", "o2"])
    out = stored(with_sets.select("u", "v", "s", "t").mapInArrow(trimmed(part), f"u {kind}, v {kind}").distinct(), "set-links")
    release(near)
    release(named)
    return out
