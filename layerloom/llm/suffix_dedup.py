"""Removal of repeated substrings by longest previous factors.

A byte goes if some string of ``length`` bytes around it also starts earlier: in a document with a smaller key, or
further left in the same one. Strings never cross documents and are compared on the input.

1. Every window of ``length`` bytes has a name that its content alone decides: the least hash of its short substrings.
   Neighbouring windows mostly share it, so a document becomes runs of windows, one for about 35 bytes. Names that
   occur once in the corpus end there; a bounded Bloom filter carries the others to a second reading.
2. Of runs with equal name and content the earliest stays and all others are repeated windows as a whole.
3. Earliest runs that share a name with others of other content are read with their bytes, brought together by name,
   and put in document order. Their suffixes are ordered, and the longest previous factor of each start follows from
   its previous and next smaller positions in that order; starts with ``length`` bytes or more occur earlier.
   A name with more than ``hot`` such runs is dealt out window by window instead: equal windows meet in an aggregation.
4. The repeated windows of a document are merged to spans and cut from it.

Filters only let more through than needed, never less, so the result is exact. Bytes are joined to spans once, by key;
apart from that no text is shuffled but the runs of step 3.

Nulls, edges: a null text is empty; texts shorter than ``length`` lose nothing. Texts of any length are read in blocks.
A null key comes before all others. Rows that repeat both key and text are one document and get the same result; rows
that repeat a key only are ordered by a hash of the text. An empty table gives an empty result. Extra columns, whatever
their names, come through unread; one that has the name of a result column is replaced.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.llm.arrays import mix, previous_smaller, slices, trimmed
from layerloom.llm.bloom import Level
from layerloom.llm.common import release, small, stored, unused

LENGTH = 100
NAME = 32
HOT = 4096
BLOCK = 1 << 18
SORTED = 1 << 19
FILTER_BITS = 1 << 27
_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, dtype=np.uint64)], dtype=np.uint64) for b in (_BASE, inverse))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, n at least."""
    return _powers(1 << max(16, int(n + LENGTH).bit_length()))


class Hashes:
    """Polynomial hashes of all substrings of a block of bytes, from prefix sums modulo 2**64."""

    def __init__(self, data: bytes):
        n = len(data)
        up, self.down = powers(n)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size]


def _blocks(data: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes): blocks that overlap so that every window of length bytes starts in exactly one."""
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        yield at, data[at : at + BLOCK + length - 1]


def runs(data: bytes, length: int = LENGTH, name: int = NAME) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, content hash, start, number of windows) of the runs of a document, as uint64, uint64, int64, int64."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    name = min(name, (length + 2) // 3)
    width = length - name + 1
    for at, block in _blocks(data, length):
        h = Hashes(block)
        short = mix(h.all(name))
        least, size = short, 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if width > size:
            least = np.minimum(least[: size - width], least[width - size :])
        # a run ends where the last of the least substrings is another one, so no two of its windows are equal
        start = np.r_[0, np.flatnonzero((least[1:] != least[:-1]) | (short[width:] == least[1:])) + 1]
        count = np.diff(np.r_[start, len(least)])
        with np.errstate(over="ignore"):
            content = mix(h.of(start, start + count + (length - 1)) ^ (count.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        for column, x in zip(out, (least[start], content, start + at, count), strict=True):
            column.append(x)
    kinds = (np.uint64, np.uint64, np.int64, np.int64)
    return tuple(np.concatenate(c).astype(k, copy=False) if c else np.zeros(0, k) for c, k in zip(out, kinds, strict=True))


def previous_factors(windows: np.ndarray) -> np.ndarray:
    """For each row, in text order, the length of the longest match of its start with that of an earlier row.

    A row is the beginning of a suffix, cut at a common length. In suffix order the best earlier match of a suffix is
    the nearest one before or behind it that stands earlier in the text: its previous or next smaller position. What it
    has in common with it is the least that neighbours between them have in common.
    """
    n, width = windows.shape
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{width * windows.itemsize}").ravel(), kind="stable")
    line = windows[order]
    other = line[1:] != line[:-1]
    common = np.where(other.any(axis=1), other.argmax(axis=1), width).astype(np.int64)
    for at, shared in ((order, np.r_[0, common]), (order[::-1], np.r_[0, common[::-1]])):
        low = shared.copy()
        found = previous_smaller(at, low=low) >= 0
        out[at[found]] = np.maximum(out[at[found]], low[found])
    return out


def longest_previous_factors(data: bytes) -> np.ndarray:
    """For each position the length of the longest match that starts earlier (and may overlap)."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    ended = np.zeros(2 * n, dtype=">u2")  # what follows the end is smaller than any byte
    ended[:n] = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 1
    return previous_factors(np.lib.stride_tricks.sliding_window_view(ended, n)[:n])


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For texts in document order: the starts in each whose longest previous factor is length or more.

    Only starts with ``length`` bytes before the end of their text take part, so no match crosses texts.
    """
    counts = np.array([max(0, len(t) - length + 1) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    firsts = np.cumsum(np.r_[0, counts])
    at = np.arange(firsts[-1]) + np.repeat(begins - firsts[:-1], counts)
    if not len(at):
        return [np.zeros(0, np.int64) for _ in texts]
    factors = previous_factors(np.lib.stride_tricks.sliding_window_view(raw, length)[at])
    repeated = factors >= length
    return [np.flatnonzero(repeated[a:b]) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal intervals of consecutive starts, as byte spans."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist(), strict=True))


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _names(texts: DataFrame, length: int) -> DataFrame:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [runs(_encoded(t), length)[0] for t in b.column(0).to_pylist()]
            k, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.record_batch([_signed(k), pa.array(np.minimum(n, 2))], names=["name", "n"])

    return texts.select("text").mapInArrow(trimmed(part), "name long, n long")


def _run_rows(texts: DataFrame, held, length: int) -> DataFrame:
    """The runs whose name the filter lets through."""
    kind = texts.schema["did"].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = held.value
        for b in batches:
            data = [_encoded(t) for t in b.column(2).to_pylist()]
            for some in slices([len(x) for x in data]):
                found = [runs(data[i], length) for i in some]
                at = np.repeat(np.arange(some.start, some.stop), [len(x[0]) for x in found])
                cols = [np.concatenate(c) for c in zip(*found, strict=True)]
                keep = np.flatnonzero(level.has(cols[0]))
                take = pa.array(at[keep])
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(_signed(c[keep]) for c in cols)], names=["did", "th", "name", "content", "start", "n"])

    return texts.select("did", "th", "text").mapInArrow(trimmed(part), f"did {kind}, th long, name long, content long, start long, n long")


def _run_bytes(texts: DataFrame, held, length: int) -> DataFrame:
    """The runs whose place the filter lets through, with their bytes. Texts without such a run are passed over by their hash."""
    kind = texts.schema["did"].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = held.value
        for b in batches:
            ths = b.column(1).to_numpy()
            for i in np.flatnonzero(level.has(_place(np.zeros(len(ths), np.uint64), ths, np.full(len(ths), -1)))).tolist():
                data = _encoded(b.column(2)[i].as_py())
                name, content, start, n = runs(data, length)
                keep = np.flatnonzero(level.has(_place(content, np.full(len(name), ths[i]), start)))
                for some in slices(n[keep].tolist(), 1 << 16):
                    at = keep[some.start : some.stop]
                    own = [data[s : s + k + length - 1] for s, k in zip(start[at].tolist(), n[at].tolist(), strict=True)]
                    take = pa.array(np.full(len(at), i))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(_signed(x[at]) for x in (name, content, start)), pa.array(own, pa.binary())], names=["did", "th", "name", "content", "start", "bytes"])

    return texts.select("did", "th", "text").mapInArrow(trimmed(part), f"did {kind}, th long, name long, content long, start long, bytes binary")


def _place(content: np.ndarray, th: np.ndarray, start: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(content ^ (start.astype(np.uint64) * np.uint64(0x165667B19E3779F9)) ^ th.view(np.uint64))


def _places(due: DataFrame) -> DataFrame:
    """(h): _place over columns content, th and start, and one place before the start for each text."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, th, start = (b.column(i).to_numpy() for i in range(3))
            texts = np.unique(th)
            h = np.r_[_place(content.view(np.uint64), th, start), _place(np.zeros(len(texts), np.uint64), texts, np.full(len(texts), -1))]
            yield pa.record_batch([_signed(h)], names=["h"])

    return due.select("content", "th", "start").mapInArrow(trimmed(part), "h long")


def _filter(keys: DataFrame, number: int, wrong: float = 0.01) -> object:
    """A broadcast filter of keys (h long), of FILTER_BITS at most whatever their number."""
    n = keys.count()
    level = Level(number, max(1, n), wrong, FILTER_BITS)
    if n:
        level.fill(keys)
    return keys.sparkSession.sparkContext.broadcast(level)


def _by_suffix_array(rows: DataFrame, length: int) -> DataFrame:
    """Spans of windows that occur earlier among runs of the same name; rows come sorted by name within a partition."""
    kind = rows.schema["did"].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def give() -> pa.RecordBatch:
            # rows that repeat key and text give the same run again
            once = {(r[0] is not None, r[0] if r[0] is not None else 0, r[1], r[2]): r for r in held}
            line = [once[k] for k in sorted(once)]
            out: list[list] = [[], [], [], []]
            for (did, th, start, _, _), starts in zip(line, repeated_starts([r[3] for r in line], length), strict=True):
                for a, b in _spans(starts, length):
                    for c, x in zip(out, (did, th, start + a, start + b), strict=True):
                        c.append(x)
            return pa.record_batch([pa.array(out[0], did_type), *(pa.array(c, pa.int64()) for c in out[1:])], names=["did", "th", "start", "end"])

        did_type = pa.int64()
        last = None
        for b in batches:
            did_type = b.schema.field("did").type
            cols = [b.column(c).to_pylist() for c in ("did", "th", "start", "bytes", "name")]
            for row in zip(*cols, strict=True):
                if size > SORTED and row[4] != last:
                    yield give()
                    held.clear()
                    size = 0
                held.append(row)
                size += len(row[3]) + 1
                last = row[4]
        if held:
            yield give()

    return rows.select("did", "th", "start", "bytes", "name").mapInArrow(trimmed(part), f"did {kind}, th long, start long, end long")


def _by_window(rows: DataFrame, length: int) -> DataFrame:
    """The same for names with very many runs: a row for each window, equal windows meet by a 128-bit hash."""
    kind = rows.schema["did"].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, one, two, where = [], [], [], []
            for i, (start, data) in enumerate(zip(b.column("start").to_pylist(), b.column("bytes").to_pylist(), strict=True)):
                n = len(data) - length + 1
                raw = Hashes(data).all(length)
                hashed = [hashlib.blake2b(data[k : k + length], digest_size=8).digest() for k in range(n)]
                at.append(np.full(n, i))
                one.append(raw)
                two.append(np.frombuffer(b"".join(hashed), dtype="<u8"))
                where.append(np.arange(start, start + n))
            if at:
                take = pa.array(np.concatenate(at))
                yield pa.record_batch([b.column("did").take(take), b.column("th").take(take), _signed(np.concatenate(one)), _signed(np.concatenate(two)), pa.array(np.concatenate(where))], names=["did", "th", "h1", "h2", "start"])

    wins = stored(rows.select("did", "th", "start", "bytes").mapInArrow(trimmed(part), f"did {kind}, th long, h1 long, h2 long, start long"), "hot-windows")
    first = wins.groupBy("h1", "h2").agg(F.min(F.struct("did", "th", "start")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    later = wins.join(first, ["h1", "h2"]).where(~F.struct("did", "th", "start").eqNullSafe(F.col("first")))
    return later.select("did", "th", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(did, th, start, end): byte spans, which may overlap, that cover exactly the bytes to remove. th is xxhash64(text)."""
    texts = docs.select(F.col(key).alias("did"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    names = _names(texts, length).groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("name").alias("h"))
    kept = stored(names, "repeated-names")
    rows = stored(_run_rows(texts, _filter(kept, 0), length), "repeated-runs")
    release(kept)
    place = F.struct("did", "th", "start")
    # rows that repeat key and text give the same runs again; as the least place is one of them, both keep it
    first = stored(rows.groupBy("name", "content").agg(F.min(F.struct("did", "th", "start", "n")).alias("f"), F.count(F.lit(1)).alias("k")), "first-runs")
    copies = rows.join(first.where("k > 1").select("name", "content", "f"), ["name", "content"]).where(~place.eqNullSafe(F.struct("f.did", "f.th", "f.start")))
    whole = stored(copies.select("did", "th", "start", (F.col("start") + F.col("n") + (length - 1)).alias("end")), "copied-runs")
    shared = stored(first.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "shared-names")
    due = first.join(shared.select("name"), "name", "left_semi").select("name", "content", "f.did", "f.th", "f.start")
    places = stored(_places(due), "due-runs")
    found = stored(_run_bytes(texts, _filter(places, 1, 0.002), length), "runs-with-bytes")
    release(places)
    busy = small(stored(shared.where(F.col("k") > hot).select("name"), "hot-names"))
    calm = found.join(busy, "name", "left_anti")
    n_parts = max(1, int(calm.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = calm.repartition(n_parts, "name").sortWithinPartitions("name")
    spans = _by_suffix_array(sorted_, length).unionByName(_by_window(found.join(busy, "name", "left_semi"), length)).unionByName(whole)
    out = stored(spans, "spans")
    for t in (rows, first, shared, found, whole):
        release(t)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) and, with_text, kept (these as text; broken characters are left out)."""
    made = RESULT + ", kept string" * with_text
    names = [x.split()[0] for x in made.split(", ")]
    plain = docs.drop(*[c for c in names if c != text and c != key])
    columns = plain.columns
    did, th, mine, cuts = (unused(plain, c) for c in ("did", "th", "own_th", "cuts"))
    spans = repeated_spans(docs, key, text, length, hot).groupBy(F.col("did").alias(did), F.col("th").alias(th)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(cuts))
    keyed = plain.withColumn(mine, F.xxhash64(F.col(text)))
    joined = keyed.join(spans, F.col(key).eqNullSafe(F.col(did)) & (F.col(mine) == F.col(th)), "left").select(*columns, cuts)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for some in slices([x or 0 for x in pc.binary_length(whole.column(text)).to_pylist()], 4 << 20):
                b = whole.slice(some.start, len(some))
                out: list[list] = [[] for _ in names]
                for t, s in zip(b.column(text).to_pylist(), b.column(cuts).to_pylist(), strict=True):
                    data = _encoded(t)
                    cut = merged([(x["start"], x["end"]) for x in s or ()])
                    parts, at = [], 0
                    for a, e in cut:
                        parts.append(data[at:a])
                        at = e
                    parts.append(data[at:])
                    left = b"".join(parts)
                    row = (len(data), len(data) - len(left), len(cut), hashlib.sha256(left).hexdigest())
                    if with_text:
                        row += (t if not cut else "".join(p.decode("utf-8", "ignore") for p in parts),)
                    for c, x in zip(out, row, strict=True):
                        c.append(x)
                arrays = [pa.array(c, k) for c, k in zip(out, [pa.int64()] * 3 + [pa.string()] * 2, strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + arrays, names=[*columns, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields) + ", " + made
    return joined.mapInArrow(trimmed(part), schema)
