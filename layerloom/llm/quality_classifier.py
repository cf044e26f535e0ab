"""Quality classifier: naive Bayes support vectors.

Word n-grams of a document are indicator features, scaled by the log ratio of their smoothed counts in the two classes;
a linear hinge-loss model on these is fitted by dual coordinate descent and interpolated with the mean weight, and its
margin is mapped to a probability on rows it was not fitted on.

The fit takes a bounded sample of labelled rows (``sample_rows``, by hash of the key, so the same rows every time);
rows with crc32(key) mod 5 = 0 are never learnt from. Features of the sample are made on the executors and one task
fits; the driver gets the weights, 2**BITS floats. Scoring covers every row and whole texts and shuffles nothing.

N-grams are taken of two word streams: the lower-cased words, and the words' shapes (case, signs, digits, equal to the
word before) with runs of one shape counted, so that tables, shouting and stutter have indicators of their own.

Nulls, edges: a null or empty text has no words and scores as such. Rows without a label, or with a null one, teach
nothing; a key labelled twice counts with its lowest label. Without any label, or with one class only, all scores
are that class's (0.5 without any). Repeated rows score alike. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
SAMPLE_ROWS = 6_000
THRESHOLD = 0.3
BETA = 0.25


def _shape(w: str) -> str:
    if w.isalpha():
        return "a" if w.islower() else "A" if len(w) > 1 and w.isupper() else "b"
    core = w.strip(".,;:!?\"'()")
    if core.isalpha():
        return ("U" if len(core) > 1 and core.isupper() else "p") + (w[-1] if w[-1] in "!?" else "")
    return "n" if core.isdigit() else "o" if not core else w[0] if not w[0].isalnum() else "x"


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The sorted distinct feature numbers of one text."""
    raw = (text or "").split()
    n = len(raw)
    mask = np.uint64((1 << bits) - 1)
    if not n:
        return np.array([zlib.crc32(b"empty") & int(mask)], dtype=np.int64)
    crc = zlib.crc32
    low = np.fromiter((crc(w) for w in (text or "").lower().encode("utf-8", "surrogatepass").split()), dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = [low * np.uint64(0x9E3779B97F4A7C15)]
        if len(low) > 1:
            mixed.append((low[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (low[1:] * np.uint64(0x165667B19E3779F9)))
        words = np.concatenate(mixed) >> np.uint64(64 - bits)
    known: dict[str, str] = {}
    marks = []
    for w in raw:
        s = known.get(w)
        if s is None:
            s = known[w] = _shape(w)
        marks.append(s)
    counts: dict[str, int] = {}
    for s in marks:
        counts[s] = counts.get(s, 0) + 1
    stutter = sum(a == b for a, b in zip(raw, raw[1:], strict=False))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    extra = {f"n{n.bit_length()}", f"s{_eighths(stutter, n)}", f"d{_eighths(len(known), n)}", f"l{_eighths(len(lines) - len(set(lines)), len(lines))}"}
    extra |= {f"c{s}{_eighths(k, n)}" for s, k in counts.items()}
    extra |= {f"g{a}{b}" for a, b in set(zip(marks, marks[1:], strict=False))}
    extra |= {f"h{a} {b} {c}" for a, b, c in set(zip(marks, marks[1:], marks[2:], strict=False))}
    shapes = np.fromiter((crc(x.encode("utf-8", "surrogatepass")) * 0x9E3779B1 >> 7 & int(mask) for x in extra), dtype=np.int64)
    return np.union1d(words.astype(np.int64), shapes)


def _eighths(k: int, n: int) -> int:
    """0 for none, else 1 to 9 by how large a share of n k is, finer where it is small."""
    return 0 if not k else 1 + min(8, int(8 * (k / max(1, n)) ** 0.5))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 1.0, epochs: int = 8, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised hinge-loss model over rows of scaled indicators (y is -1 or 1).

    Dual coordinate descent: each step solves the problem of one multiplier in [0, C] exactly.
    """
    w, bias = np.zeros(len(scale)), 0.0
    norms = [np.sqrt((scale[r] ** 2).sum()) + 1e-9 for r in rows]
    values = [scale[r] / n for r, n in zip(rows, norms, strict=True)]
    alpha = np.zeros(len(rows))
    cost = np.where(y > 0, c, c * max(1.0, (y > 0).sum() / max(1, (y < 0).sum()) ** 1) ** 0.5)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v, yi = rows[i], values[i], y[i]
            gradient = yi * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # the row and the bias have square norm one each
            step = (new - alpha[i]) * yi
            if step:
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-2:
            break
    return w, bias


class Model:
    """Margins are means of weights over a document's scaled indicators; slope and shift make them probabilities."""

    def __init__(self, weights: np.ndarray, scale: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.scale, self.bias, self.slope, self.shift = weights.astype(np.float32), (scale**2).astype(np.float32), bias, slope, shift

    def score(self, text: str | None) -> float:
        r = features(text)
        margin = float(self.weights[r].sum(dtype=np.float64)) / (float(self.scale[r].sum(dtype=np.float64)) ** 0.5 + 1e-9) + self.bias
        return 1 / (1 + float(np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> Model:
    """A fifth of the rows only calibrates; the others are fitted."""
    size = 1 << bits
    constant = lambda p: Model(np.zeros(size), np.ones(size), 0.0, 0.0, float(np.log(p / (1 - p))))
    if not len(rows):
        return constant(0.5)
    if labels.min() == labels.max():
        return constant(0.999 if labels[0] else 0.001)
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), dtype=bool)
    counts = np.full((2, size), 1.0)
    for r, k in zip([r for r, h in zip(rows, held, strict=True) if not h], labels[~held], strict=True):
        counts[int(k), r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    y = np.where(labels > 0, 1.0, -1.0)
    w, bias = dual_descent([r for r, h in zip(rows, held, strict=True) if not h], y[~held], ratio)
    w = (1 - BETA) * np.abs(w).mean() + BETA * w
    raw = Model(w * ratio, ratio, bias, 1.0, 0.0)
    use = held if held.any() else ~held
    m = np.array([float(raw.weights[r].sum(dtype=np.float64)) / (float(raw.scale[r].sum(dtype=np.float64)) ** 0.5 + 1e-9) + bias for r, h in zip(rows, use, strict=True) if h])
    slope, shift = _platt(m, labels[use])
    return Model(w * ratio, ratio, bias, slope, shift)


def _platt(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic regression of the label on the margin, by damped Newton steps with smoothed targets."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    t = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum(), (p - t).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * margins**2).sum() + 1e-6, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-6:
            break
    return max(a, 0.0), b


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled rows that are not held out, of which about sample_rows are drawn by hash of the key."""
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    n = own.count()
    share = min(1.0, sample_rows / max(1, n))
    drawn = own.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20)) < int(share * (1 << 20))).groupBy(key).agg(F.min(label).alias("_y"))
    joined = docs.select(key, text).join(F.broadcast(drawn), key)  # at most sample_rows and their spread: a few hundred KB

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [features(t).astype(np.int32) for t in b.column("t").to_pylist()]
            yield pa.record_batch([b.column("h"), pa.array(out, pa.list_(pa.int32())), b.column("y")], names=["h", "f", "y"])

    found = joined.select(F.xxhash64(key).alias("h"), F.col(text).alias("t"), F.col("_y").cast("int").alias("y")).mapInArrow(vectors, "h long, f array<int>, y int")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        pdf = pd.concat(parts).sort_values("h", kind="stable") if parts else pd.DataFrame({"f": [], "y": []})
        m = fit_rows([np.asarray(x, dtype=np.int64) for x in pdf["f"]], (pdf["y"].to_numpy() > 0).astype(int))
        yield pd.DataFrame({"w": [m.weights.tobytes()], "s": [m.scale.tobytes()], "b": [m.bias], "k": [m.slope], "c": [m.shift]})

    got = found.repartition(1).mapInPandas(learn, "w binary, s binary, b double, k double, c double").collect()
    if not got:
        return fit_rows([], np.array([]))
    r, m = got[0], fit_rows([], np.array([]))
    m.weights, m.scale, m.bias, m.slope, m.shift = np.frombuffer(r["w"], np.float32), np.frombuffer(r["s"], np.float32), r["b"], r["k"], r["c"]
    return m


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([m.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(part, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
