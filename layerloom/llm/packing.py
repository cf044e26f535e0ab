"""Sequence packing with the online sum-of-squares rule.

Every document becomes the ids of its tokens and an end id. Whole windows are cut off its front; the rest is placed
at once, in arrival order, into the fill level that makes the sum of the squared numbers of partly filled windows
least, which a level array of these numbers gives without looking at any window. Each task packs its own rows, so
nothing is shuffled, and a task that is run again gives the same pieces.

At the end of a task (or where it holds more than ``max_open`` partly filled windows) the pieces that are left open
are poured into full windows, cut where needed; what remains at the end fills windows of powers of two, which need no
padding. So no id of a task is lost and padding stays at zero however few rows a task has.

Nulls, edges: a null or empty text is one end id. Texts of any length are encoded whole, by any tokenizers file. Rows that repeat an id are
packed one by one. An empty table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from layerloom.llm.arrays import slices, trimmed

CAPACITY = 4096
END_ID = 2
MAX_OPEN = 1024
CACHED_WORDS = 250_000
# Fixed value: the split pattern of the tokenizers file that the short cut is for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What it comes to over lower-cased texts of _PLAIN characters.
_WORDS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u017e]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z\u00df-\u00f6\u00f8-\u017e0-9]+")
_PLAIN = re.compile(r"[\n\x20-\x7e\u00c0-\u012f\u0131-\u0148\u014a-\u017e]*")
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def _byte_table() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(own)]
    return {x: 256 + i for i, x in enumerate(rest)}


class Merges:
    """The merge table of a byte-level BPE with word ends, for many words at once.

    All words go through the same rounds: each looks up its neighbouring symbols, and merges all places of its pair of
    least rank from the left. A merge comes after those that make its parts, so that is what one merge at a time gives."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.size = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order, np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        self.inner, self.last = (np.array([vocab.get(chr(c) + end, -1) for c in range(512)], dtype=np.int64) for end in ("", suffix))

    def __call__(self, words: list[str]) -> list[bytes]:
        """The ids of words, none empty, in the byte-level alphabet."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids, word = self.inner[chars], np.repeat(np.arange(len(words)), sizes)
        end = np.cumsum(sizes) - 1
        ids[end] = self.last[chars[end]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            at = np.flatnonzero(word[:-1] == word[1:])
            key = ids[at] * self.size + ids[at + 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            at, found = at[hit], found[hit]
            rank, own = self.ranks[found], word[at]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            open_ = np.zeros(len(words), dtype=bool)
            open_[own] = True
            going = open_[word]
            done.append((word[~going], ids[~going]))
            if not len(at):
                break
            least = np.minimum.reduceat(rank, first)
            best = rank == np.repeat(least, np.diff(np.r_[first, len(own)]))
            at, found = at[best], found[best]
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of overlapping places every second one
            even = (np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0
            at, found = at[even], found[even]
            ids[at] = self.made[found]
            going[at + 1] = False
            ids, word = ids[going], word[going]
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        data, cut = ids[order].astype("<u4").tobytes(), (4 * np.searchsorted(word[order], np.arange(len(words) + 1))).tolist()
        return [data[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


class Encoder:
    """Ids by a tokenizers file.

    A text of plain Latin letters and ASCII signs is split by the pre-tokenizer's own pattern; most words are found in a
    bounded memo, and the new ones of some texts go through the merge table together. Of other texts only the chunks
    between white space that have other characters go through the whole tokenizer, which never joins across white space.
    With files of other kinds every text goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str | int, bytes] = {}
        self.old: dict[str | int, bytes] = {}
        self.plain, self.merges = self._plain_pattern()
        self.bytes = _byte_table()

    def _plain_pattern(self) -> tuple[re.Pattern | None, Merges | None]:
        """The split pattern and the merge table, if the file is of the kind that the short cut is right for."""
        spec = json.loads(self.tokenizer.to_str())
        norm, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
        kinds = [[x["type"] for x in y.get(k, [])] for y, k in ((norm, "normalizers"), (pre, "pretokenizers"))]
        if kinds != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] or model["type"] != "BPE":
            return None, None
        split = pre["pretokenizers"][0]
        if split["pattern"].get("Regex") != SPLIT:
            return None, None
        simple = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
        if split["behavior"] != "Removed" or not split["invert"] or not simple or not model.get("end_of_word_suffix"):
            return None, None
        return _WORDS, Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        """Put the ids of words into the memo."""
        memo, old = self.memo, self.old
        kept = new & old.keys()
        memo.update(zip(kept, map(old.__getitem__, kept), strict=True))
        due = list(new - kept)
        if due:
            memo.update(zip(due, self.merges([w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes) for w in due]), strict=True))

    def __call__(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        last = end.to_bytes(4, "little")
        if not self.plain:
            return [np.frombuffer(self._whole(t or "") + last, dtype="<u4") for t in texts]
        if len(self.memo) > CACHED_WORDS:  # two generations: what is still in use moves to the newer one
            self.memo, self.old = {}, self.memo
        memo, split, odd = self.memo, self.plain.findall, {}
        words: list[list[str]] = []
        for t in texts:
            t = t or ""
            if _PLAIN.fullmatch(t) and "<|" not in t:
                words.append(split(t.lower()))
            else:
                chunks = []
                for chunk in t.replace("\n", " ").split(" "):
                    if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
                        chunks += split(chunk.lower())
                    else:
                        odd[len(odd)] = self._whole(chunk)
                        chunks.append(len(odd) - 1)
                words.append(chunks)
        new = set().union(*words).difference(memo, odd)
        self._learn(new)
        memo.update(odd)
        out = [np.frombuffer(b"".join(map(memo.__getitem__, ws)) + last, dtype="<u4") for ws in words]
        for w in odd:
            del memo[w]
        for w in [w for w in new if len(w) > 64]:
            del memo[w]
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file; its memo serves all tasks of the process."""
    return Encoder(path)


class Packer:
    """Windows of one task. A piece is (document, start, ids); finished windows are lists of pieces."""

    def __init__(self, capacity: int = CAPACITY, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.done: list[list] = []

    def add(self, doc, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while n - at >= self.capacity:
            self.done.append([(doc, at, ids[at : at + self.capacity])])
            at += self.capacity
        if at < n:
            self._place((doc, at, ids[at:]), n - at)
            if self.n_open > self.max_open:
                self._pour(last=False)

    def _place(self, piece, size: int) -> None:
        """The change of the sum of squares is 2 N[h+size] - 2 N[h] + 2 at an open level h, less where the window
        gets full, and 2 N[size] + 1 for a new window. Ties go to the fullest level."""
        n, cap = self.levels, self.capacity
        h = np.flatnonzero(n[1 : cap - size + 1]) + 1
        best, level = 2 * int(n[size]) + 1, 0
        if len(h):
            change = 2 * (n[h + size] - n[h]) + 2
            if h[-1] == cap - size:
                change[-1] = 1 - 2 * n[h[-1]]
            i = len(h) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= best:
                level = int(h[i])
        window = self._take(level) if level else []
        window.append(piece)
        self._put(window, level + size)

    def _take(self, level: int) -> list:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, window: list, level: int) -> None:
        if level == self.capacity:
            self.done.append(window)
        else:
            self.levels[level] += 1
            self.n_open += 1
            self.open.setdefault(level, []).append(window)

    def _pour(self, last: bool) -> None:
        """Cut the open pieces into full windows, fullest first; keep the rest open, or give it out in powers of two."""
        pieces = [p for level in sorted(self.open, reverse=True) for w in self.open[level] for p in w]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        left = sum(len(p[2]) for p in pieces)
        window, room = [], self._room(left, last)
        size = room
        for doc, start, ids in pieces:
            at = 0
            while at < len(ids):
                got = ids[at : at + room]
                window.append((doc, start + at, got))
                at, room, left = at + len(got), room - len(got), left - len(got)
                if not room:
                    self.done.append(window)
                    window, room = [], self._room(left, last)
                    size = room
        if window:
            self._put(window, size - room)

    def _room(self, left: int, last: bool) -> int:
        return self.capacity if left >= self.capacity or not last else 1 << max(0, left.bit_length() - 1)

    def finish(self) -> None:
        self._pour(last=True)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: key and PIECES; with_ids adds the piece's ids. Sequence ids are unique in the result."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {PIECES}" + ", ids array<int>" * with_ids
    names = [key, *(x.split()[0] for x in PIECES.split(", "))] + ["ids"] * with_ids

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(capacity)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[list] = [[] for _ in names]
        key_type = None

        def give(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            for window in packer.done:
                offset, total = 0, sum(len(p[2]) for p in window)
                for (doc, size), start, ids in window:
                    row = [doc, start, len(ids), zlib.crc32(ids.tobytes()), size, sequence, offset, total] + [ids.astype(np.int32)] * with_ids
                    for column, x in zip(rows, row, strict=True):
                        column.append(x)
                    offset += len(ids)
                sequence += 1
            packer.done = []
            if len(rows[0]) > least:
                types = [key_type] + [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
                yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)
                for column in rows:
                    column.clear()

        for b in batches:
            key_type = b.column(0).type
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for some in slices([len(t or "") for t in texts]):
                for i, ids in zip(some, encode([texts[i] for i in some], end_id), strict=True):
                    packer.add((keys[i], len(ids)), ids)
                yield from give(4096)
        packer.finish()
        yield from give(0)

    return docs.select(key, text).mapInArrow(trimmed(part), schema)
