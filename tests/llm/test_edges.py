"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerloom.llm import components, decontamination, packing, quality_classifier, quality_rules, sharding, simhash, substring_dedup, suffix_dedup, url_filter, warc
from layerloom.llm.queries import tokenizer_path


def test_classifier(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (8, None), (None, 1), (1, 1)], "doc_id long, quality int")
    model = quality_classifier.fit(odd, labels)
    rows = quality_classifier.score(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    empty = quality_classifier.fit(none, labels.limit(0))
    assert {r.score for r in quality_classifier.score(odd, empty).collect()} == {0.5}
    assert quality_classifier.score(none, model).count() == 0


def test_dual_descent():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.r_[rng.integers(2, 50, 5), 0 if i % 2 else 1]) for i in range(200)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(200)])
    w, b = quality_classifier.dual_descent(rows, y, np.ones(50))
    assert all((w[r].sum() / len(r) ** 0.5 + b > 0) == (t > 0) for r, t in zip(rows, y, strict=True))


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "Two THREE, four"), (2, None), (3, ""), (3, "été"), (1, "two three four"), (None, "six seven"), (9, "tail " * 12)], "item_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r["items"]) for r in decontamination.contamination(odd, bench).collect()}
    assert got[1, 7] == got[8, 7] == (5, ["", "1"])
    assert got[5, 90] == (30, ["3"]) and got[2, 0] == (0, []) and got[6, 40_000] == (0, [])
    assert decontamination.contamination(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(none, bench).count() == 0
    assert {r.doc_id for r in decontamination.keep_clean(odd, bench).collect()} == {2, 3, 4, 6, 7, None}
    index, _, anchors = decontamination.prepared(odd, spark.createDataFrame([(1, "one three")], "item_id long, text string"))
    assert decontamination.proximity_matches(index, anchors, 2).select("rid").distinct().count() == 2


def test_warc(spark, tmp_path):
    long = "x" * 200
    pages = spark.createDataFrame([(1, None, None), (2, "http://a/\n", ""), (3, "u", long), (4, "u", long), (4, "u", long), (None, "u", long), (5, "u", "é" * 20), (6, "u", "é" * 20)], "page_id long, url string, html string")
    got = sorted(((r.id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([(1, 0, "response", None), (2, 0, "response", None), (3, 200, "response", None), (4, 200, "revisit", 3), (4, 200, "revisit", 3), (None, 200, "revisit", 3), (5, 40, "response", None), (6, 40, "response", None)], key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_salvage():
    records = [warc.record("response", i, "http://x", bytes([65 + i]) * 500, 500, __import__("hashlib").sha256(bytes([65 + i]) * 500).hexdigest(), None) for i in range(5)]
    members = [warc.member(r) for r in records]
    assert all(m[-1] == 0 for m in members) and warc.member(b"a" * (1 << 24))[-1] == 0
    for parts in (members, records):
        whole = b"".join(parts)
        assert [r["id"] for r in warc.salvage(whole)] == [0, 1, 2, 3, 4]
        at = len(parts[0]) + len(parts[1]) // 2
        broken = whole[:at] + b"\xff\xfe\xfd" + whole[at + 3 :]
        found = list(warc.salvage(broken))
        assert [r["id"] for r in found if r["kind"] == "record"] == [0, 2, 3, 4]
        gap = [r for r in found if r["kind"] == "gap"]
        assert [(g["offset"], g["length"]) for g in gap] == [(len(parts[0]), len(parts[1]))]
        cut = list(warc.salvage(whole[:-20]))
        assert [r["id"] for r in cut if r["kind"] == "record"] == [0, 1, 2, 3] and cut[-1]["kind"] == "gap"
    assert [r["kind"] for r in warc.salvage(b"")] == ["gap"] and [r["kind"] for r in warc.salvage(b"junk" * 9)] == ["gap"]


def test_damaged_archives(spark, tmp_path):
    """Archives of any name and depth, one with a damaged member, one with a bad record between good ones in a member."""
    made = [warc.record("response", i, "http://x", bytes([65 + i]) * 500, 500, __import__("hashlib").sha256(bytes([65 + i]) * 500).hexdigest(), None) for i in range(6)]
    (tmp_path / "deep").mkdir()
    members = [warc.member(r) for r in made[:3]]
    (tmp_path / "deep" / "CC-1.warc.gz").write_bytes(members[0] + members[1][:40] + b"\xff\xfe" + members[1][42:] + members[2])
    broken = made[4].replace(b"WARC/1.", b"WORC/1.", 1)
    (tmp_path / "b.warc.gz").write_bytes(warc.member(made[3] + broken + made[5]))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert {r.id for r in rows if r.kind == "record"} == {0, 2, 3, 5}
    assert sorted((r.path.rsplit("/", 1)[1], r.reason.startswith("part of a member")) for r in rows if r.kind == "gap") == [("CC-1.warc.gz", False), ("b.warc.gz", True)]


def test_urls(spark):
    urls = [None, "", "no scheme/net/", "http://EXAMPLE.net/en/x", "http://a.example.net/", "http://anexample.net/en/", "http://x.net", "https://u.org/fr/?q#f", "ftp://b.example.com/de/", "http://b.example.com/d", "a://://net/", "http://net/?x"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    for most in (url_filter.MAX_BYTES, 0):  # through the cascades, and by a join
        got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge(pages, max_bytes=most).collect()}
        assert [got[i] for i in range(len(urls))] == [
            ("", None, "allow"), ("", None, "allow"), ("", None, "allow"), ("example.net", "example.net/en/", "allow"), ("a.example.net", "net/", "block"),
            ("anexample.net", "net/", "block"), ("x.net", None, "allow"), ("u.org", "org/fr/", "allow"), ("b.example.com", "example.com/de/", "block"),
            ("b.example.com", None, "allow"), (":", None, "allow"), ("net", "net/", "block"),
        ]
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules=()).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    listed = spark.range(0, 20_000, 7).select(F.xxhash64("id").alias("h"))
    cascade = url_filter.build_cascade(listed, universe)
    want = {r.h for r in listed.collect()}
    h = np.array([r.h for r in universe.collect()])
    assert len(cascade.levels) > 1 and set(h[cascade.has(h.view(np.uint64))].tolist()) == want


def test_substring_dedup(spark, odd, none):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(n))
    passage = text(60)
    words = passage.split()
    words[25] = "other"
    rows = [(1, text(80) + " " + passage + " " + text(90)), (2, passage), (3, text(30) + " " + " ".join(words)), (4, text(200)), (5, " ".join(words[:40])), (6, None), (None, passage), (2, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in substring_dedup.classes(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, None: None}
    assert substring_dedup.classes(odd).count() == 10 and substring_dedup.classes(none).count() == 0


def test_clipped_windows():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, t = int(rng.integers(0, 60)), int(rng.integers(1, 9))
        v = rng.integers(0, 12, n).astype(np.uint32)
        full = substring_dedup.compact_windows(v.astype(np.uint64), t)
        want = {(c, min(c - l, t - 1), min(r - c, t - 1)) for l, c, r in zip(*(x.tolist() for x in full), strict=True)}
        assert set(zip(*(x.tolist() for x in substring_dedup.clipped_windows(v, t)), strict=True)) == want


def test_simhash(spark, odd, none):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert {c for (d, f), c in got.items() if f == 0} == {2} and got[8, simhash_of(odd, 8)] == 1
    assert simhash.near_duplicates(none).count() == 0
    assert {r.doc_id for r in simhash.keep_one(odd).collect()} == {1, 2, 5, 6, 7, None}


def simhash_of(docs, key):
    return simhash.fingerprints(docs).where(f"doc_id = {key}").first().fp


@pytest.mark.parametrize("bucket", [1, 64])
def test_links(spark, bucket):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)} | set(base)
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket=bucket)
    got = {r.node: r.component for r in components.components(edges).collect()}
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(got.get(f, f) == find(f) for f in signed)


def test_components(spark):
    line = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(line, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_quality_rules(spark, odd, none):
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.ledger(odd).collect()}
    assert rows[6, 40_000].n_repeat_words == 40_000 and rows[2, 0].failure_bits & 1 and rows[5, 90].n_repeat_words == 90
    assert quality_rules.ledger(none).count() == 0 and quality_rules.apply_policy(odd).columns == odd.columns
    report = {r.rule: (r.failed, r.only_this_rule) for r in quality_rules.ablations(quality_rules.ledger(odd)).collect()}
    assert report["few_words"][0] == 7 and report["repeated_windows"][0] == 3


def test_packing(spark, odd, none):
    rows = packing.pack(odd, tokenizer_path(), with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in rows) and sum(r.length for r in rows if r.doc_id == 6) == 40_001
    assert [(r.length, r.ids) for r in rows if r.doc_id == 2] == [(1, [2])]
    assert packing.pack(none, tokenizer_path()).count() == 0
    for capacity, most in ((8, 3), (64, 1000)):
        p, n = packing.Packer(capacity, most), 0
        for i in range(300):
            size = (i * 37) % 29 + 1
            p.add(i, np.arange(size))
            n += size
        p.finish()
        sizes = [sum(len(x[2]) for x in w) for w in p.done]
        assert sum(sizes) == n and all(s == capacity or s & (s - 1) == 0 for s in sizes)


def test_suffix_dedup(spark, odd, none):
    rows = suffix_dedup.deduplicate(odd, length=20).collect()
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in rows}
    assert len(rows) == 10 and got[2, 0] == (0, 0) and got[8, 33][0] == 33 and got[6, 200_000] == (199_980 + 15, 1)
    assert suffix_dedup.deduplicate(none).count() == 0


@pytest.mark.parametrize("length", [3, 8, 20, 100, 150])
def test_repeated_starts(length):
    rng = random.Random(length)
    for _ in range(30):
        texts = [bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(0, 3 * length))) for _ in range(4)]
        texts.insert(2, texts[0][: 2 * length])
        seen, want = set(), []
        for t in texts:
            want.append([i for i in range(len(t) - length + 1) if t[i : i + length] in seen or seen.add(t[i : i + length])])
        assert [x.tolist() for x in suffix_dedup.repeated_starts(texts, length)] == want


def test_longest_previous_factors():
    rng = random.Random(3)
    for _ in range(40):
        x = bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40)))
        want = [max([0] + [next((k for k in range(len(x) - i + 1) if i + k >= len(x) or x[i + k] != x[j + k]), 0) for j in range(i)]) for i in range(len(x))]
        assert suffix_dedup.longest_previous_factors(x).tolist() == want


def test_sharding(spark, odd, none, tmp_path):
    rows = sharding.shuffle_shards(odd, shards=3, bucket_bytes=1000).collect()
    assert len(rows) == 10 and {f for f in rows[0].asDict()} >= set(odd.columns)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shuffle_shards(none).count() == 0
    sharding.write_shards(odd, str(tmp_path / "out"), shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_encoder(spark):
    """Words through the merge table against the whole tokenizer, for characters inside and outside of the short cut."""
    encode, rng = packing.Encoder(tokenizer_path()), random.Random(6)
    letters = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x180), 9, 0x3A9, 0x4E2D]]
    texts = ["".join(rng.choice(letters if rng.random() < 0.3 else "aabenst' .,1") for _ in range(rng.randrange(80))) for _ in range(600)]
    texts = [*(t for t in texts if "<|" not in t), "", "a" * 500, "aaa aaaa aaaaa", "<|endoftext|> x", "don't WE'LL ''s", None]
    for t, ids in zip(texts, encode(texts, 2), strict=True):
        assert ids.tolist() == [*encode.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def test_compact_windows():
    """Windows by the Cartesian tree against their definition."""
    rng = np.random.default_rng(2)
    for _ in range(150):
        n, t = int(rng.integers(0, 50)), int(rng.integers(1, 9))
        v, want = rng.integers(0, 12, n).astype(np.uint32), set()
        for c in range(n):
            l = max([i + 1 for i in range(c) if v[i] <= v[c]], default=0)
            r = min([i - 1 for i in range(c + 1, n) if v[i] < v[c]], default=n - 1)
            if r - l + 1 >= t:
                want.add((l, c, r))
        assert set(zip(*(x.tolist() for x in substring_dedup.compact_windows(v, t)), strict=True)) == want


def test_previous_factors_across_texts():
    """A window that repeats inside one text and in others, and one that only crosses texts."""
    got = suffix_dedup.repeated_starts([b"abcdabcd", b"cdab", b"xabcd", b""], 4)
    assert [x.tolist() for x in got] == [[4], [0], [1], []]


def test_repeated_rows_of_substrings(spark):
    """Rows that repeat key and text are one document: both keep what is theirs first."""
    long = "the first copy of a text that is long enough to be repeated elsewhere"
    docs = spark.createDataFrame([(1, long, 5), (1, long, 6), (2, "before " + long, 7)], "doc_id long, text string, did int")
    got = sorted((r.doc_id, r.did, r.n_removed, r.kept) for r in suffix_dedup.deduplicate(docs, length=20).collect())
    assert got == [(1, 5, 0, long), (1, 6, 0, long), (2, 7, len(long), "before ")]


def test_keep_one_without_keys(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([("a", text, 1), ("b", text, 2), (None, text, 3), (None, "other words stay where they are", 4)], "doc_id string, text string, gone int")
    for similarity in (None, 0.8):
        assert sorted(r.gone for r in simhash.keep_one(docs, similarity=similarity).collect()) == [1, 4]


def test_sharding_law(spark):
    """Key decides: a shard does not depend on texts or other rows, and one more shard takes rows only into itself."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    shards = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shuffle_shards(docs, shards=5).collect()}
    grown = {r.doc_id: r.shard for r in sharding.shuffle_shards(docs, shards=6).collect()}
    part = {r.doc_id: r.shard for r in sharding.shuffle_shards(docs.where("doc_id % 3 = 0").withColumn("text", F.lit("other")), shards=5).collect()}
    assert {d: g for d, (_, g) in shards.items()} == grown and all(g in (s, 5) for s, g in shards.values())
    assert all(shards[d][0] == s for d, s in part.items()) and set(grown.values()) == set(range(6))
    counts = np.bincount([s for s, _ in shards.values()], minlength=5)
    assert counts.min() > 40 and 30 < sum(g == 5 for g in grown.values()) < 110
