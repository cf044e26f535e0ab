"""Whole results: what a cap on partners, places or members would lose."""

import random
import time

import numpy as np

from layerloom.llm import components, simhash, substring_dedup


def words(rng, n, prefix=""):
    return [f"{prefix}{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]


def text(*parts):
    return " ".join(w for p in parts for w in p)


def classes(spark, rows):
    return {r.doc_id: r.class_id for r in substring_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_passage_of_frequent_lines(spark):
    """Passages whose lines also stand in earlier documents, so that their groups begin in those."""
    rng, rows, want = random.Random(1), [], {}
    for i in range(12):
        lines = [words(rng, 15) for _ in range(4)]
        first = 100 * i
        for j in range(12):
            rows.append((first + j, text(words(rng, 60), lines[j % 4], words(rng, 60))))
        for j in (50, 51):
            rows.append((first + j, text(words(rng, 60), *lines, words(rng, 60))))
            want[first + j] = first + 50
    got = classes(spark, rows)
    assert got == {d: want.get(d, d) for d, _ in rows}


def test_passage_among_phrases(spark):
    """Passages with phrases around them that stand elsewhere in the other document, at any place of a text."""
    rng, rows, want = random.Random(2), [], {}
    for i in range(40):
        before, after, passage = words(rng, 6), words(rng, 6), words(rng, 50)
        copy = list(passage)
        if i % 2:
            copy[25] = "other"
        rows.append((2 * i, text(words(rng, 30), before, words(rng, 70), passage, words(rng, 70), after, words(rng, 40))))
        rows.append((2 * i + 1, text(words(rng, rng.randrange(40, 100)), before, copy, after, words(rng, 60))))
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    got = classes(spark, rows)
    assert got == want


def similar_classes(spark, rows):
    """(got, want): the components of similar_links, and those of all pairs at 0.8 by brute force."""
    sets = {d: set(substring_dedup.shingles(t).tolist()) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    links = simhash.similar_links(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.node: r.component for r in components.components(links).collect()}
    return {d: got.get(d, d) for d in sets}, {d: find(d) for d in sets}


def test_similar_isolated(spark):
    """Isolated pairs of a similarity near 0.8."""
    rng, rows = random.Random(3), []
    for i in range(120):
        one = words(rng, 100 + i)
        two = list(one)
        for at in rng.sample(range(len(one)), rng.choice((1, 2, 2, 3))):
            two[at] = "other"
        rows += [(1000 + 2 * i, text(one)), (1001 + 2 * i, text(two))]
    got, want = similar_classes(spark, rows)
    assert got == want


def test_similar_at_full_entries(spark):
    """Near copies between the first and last of many documents on one template."""
    rng, rows, template = random.Random(5), [], words(random.Random(4), 200)
    for i in range(60):  # two of them have two thirds of their shingles in common, so they stay apart
        own = words(rng, 100)
        rows.append((2 * i, text(template, own)))
        if i % 2:
            rows.append((2 * i + 1, text(template, own[:75], words(rng, 25))))
    got, want = similar_classes(spark, rows)
    assert len(set(want.values())) > 30 and got == want


def test_similar_long_texts(spark, monkeypatch):
    """Long texts with phrases in common two by two are ruled out by sketches; only near copies have their sets read."""
    rng, rows, kept = random.Random(6), [], {}
    phrases = {(i, j): words(rng, 40) for i in range(6) for j in range(i + 1, 6)}
    for i in range(6):
        own = [w for p, phrase in phrases.items() if i in p for w in phrase] + words(rng, 3000 + 10 * i)
        rows.append((2 * i, text(own)))
        if i % 3 == 0:
            rows.append((2 * i + 1, text(own[:-100], words(rng, 100))))

    def stored(df, name, real=simhash.stored):
        out = real(df, name)
        kept[name] = kept.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "stored", stored)
    got, want = similar_classes(spark, rows)
    assert got == want and len(set(want.values())) == 6
    assert kept["pair-sets"] <= 8


def test_sketches_bound_differences():
    """Parities of any two sizes differ in no more bits than the sets do."""
    rng = np.random.default_rng(8)
    for n, m, both in ((5, 4, 3), (600, 500, 480), (1100, 1000, 990), (5000, 4000, 4000), (5000, 5000, 4444), (5000, 5000, 100)):
        x = rng.integers(0, 1 << 64, n + m - both, dtype=np.uint64)
        a, b = np.unique(x[:n]), np.unique(x[n - both :])
        similar = both >= 0.8 * (n + m - both)
        assert simhash.may_be_similar(simhash.parities(a), simhash.parities(b), n + m, 0.8) >= similar
    assert not simhash.may_be_similar(simhash.parities(a), simhash.parities(b), n + m, 0.8)


def test_line_just_too_short(spark, monkeypatch):
    """A line that is too short for a similar passage leads to pairs, but no shingles of them are moved."""
    rng, rows, kept = random.Random(9), [], {}
    line = words(rng, 44)
    for i in range(30):
        rows.append((2 * i, text(words(rng, 50), line, words(rng, 50 + i))))
        if i % 10 == 0:
            rows.append((2 * i + 1, text(rows[-1][1].split()[:-20], words(rng, 30))))

    def stored(df, name, real=substring_dedup.stored):
        out = real(df, name)
        kept[name] = kept.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(substring_dedup, "stored", stored)
    assert classes(spark, rows) == {d: d - d % 2 for d, _ in rows}
    assert kept["met-regions"] > 300 and kept.get("likely-pairs", kept["met-regions"]) < 30


def test_short_hashes_lose_no_pair():
    """What short hashes rule out has no similar passage by the shingles, repeated ones too, at any cut of the pieces."""
    rng, met, out = np.random.default_rng(10), 0, 0
    for _ in range(300):
        few = rng.integers(0, 1 << 64, rng.choice((8, 40, 400)), dtype=np.uint64)
        own = [few[rng.integers(0, len(few), n)] for n in rng.integers(10, 60, 2)]
        a, b = (np.r_[x, few[: rng.integers(5, 30)], x[:9]] for x in own)
        if rng.random() < 0.6:
            b = a.copy()
            b[rng.integers(0, len(b), rng.integers(0, 4))] = 1
        i, j = rng.integers(0, 5, 2).tolist()
        places = [{"shift": int(rng.integers(-3, 4)) if rng.random() < 0.3 else 0, "c": int(c)} for c in rng.integers(0, len(a), 3)]
        found = substring_dedup._meets(a, b, places, 12, 0.8)
        values = [np.r_[x, few] for x in (a, b)]  # a second pair behind it
        sizes, begins = [np.array([len(x), len(few)]) for x in (a, b)], [np.array([k, 0]) for k in (i, j)]
        column = lambda f: np.array([f(p) for p in places])
        given = sizes, begins, np.zeros(3, np.int64), column(lambda p: p["shift"] + i - j), column(lambda p: p["c"] + i), 12, 0.8
        whole = substring_dedup.may_meet(values, *given)
        may = substring_dedup.may_meet([(x >> np.uint64(48)).astype(np.uint16) for x in values], *given)
        assert may[0] >= whole[0] >= found and not may[1]
        met, out = met + found, out + (not may[0])
    assert 50 < met < 250 and out > 30
    empty = np.zeros(0, np.int64)
    assert not len(substring_dedup.may_meet([empty.astype(np.uint16)] * 2, [empty] * 2, [empty] * 2, empty, empty, empty, 12, 0.8))


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    out = set()
    while found.hasNext():
        out.add(found.next().getName())
    return {x for x in out if x.startswith("shuffle_")}


def test_shingles_stay_and_shuffles_go(spark, monkeypatch):
    """Shingles are stored once and not moved whole, and no step leaves shuffle files for the next ones."""
    rng, rows, seen, left = random.Random(11), [], [], []
    for i in range(12):
        passage = words(rng, 60)
        rows += [(2 * i, text(words(rng, 40), passage, words(rng, 40))), (2 * i + 1, text(words(rng, 40), passage, words(rng, 40)))]
    before = shuffle_files(spark)

    def stored(df, name, real=substring_dedup.stored):
        out = real(df, name)
        seen.extend([name] * ("seq" in out.columns))
        end = time.time() + 10
        while (now := shuffle_files(spark) - before) and time.time() < end:
            time.sleep(0.1)
        left.extend(now)
        return out

    monkeypatch.setattr(substring_dedup, "stored", stored)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(setting, "false")
    links = substring_dedup.passage_links(spark.createDataFrame(rows, "doc_id long, text string"))
    assert spark.conf.get(setting) == "false"
    spark.conf.unset(setting)
    assert seen == ["passage-regions"] and not left
    assert {tuple(sorted(x)) for x in links.collect()} == {(2 * i, 2 * i + 1) for i in range(12)}
