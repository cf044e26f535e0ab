"""Packing of whole components against a plain version."""

import random

from layerloom.operators import packing


def near(dirs):
    """Directory to its nearest ancestor in the set (itself without one)."""
    out = {}
    for d in dirs:
        ups = [d.rsplit("/", k)[0] for k in range(1, d.count("/") + 1)]
        out[d] = next((u for u in ups if u in dirs), d)
    return out


def packed(entries, budget, least, cpt):
    """entries: {key: (dir, content)}; batches as lists of keys with their group."""
    size = lambda text: max(1, int(len(text) / cpt))
    weight = {}
    for d, text in entries.values():
        weight[d] = weight.get(d, 0) + size(text)
    if sum(weight.values()) <= budget:
        return [(sorted(entries), "c")]
    up = near(set(weight))
    groups = {}
    for d in sorted(weight):
        groups.setdefault(up[d], [])
    for d in sorted(weight):
        groups[d if d in groups else up[d]].append(d)
    batches = []
    for group, dirs in groups.items():
        if sum(weight[d] for d in dirs) <= budget:
            batches.append([[k for k, (d, _) in entries.items() if d in dirs], sum(weight[d] for d in dirs), group])
            continue
        now, used = [], 0

        def flush(now=None, used=0, group=group):
            if now:
                batches.append([now, used, group])

        for d in dirs:
            own = [(k, t) for k, (x, t) in entries.items() if x == d]
            if weight[d] <= budget:
                if now and used + weight[d] > budget:
                    flush(now, used)
                    now, used = [], 0
                now, used = now + [k for k, _ in own], used + weight[d]
                continue
            flush(now, used)
            now, used = [], 0
            for k, t in sorted(own, key=lambda x: (-size(x[1]), x[0])):
                if size(t) > budget:
                    flush(now, used)
                    now, used = [], 0
                    parts, length = [[]], 0
                    for line in t.split("\n"):
                        if parts[-1] and length + len(line) + 1 > int(budget * cpt):
                            parts.append([])
                            length = 0
                        parts[-1].append(line)
                        length += len(line) + 1
                    for i, p in enumerate(parts):
                        batches.append([[k if "\n" not in t else f"{k}^^chunk_{i}"], size("\n".join(p)), group])
                    continue
                if now and used + size(t) > budget:
                    flush(now, used)
                    now, used = [], 0
                now, used = now + [k], used + size(t)
            flush(now, used)
            now, used = [], 0
        flush(now, used)
    i = 0
    while i < len(batches):
        if batches[i][1] < least and len(batches) > 1:
            if i and batches[i - 1][1] + batches[i][1] <= budget:
                b = batches.pop(i)
                batches[i - 1] = [batches[i - 1][0] + b[0], batches[i - 1][1] + b[1], batches[i - 1][2]]
                continue
            if i + 1 < len(batches) and batches[i + 1][1] + batches[i][1] <= budget:
                b = batches.pop(i)
                batches[i] = [b[0] + batches[i][0], b[1] + batches[i][1], batches[i][2]]
                continue
        i += 1
    return [(sorted(b[0]), b[2]) for b in batches]


def test_pack_components(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for c in range(60):
        dirs = rng.sample(["core", "core/a", "core/a/b", "x/y", "x", "z", "core-b", "."], rng.randrange(1, 6))
        entries = {}
        for i in range(rng.randrange(1, 14)):
            lines = [("w" * rng.randrange(0, 12)) for _ in range(rng.choice([1, 1, 2, 3, 9]))]
            entries[f"f{i:02}"] = (rng.choice(dirs), "\n".join(lines))
        rows += [(f"c{c}", k, "" if d == "." else d, t, 1) for k, (d, t) in entries.items()]
        want[f"c{c}"] = packed(entries, 20, 6, 1.5)
        if len(want[f"c{c}"]) == 1 and want[f"c{c}"][0][1] == "c":
            want[f"c{c}"] = [(want[f"c{c}"][0][0], f"c{c}")]
    table = spark.createDataFrame(rows, "component string, entry_key string, dir string, content string, tokens long")
    found = {}
    for r in packing.pack_components(table, 20, 6, 1.5).collect():
        found.setdefault(r.component, {}).setdefault((r.batch_idx, r.group_key), []).append(r.entry_key)
    got = {c: [(sorted(k), g) for (_, g), k in sorted(b.items())] for c, b in found.items()}
    assert got == want
