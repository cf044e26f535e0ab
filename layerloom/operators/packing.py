"""Token-budget batches.

Batching is greedy and depends on order, so a group's rows are streamed through one task in order: only a group, an
order key and a token count per row, never the group as a whole. A fold keeps three numbers and the open batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerloom.functions.tokens import effective_tokens
from layerloom.operators.scan import nearest_parents

BUDGET, MIN_TOKENS = 8000, 1000


def greedy_batches(rows: DataFrame, group: list[str], order: list[str], tokens: str, budget: int = BUDGET) -> DataFrame:
    """rows with batch_idx: within a group, in order, a row opens a new batch where the open one would pass the budget."""
    schema = T.StructType([*rows.schema.fields, T.StructField("batch_idx", T.LongType())])
    cols = rows.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, idx, used = object(), 0, 0
        for pdf in batches:
            out = []
            for row in pdf[[*group, tokens]].itertuples(index=False):
                key, t = tuple(row[:-1]), int(row[-1])
                if key != last:
                    last, idx, used = key, 0, 0
                elif used and used + t > budget:
                    idx, used = idx + 1, 0
                used += t
                out.append(idx)
            yield pdf.assign(batch_idx=out)[[*cols, "batch_idx"]]

    return rows.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, *order).mapInPandas(fold, schema)


def line_chunks(entries: DataFrame, budget: int, chars_per_token: float = 1.5) -> DataFrame:
    """(key, chunk, content): texts above the budget cut at line ends, lines of len+1 characters until one would pass it."""
    most = int(budget * chars_per_token)
    lines = F.split("content", "\n", -1)
    folded = F.aggregate(
        lines,
        F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("used")),
        lambda acc, x: F.when(
            (F.size(acc["open"]) > 0) & (acc["used"] + F.length(x) + 1 > most),
            F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), F.array(x).alias("open"), (F.length(x) + 1).alias("used")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.array_append(acc["open"], x).alias("open"), (acc["used"] + F.length(x) + 1).alias("used"))),
        lambda acc: F.array_append(acc["done"], acc["open"]),
    )
    made = entries.select("key", F.posexplode(folded).alias("chunk", "_lines"))
    return made.select("key", "chunk", F.array_join("_lines", "\n").alias("content"))


def merge_small(batches: DataFrame, group: list[str], min_tokens: int = MIN_TOKENS, budget: int = BUDGET) -> DataFrame:
    """(group..., batch_idx, merged_idx, merged_tokens, owner_idx): batches below min_tokens joined to neighbours, left to right.

    A small batch goes into the one before it if both fit the budget, else into the one after it, which is then looked
    at again; merged_idx numbers what is left, owner_idx is the batch that took the others in. Only the open neighbour
    is kept while a group streams by.
    """
    names = [*group, "batch_idx", "merged_idx", "merged_tokens", "owner_idx"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in batches.select(*group).schema.fields] + [f"{n} long" for n in names[len(group) :]])

    def fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = object()
        before: tuple | None = None  # the batch that a small one may join: its members, tokens and owner
        held: tuple = ([], 0, 0)  # the batch that is being looked at
        idx, rows = 0, []

        def settle(key: tuple, batch: tuple) -> None:
            nonlocal idx
            members, total, owner = batch
            rows.extend((*key, m, idx, total, owner) for m in members)
            idx += 1

        def close(key: tuple) -> None:
            if before and held[1] < min_tokens and before[1] + held[1] <= budget:
                settle(key, (before[0] + held[0], before[1] + held[1], before[2]))
                return
            if before:
                settle(key, before)
            settle(key, held)

        for pdf in pdfs:
            for row in pdf[[*group, "batch_idx", "tokens"]].itertuples(index=False):
                key, b, t = tuple(row[:-2]), int(row[-2]), int(row[-1])
                if key != last:
                    if held[0]:
                        close(last)
                    last, before, held, idx = key, None, ([b], t, b), 0
                    continue
                members, total, _ = held
                if total < min_tokens and before and before[1] + total <= budget:
                    before, held = (before[0] + members, before[1] + total, before[2]), ([b], t, b)
                elif total < min_tokens and t + total <= budget:
                    held = (members + [b], total + t, b)
                else:
                    if before:
                        settle(key, before)
                    before, held = held, ([b], t, b)
            if len(rows) > 4096:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if held[0]:
            close(last)
        yield pd.DataFrame(rows, columns=names)

    own = batches.select(*group, "batch_idx", "tokens")
    return own.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, "batch_idx").mapInPandas(fold, schema)


def affinity_groups(entries: DataFrame) -> DataFrame:
    """(component, dir, group_key, group_order): directories grouped under the nearest directory above them that holds
    entries too. A directory that others are grouped under is in its own group only, so nothing is packed twice."""
    dirs = entries.select("component", "dir").distinct()
    near = nearest_parents(dirs)
    heads = near.where("parent_dir <> dir").select("component", F.col("parent_dir").alias("dir")).distinct().withColumn("_head", F.lit(True))
    named = near.join(heads, ["component", "dir"], "left").withColumn("group_key", F.when(F.col("_head"), F.col("dir")).otherwise(F.col("parent_dir")))
    # a group's place is that of the first directory, in sorted order, that is put into it
    first = near.groupBy("component", F.col("parent_dir").alias("group_key")).agg(F.min("dir").alias("group_order"))
    return named.join(first, ["component", "group_key"]).select("component", "dir", "group_key", "group_order")


def _units(entries: DataFrame, budget: int, chars_per_token: float) -> DataFrame:
    """Rows in packing order: component, group_key, ord (group, directory, size, key, chunk), dir, entry_key, content, tokens, dir_tokens, mode.

    mode says how a row opens batches: whole (all of its group is one batch), dir (directory by directory), file, chunk."""
    sized = entries.withColumn("dir", F.when(F.coalesce("dir", F.lit("")) == "", ".").otherwise(F.col("dir")))
    sized = sized.withColumn("tokens", effective_tokens(F.coalesce("tokens", F.lit(1)), F.col("content"), chars_per_token))
    per_dir = sized.groupBy("component", "dir").agg(F.sum("tokens").alias("dir_tokens"))
    grouped = per_dir.join(affinity_groups(sized), ["component", "dir"])
    per_group = grouped.groupBy("component", "group_key").agg(F.sum("dir_tokens").alias("group_tokens"))
    totals = per_dir.groupBy("component").agg(F.sum("dir_tokens").alias("total"))
    plan = grouped.join(per_group, ["component", "group_key"]).join(totals, "component")
    whole = F.col("total") <= budget
    plan = plan.select(
        "component", "dir", F.when(whole, F.regexp_replace("component", r"[/\\]", "_")).otherwise(F.col("group_key")).alias("group_key"), F.when(whole, "").otherwise(F.col("group_order")).alias("group_order"),
        "dir_tokens", F.when(whole | (F.col("group_tokens") <= budget), "whole").when(F.col("dir_tokens") <= budget, "dir").otherwise("file").alias("mode"),
    )
    rows = sized.join(plan, ["component", "dir"])
    cut = (F.col("mode") == "file") & (F.col("tokens") > budget) & F.contains("content", F.lit("\n"))
    pieces = line_chunks(rows.where(cut).select(F.struct("component", "entry_key").alias("key"), "content"), budget, chars_per_token)
    chunks = pieces.select("key.component", "key.entry_key", "chunk", F.col("content").alias("_piece")).join(rows.where(cut).drop("content"), ["component", "entry_key"])
    chunks = chunks.withColumn("content", F.col("_piece")).withColumn("size_order", -F.col("tokens")).withColumn("tokens", effective_tokens(F.lit(1), F.col("_piece"), chars_per_token)).withColumn("mode", F.lit("chunk"))
    chunks = chunks.withColumn("unit_key", F.concat("entry_key", F.lit("^^chunk_"), F.col("chunk").cast("string")))
    plain = rows.where(~cut).withColumn("chunk", F.lit(0)).withColumn("unit_key", F.col("entry_key")).withColumn("size_order", F.when(F.col("mode") == "file", -F.col("tokens")).otherwise(F.lit(0)))
    plain = plain.withColumn("mode", F.when((F.col("mode") == "file") & (F.col("tokens") > budget), "chunk").otherwise(F.col("mode")))
    columns = ["component", "group_key", "group_order", "dir", "size_order", "entry_key", "chunk", "unit_key", "tokens", "dir_tokens", "mode", "content"]
    return plain.select(*columns).unionByName(chunks.select(*columns))


def pack_components(entries: DataFrame, budget: int = BUDGET, min_tokens: int = MIN_TOKENS, chars_per_token: float = 1.5) -> DataFrame:
    """(component, batch_idx, pos, group_key, entry_key, tokens, content): the entries of each component in batches.

    entries: component, entry_key, dir, content, tokens. A component within the budget is one batch. Otherwise related
    directories form groups; a group within the budget is one batch, a larger one is packed directory by directory, a
    directory beyond the budget file by file (largest first), and a file beyond it in chunks of lines. Batches that
    stay small are merged with their neighbours at the end. Every batch names its entries, so nothing gets lost.

    Contents are not part of the ordered fold: it carries keys and counts, and contents are joined at the end.
    """
    units = _units(entries, budget, chars_per_token)
    light = units.drop("content")
    order = ["component", "group_order", "group_key", "dir", "size_order", "entry_key", "chunk"]
    cols = light.columns
    schema = T.StructType([*light.schema.fields, T.StructField("first_idx", T.LongType()), T.StructField("pos", T.LongType())])

    def fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, group, place, mode, idx, used, pos = None, None, None, None, -1, 0, 0
        for pdf in pdfs:
            out, at = [], []
            for r in pdf[["component", "group_key", "dir", "mode", "tokens", "dir_tokens"]].itertuples(index=False):
                if r.component != component:
                    component, group, place, mode, idx, used, pos = r.component, None, None, None, -1, 0, 0
                new_group = r.group_key != group
                new_dir = new_group or r.dir != place
                weight = r.dir_tokens if r.mode == "dir" else r.tokens
                if new_group or "chunk" in (r.mode, mode):
                    opens = True
                elif r.mode == "whole":
                    opens = False
                elif r.mode == "dir":
                    opens = new_dir and (mode == "file" or used + weight > budget)
                else:
                    opens = new_dir or used + weight > budget
                if opens:
                    idx, used = idx + 1, 0
                if r.mode != "dir" or new_dir:
                    used += weight
                out.append(idx)
                at.append(pos)
                pos += 1
                group, place, mode = r.group_key, r.dir, r.mode
            yield pdf.assign(first_idx=out, pos=at)[[*cols, "first_idx", "pos"]]

    placed = light.repartition(F.col("component")).sortWithinPartitions(*order).mapInPandas(fold, schema)
    batches = placed.groupBy("component", F.col("first_idx").alias("batch_idx")).agg(F.sum("tokens").alias("tokens"), F.min("group_key").alias("group_key"))
    moved = merge_small(batches.select("component", "batch_idx", "tokens"), ["component"], min_tokens, budget)
    owners = batches.select("component", F.col("batch_idx").alias("owner_idx"), F.col("group_key").alias("_owner_key"))
    named = moved.join(owners, ["component", "owner_idx"]).select("component", F.col("batch_idx").alias("first_idx"), F.col("merged_idx").alias("batch_idx"), "_owner_key")
    out = placed.join(named, ["component", "first_idx"]).select("component", "batch_idx", "pos", F.col("_owner_key").alias("group_key"), F.col("unit_key").alias("entry_key"), "tokens", F.col("entry_key").alias("_e"), "chunk")
    texts = units.select("component", F.col("entry_key").alias("_e"), "chunk", "content")
    return out.join(texts, ["component", "_e", "chunk"]).drop("_e", "chunk")


def aggregation_groups(batches: DataFrame, component: str = "component") -> DataFrame:
    """(component, group_key, batch_indices): group keys that more than one batch has."""
    found = batches.where("group_key <> ''").groupBy(component, "group_key").agg(F.array_sort(F.collect_list("batch_idx")).alias("batch_indices"))
    return found.where(F.size("batch_indices") > 1)
