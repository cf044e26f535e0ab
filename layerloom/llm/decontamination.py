"""Benchmark decontamination over a distributed positional inverted index.

The index holds one posting (document row, position, term) for every training token whose term occurs in the
benchmark, stored in the shared folder. A window of an item is ten consecutive words (all words of a shorter item).
The postings of each window's rarest term, moved back by its place in the item, give the alignments at which the item
could stand in a document; the list of the second rarest term, moved back likewise, is intersected with them; only
alignments that are in both are compared word by word, and every run of a window's length or more is a match.

Everything is built of DataFrame functions. Documents are tokenized once and their texts take part in no shuffle; the
joins with benchmark tables are broadcast only while those are counted to be small.

Nulls, edges: null and empty texts have no words, and no hits. Repeated rows and repeated ids are judged row by row;
repeated items count once for each distinct id (a null id is written as an empty string). An empty benchmark finds
nothing. Extra columns of either table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerloom.llm.common import let, release, small, stored, unused

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_ENDS = "".join(chr(i) for i in range(128) if not chr(i).isalnum() or chr(i).isupper())
#: Stands after the last word of every document, so that the index also knows words and documents without any.
_END = "\x00end"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return let(F.btrim(lowered, F.lit(_ENDS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _BETWEEN)))


def item_words(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(iid, item, n, off, word): a row for each word of each item; iid numbers the rows of the benchmark."""
    rows = benchmark.select(F.monotonically_increasing_id().alias("iid"), F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w"))
    return rows.select("iid", "item", F.size("w").alias("n"), F.posexplode("w").alias("off", "word"))


def build_index(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (rid, key, pos, term) of the vocabulary (word, term). Term 0 ends a document; its pos is the number of words."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.concat(words_of(F.col(text)), F.array(F.lit(_END))).alias("w"))
    tokens = rows.select("rid", "key", F.posexplode("w").alias("pos", "word"))
    known = vocabulary.unionByName(vocabulary.sparkSession.createDataFrame([(_END, 0)], "word string, term int"))
    return stored(tokens.join(small(known), "word").select("rid", F.when(F.col("term") == 0, F.col("key")).alias("key"), "pos", "term"), "postings")


def _numbered(items: DataFrame) -> DataFrame:
    """(word, term): the distinct words of the benchmark, numbered from 1."""
    return items.select("word").distinct().select("word", F.row_number().over(Window.orderBy("word")).alias("term"))


def _anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(iid, a, term, b, term_b): for each window its rarest term and the next (b is null in windows of one word)."""
    frame = Window.partitionBy("iid").orderBy("off").rowsBetween(0, window - 1)
    ranked = items.join(small(counts), "term", "left").select("iid", "n", "off", F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "off", "term")).over(frame)).alias("r"))
    full = ranked.where(F.col("off") + F.least("n", F.lit(window)) <= F.col("n"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return full.select("iid", first["off"].alias("a"), first["term"].alias("term"), second["off"].alias("b"), second["term"].alias("term_b")).distinct()


def _alignments(index: DataFrame, anchors: DataFrame, slack: int = 0) -> DataFrame:
    """Distinct (rid, iid, diag): where the rarest term stands at diag + a and the next at diag + b (give or take slack)."""
    at = index.join(small(anchors), "term").select("rid", "iid", (F.col("pos") - F.col("a")).alias("diag"), "b", "term_b")
    alone = at.where("b IS NULL").select("rid", "iid", "diag")
    lists = index.join(small(anchors.where("b IS NOT NULL").select(F.col("term_b").alias("term")).distinct()), "term", "left_semi").select("rid", "pos", F.col("term").alias("term_b"))
    due = at.where("b IS NOT NULL")
    if slack:
        due = due.select("rid", "iid", "diag", "term_b", F.explode(F.sequence(F.col("diag") + F.col("b") - slack, F.col("diag") + F.col("b") + slack)).alias("pos"))
    else:
        due = due.select("rid", "iid", "diag", "term_b", (F.col("diag") + F.col("b")).alias("pos"))
    return due.join(lists, ["rid", "pos", "term_b"], "left_semi").select("rid", "iid", "diag").unionByName(alone).distinct()


def phrase_matches(index: DataFrame, items: DataFrame, anchors: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, iid, item, start, end): document positions, end included, that hold a window's length or more of the item."""
    found = stored(_alignments(index, anchors), "alignments")
    due = found.join(small(items), "iid").select("rid", "iid", "item", "diag", "n", "off", (F.col("diag") + F.col("off")).alias("pos"), "term").where("pos >= 0")
    near = index.where("term > 0").join(small(found.select("rid").distinct()), "rid", "left_semi").select("rid", "pos", "term")
    same = due.join(near, ["rid", "pos", "term"], "left_semi")
    line = ["rid", "iid", "diag"]
    islands = same.withColumn("run", F.col("off") - F.row_number().over(Window.partitionBy(*line).orderBy("off")))
    runs = islands.groupBy(*line, "item", "n", "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    return runs.where(F.col("end") - F.col("start") + 1 >= F.least("n", F.lit(window))).select("rid", "iid", "item", "start", "end")


def proximity_matches(index: DataFrame, anchors: DataFrame, slack: int = 3) -> DataFrame:
    """(rid, iid, diag): where the two rarest terms of a window stand within slack words of their distance in the item."""
    return _alignments(index, anchors.where("b IS NOT NULL"), slack)


def prepared(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, items, anchors) of two tables."""
    raw = stored(item_words(benchmark, item, item_text), "items")
    vocabulary = stored(_numbered(raw), "vocabulary")
    items = stored(raw.join(small(vocabulary), "word").select("iid", "item", "n", "off", "term"), "item-terms")
    index = build_index(docs, vocabulary, key, text)
    counts = index.where("term > 0").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    anchors = stored(_anchors(items, stored(counts, "term-counts"), window), "anchors")
    release(raw)
    return index, items, anchors


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each row of docs: key, n_words, n_hit, items (sorted strings), n_items, contaminated."""
    index, items, anchors = prepared(docs, benchmark, key, text, item, item_text, window)
    hits = stored(phrase_matches(index, items, anchors, window), "phrases")
    positions = hits.select("rid", F.explode(F.sequence("start", "end")).alias("pos")).distinct().groupBy("rid").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_row = stored(positions.join(named, "rid"), "contaminated-rows")
    ends = index.where("term = 0").select("rid", F.col("key").alias(key), F.col("pos").cast("long").alias("n_words"))
    out = ends.join(small(per_row), "rid", "left").drop("rid")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), items_.alias("items"), F.size(items_).cast("long").alias("n_items"), F.col("n_hit").isNotNull().alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the contaminated rows. A row's own text decides, so keys may be null or repeat with other texts."""
    texts = docs.select(F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    found = contamination(texts, benchmark, "th", "text", **options).where("contaminated").select(F.col("th").alias(unused(docs, "th"))).distinct()
    gone = stored(found, "contaminated")
    return docs.join(small(gone), F.xxhash64(F.col(text)) == F.col(gone.columns[0]), "left_anti")
