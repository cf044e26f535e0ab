"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once per document. Its failure sets one bit of ``failure_bits`` and the numbers behind it stay
beside it, so that a policy (a named, versioned mask) is applied later without reading a text again, and the effect of
dropping a rule is a bitwise aggregation over the ledger. Everything here is built of DataFrame functions; no row
leaves the JVM and nothing is shuffled until an ablation report groups the distinct masks.

Nulls, edges: a null text has no words and fails ``few_words``. Texts of any length are evaluated whole. Repeated rows
are judged one by one. Extra columns are kept by ``ledger``; a column that already has the name of a ledger column is
replaced by the ledger's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerloom.llm.common import let, words

#: Name and bit of every rule. Bits are never reused, so old ledgers stay readable.
RULES = (
    "few_words",
    "repeated_windows",
    "word_length",
    "symbols",
    "duplicate_lines",
    "shouting",
    "table_rows",
    "few_alphabetic",
)
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Versioned policies: a document is kept if none of these bits is set.
POLICIES = {
    "base-1": BASE,
    "web-1": BASE | BIT["word_length"] | BIT["symbols"] | BIT["duplicate_lines"],
    "web-2": BASE | BIT["word_length"] | BIT["symbols"] | BIT["duplicate_lines"] | BIT["shouting"] | BIT["table_rows"] | BIT["few_alphabetic"],
}
POLICY = "web-2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_bars", "n_alpha_words")


def _repeat_words(w: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    Distinct hashes prove that no window repeats, which settles most texts; only the others are sorted, by the windows
    themselves, so the count is exact and takes n log n steps in a text of n words.
    """
    n = F.size(w)

    def gram(i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
        places = F.sort_array(F.transform(F.filter(s, lambda x, j: ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))) | same(x, j + 1)), lambda x: x["p"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end")),
            lambda acc: acc["n"],
        )

    steps = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(steps, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    exact = let(F.sort_array(F.transform(steps, lambda i: F.struct(gram(i).alias("g"), i.alias("p")))), covered)
    return F.when(n < 3, F.lit(0)).when(F.size(F.array_distinct(hashes)) == n - 2, F.lit(0)).otherwise(exact)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one long column for each measure and ``failure_bits`` (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    out = docs.withColumn(
        "_w",
        let(
            words(F.col(text)),
            lambda w: F.struct(
                F.size(w).alias("n_words"),
                F.length(F.array_join(w, "")).alias("word_chars"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: (F.length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x))).alias("n_upper_words"),
                F.size(F.filter(w, lambda x: x == "|")).alias("n_bars"),
                F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))).alias("n_alpha_words"),
            ),
        ),
    ).withColumn("_l", let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))))
    out = out.withColumn("n_symbols", F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"))
    for m in MEASURES:
        if m != "n_symbols":
            out = out.withColumn(m, F.col(f"{'_l' if 'lines' in m else '_w'}.{m}").cast("long"))
    n = F.col("n_words")
    fails = {
        "few_words": n < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "symbols": 10 * F.col("n_symbols") > n,
        "duplicate_lines": (F.col("n_lines") >= 4) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        "shouting": 100 * F.col("n_upper_words") > 40 * n,
        "table_rows": 100 * F.col("n_bars") > 15 * n,
        "few_alphabetic": 100 * F.col("n_alpha_words") < 70 * n,
    }
    bits = F.lit(0).cast("long")
    for name, failed in fails.items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("failure_bits", bits).drop("_w", "_l")


def passes(policy: str = POLICY, bits: str = "failure_bits") -> Column:
    """True where a ledger row fails no rule of the policy."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policy(docs: DataFrame, policy: str = POLICY, text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs."""
    return ledger(docs, text).where(passes(policy)).select(*docs.columns)


def ablations(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents rejected for it alone (regained if it is dropped).

    The ledger is first grouped by mask, of which there are at most 2**len(RULES), so the report costs one small shuffle.
    """
    mask = POLICIES[policy]
    masks = entries.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    named = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in RULES if BIT[r] & mask])
    return (
        masks.withColumn("r", F.explode(named))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_this_rule"),
            F.bit_or("bits").alias("seen_bits"),
        )
        .withColumn("policy", F.lit(policy))
    )
