"""Token estimates and budgets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARGIN = 0.15
SYSTEM_TOKENS, TEMPLATE_TOKENS = 200, 600
LEAF_MAX, LEAF_MIN = 700, 120


def _floor(x: Column) -> Column:
    return F.floor(x).cast("long")


def quick_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.expr("1") * _floor(F.length(text) / 4)).cast("long")


def tokens(text: Column, chars_per_token: Column | float = 3.0) -> Column:
    """Characters by characters a token, at least 1."""
    return F.greatest(F.lit(1).cast("long"), _floor(F.length(text) / (F.lit(chars_per_token) if isinstance(chars_per_token, float) else chars_per_token)))


def effective_tokens(counted: Column, text: Column, chars_per_token: float = 1.5) -> Column:
    """The larger of a stored count and the estimate by characters."""
    return F.greatest(counted.cast("long"), tokens(text, chars_per_token))


def leaf_limit(n: Column) -> Column:
    """A tenth of the input and 80 more, between 120 and 700."""
    return F.least(F.greatest(_floor(n * 0.10) + 80, F.lit(LEAF_MIN)), F.lit(LEAF_MAX)).cast("long")


def code_budget(context: Column, output: Column) -> Column:
    """What a context leaves for code: its size less the margin, the prompts and the output, at least 400."""
    return F.greatest(F.lit(400), _floor(context * (1 - MARGIN)) - SYSTEM_TOKENS - TEMPLATE_TOKENS - output).cast("long")


def auto_budget(context: Column, most: Column) -> Column:
    """The batch budget where none is set."""
    return F.least(most, F.greatest(F.lit(400), _floor(context * (1 - MARGIN)) - 1100)).cast("long")


def package_limit(components: Column) -> Column:
    """Output tokens of a package overview by its components: 18 each and 180, between 900 and 1600."""
    return F.greatest(F.lit(900), F.least(components * 18 + 180, F.lit(1600))).cast("long")


def retry_delay(attempt: Column) -> Column:
    """Seconds before an attempt is repeated, without jitter: 5 doubled each time, at most 30."""
    return F.least(F.lit(5.0) * F.pow(F.lit(2.0), attempt - 1), F.lit(30.0))


def calibrated(ratios: Column, alpha: float = 0.3) -> Column:
    """The exponential moving average of an ordered array of positive ratios; null for none."""
    return F.aggregate(F.filter(ratios, lambda x: x > 0), F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).otherwise(acc * (1 - alpha) + x * alpha))


def elapsed(seconds: Column) -> Column:
    """'1h 02m 03s' or '2m 03s'."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int")
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).otherwise(F.format_string("%dm %02ds", m, r))


def remaining(done: Column, total: Column, seconds: Column) -> Column:
    """Seconds left if the rest goes as what is done; null before anything is."""
    return F.when(done > 0, (total - done) * seconds / done)


def chars_per_token(calibrated: Column, configured: Column) -> Column:
    """The calibrated figure where there is one, else the configured one."""
    return F.coalesce(calibrated, configured)


def elapsed_tenths(seconds: Column) -> Column:
    """Seconds to one place, halves to the even digit."""
    return F.bround(seconds, 1)
