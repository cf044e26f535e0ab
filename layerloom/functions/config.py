"""Layers of settings: a later layer wins, nested ones are merged key by key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(base: dict, override: dict) -> dict:
    """base with the keys of override; where both hold a mapping, these are merged. Neither is changed."""
    out = dict(base)
    for key, value in override.items():
        both = isinstance(out.get(key), dict) and isinstance(value, dict)
        out[key] = merged(out[key], value) if both else value
    return out


def layered(base: Column, override: Column) -> Column:
    """The same for maps of dotted keys: a value replaces all below its key, a mapping the value at its key."""
    keys = F.map_keys(override)
    below = lambda a, b: F.startswith(a, F.concat(b, F.lit(".")))
    kept = F.map_filter(base, lambda k, _: ~F.exists(keys, lambda o: (o == k) | below(k, o) | below(o, k)))
    return F.map_concat(kept, override)
