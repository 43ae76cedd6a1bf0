"""Derived values: packaging numbers and sizes, surrogate keys, labels and defaults."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from partgraph.functions.casts import round2
from partgraph.model import KEYS

#: Characters after the prefix of a surrogate key.
KEY_WIDTH = 8


def packaging_number(kind: Column, length: Column, width: Column, height: Column) -> Column:
    """``A`` for non-returnable packaging, else ``B``, then the dimensions; null if one is missing."""
    prefix = F.when(kind == "non-returnable", "A ").otherwise("B ")
    sizes = [c.cast("string") for c in (length, width, height)]
    return F.concat(prefix, sizes[0], F.lit("-"), sizes[1], F.lit("-"), sizes[2])


def volume_m3(length: Column, width: Column, height: Column) -> Column:
    return round2((length / 1000.0) * (width / 1000.0) * (height / 1000.0))


def area_m2(length: Column, width: Column) -> Column:
    return round2((length / 1000.0) * (width / 1000.0))


def natural_key(parts: Sequence[Column]) -> Column:
    """One text per key tuple: each part is length-prefixed, so no two tuples share a text."""
    texts = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.concat(*texts)


def surrogate_key(prefix: str, parts: Sequence[Column], width: int = KEY_WIDTH) -> Column:
    """Prefix and ``width`` characters of [A-Za-z0-9], the same for equal natural keys on every run.

    Null when every part is null: such a row names no entity. A character carries just under six
    bits; see :func:`key_width` for tables past some ten million keys.
    """
    digest = F.substring(F.sha2(natural_key(parts), 256), 1, 2 * math.ceil(width * 6 / 8))
    key = F.concat(F.lit(prefix), F.translate(F.substring(F.base64(F.unhex(digest)), 1, width), "+/", "Aa"))
    return F.when(F.coalesce(*parts).isNotNull(), key)


def key_for(column: str, width: int = KEY_WIDTH, **source: str) -> Column:
    """The surrogate key ``column`` of the model, from its natural key columns.

    ``source`` renames natural key columns, e.g. ``PART_NUMBER='PART_NUMBER_BEFORE_CHANGE'``.
    """
    prefix, parts = KEYS[column]
    return surrogate_key(prefix, [F.col(source.get(p, p)) for p in parts], width)


def key_width(expected_keys: int, chance: float = 1e-9) -> int:
    """Width that keeps the chance of any two of ``expected_keys`` keys colliding below ``chance``."""
    bits = 2 * math.log2(max(expected_keys, 2)) - 1 - math.log2(chance)
    return max(KEY_WIDTH, math.ceil(bits / 5.9))


def default_to(col: Column, default: Column) -> Column:
    return F.coalesce(col, default)


def change_label(old: Column, new: Column) -> Column:
    return F.concat(F.lit("Change: "), old, F.lit(" → "), new)
