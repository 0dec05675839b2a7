"""String helpers as Column expressions, with Unicode-aware white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that Python's str.strip removes.
SPACE = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(c, F.lit(SPACE))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it: higher-order functions do not share expressions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_blank(c: Column) -> Column:
    """True for null and for text without a visible character."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def letters_digits(c: Column) -> Column:
    """Lower case, letters and digits only: the key under which spellings of a name are equal."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def folded(c: Column) -> Column:
    """Without case and outer spaces."""
    return F.lower(strip(c))
