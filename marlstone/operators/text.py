"""Cleaning of documents as Column expressions: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.strings import let, strip

# --- fixed values: what starts a list of references, and lines of no content ---
REFERENCE_HEADS = ("references", "bibliography", "kaynakça")
PAGE_LINE = r"(?iU)^\s*\d+\s*$|^\s*page\s*\d+\s*$"
CONTENTS_LINE = r"(?U)\.{4,}\s*\d+"
# --- end of fixed values ---


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def before_references(parts: Column, heads: tuple[str, ...] = REFERENCE_HEADS) -> Column:
    """The lines strictly before the first that starts with one of heads, without case and outer space."""
    starts = F.transform(parts, lambda x: F.lower(strip(x)).rlike("^(" + "|".join(heads) + ")"))
    at = F.array_position(starts, True)
    return let(at, lambda n: F.when(n > 0, F.slice(parts, F.lit(1), (n - 1).cast("int"))).otherwise(parts))


def content_lines(parts: Column) -> Column:
    """Stripped lines without blank, page-number and contents lines."""
    kept = F.filter(F.transform(parts, strip), lambda x: x != "")
    # most lines are told by a cheap test: a contents line has dots in a row
    return F.filter(kept, lambda x: ~(x.rlike(PAGE_LINE)) & ~(F.contains(x, F.lit("....")) & x.rlike(CONTENTS_LINE)))


def clean(text: Column, heads: tuple[str, ...] = REFERENCE_HEADS) -> Column:
    """A document's content: cut at its references, then without blank, page-number and contents lines. Null stays null."""
    return F.array_join(let(lines(text), lambda parts: content_lines(before_references(parts, heads))), "\n")


def blank_documents(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(documents with a visible character, rejected ones: null, empty and blank)."""
    has = F.coalesce(F.length(strip(F.col(text))) > 0, F.lit(False))
    return df.filter(has), df.filter(~has)
