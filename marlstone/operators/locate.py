"""Where a violation stands in its file, and how it is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword(message: Column) -> Column:
    """The first quoted term of a message, else an empty one."""
    return F.coalesce(F.regexp_extract(message, "'([^']+)'", 1), F.lit(""))


def escaped(term: Column) -> Column:
    """A term as a literal within a pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))


def locate(code: Column, term: Column) -> Column:
    """struct(line, col), from 0: a class of that name, else a function, else an assignment at a line's start, else the
    first line that holds the term outside a comment; (0, 0) if there is none or the term is empty."""
    k = escaped(term)
    parts = F.transform(F.split(code, "\r\n|\n|\r"), lambda x, i: F.struct(i.alias("line"), x.alias("text")))

    def at(pattern: Column) -> Column:
        hit = F.get(F.filter(parts, lambda x: F.regexp(x["text"], pattern)), F.lit(0))
        return F.when(hit.isNotNull(), F.struct(hit["line"].alias("line"), (F.position(term, hit["text"]) - 1).alias("col")))

    bare = F.filter(parts, lambda x: ~F.ltrim(x["text"]).startswith("#") & F.contains(F.split(x["text"], "#")[0], term))
    first = F.get(bare, F.lit(0))
    plain = F.when(first.isNotNull(), F.struct(first["line"].alias("line"), (F.position(term, first["text"]) - 1).alias("col")))
    none = F.struct(F.lit(0).alias("line"), F.lit(0).alias("col"))
    found = F.coalesce(at(F.concat(F.lit(r"class\s+"), k, F.lit(r"\b"))), at(F.concat(F.lit(r"def\s+"), k, F.lit(r"\b"))), at(F.concat(F.lit(r"^\s*"), k, F.lit(r"\s*="))), plain, none)
    return F.when(F.coalesce(term, F.lit("")) == "", none).otherwise(found)


def diagnostic(message: Column, suggestion: Column, sections: Column) -> Column:
    """Message, suggestion and numbered sections, a line each; null parts are left out."""
    listed = F.array_join(F.transform(sections, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s)), "\n")
    return F.concat_ws("\n", message, suggestion, F.nullif(listed, F.lit("")))


def last_by_line(df: DataFrame, order: str) -> DataFrame:
    """(uri, line, sources): of several on one line, the last."""
    return df.groupBy("uri", "line").agg(F.max_by("sources", order).alias("sources"))


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Rows whose uri does not start with prefix: longer uris go too."""
    return df.filter(~F.col("uri").startswith(prefix) | F.col("uri").isNull())


def actions(df: DataFrame) -> DataFrame:
    """One row for each source's section: title '[i] View Source: section', the first preferred."""
    rest = [c for c in df.columns if c != "sections"]
    return df.select(*rest, F.posexplode("sections").alias("i", "section")).select(*rest, "i", F.concat(F.lit("["), (F.col("i") + 1).cast("string"), F.lit("] View Source: "), "section").alias("title"), (F.col("i") == 0).alias("preferred"))


def first_line_of(document: Column, section: Column) -> Column:
    """The line, from 0, at which a section's text first stands in a document; 0 if it does not."""
    at = F.position(section, document)
    return F.when(at > 0, F.size(F.split(F.left(document, at - 1), "\n")) - 1).otherwise(0)
