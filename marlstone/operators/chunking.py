"""Sections and chunks of documents. A document's lines, sections and chunks stay in one row until they are numbered,
so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.strings import let, strip

# --- fixed values: sizes and the form of headings ---
CHUNK_SIZE, OVERLAP, HEADING_LIMIT, CHUNKS_A_PAGE, WINDOW = 250, 30, 150, 3, 10_000
NUMBERED = r"(?dU)^(\d+(?:\.\d+)*)\s+(.+)$"
NUMBERED_DOTTED = r"(?dU)^(\d+(?:\.\d+)*)\.?\s+(.+)$"
# --- end of fixed values ---


def sections(text: Column, dotted_headers: bool = False) -> Column:
    """array<struct<number, name, content>>: content is the section's lines joined, blank sections included.

    Headings are lines such as '3.1 Scope' and '## Scope' of under 150 characters; a section without any line is not
    there; the part before the first heading is '0', 'Preamble'. A markdown heading's number is one more than the
    number of sections before it. A text in which no section has a line is one section '1', 'Document Content'.
    """
    pattern = NUMBERED_DOTTED if dotted_headers else NUMBERED

    def heading(h: Column) -> Column:
        number = F.nullif(F.regexp_extract(h["line"], pattern, 1), F.lit(""))
        named = lambda n: F.struct(h["at"].alias("at"), n.alias("number"), F.when(n.isNotNull(), F.concat(n, F.lit(" "), F.regexp_extract(h["line"], pattern, 2))).when(h["line"].startswith("#"), strip(F.ltrim(h["line"], F.lit("#")))).alias("name"))
        return let(number, named)

    def made(parts: Column) -> Column:
        # most lines are no headings by their length or first character, without a pattern
        short = F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("at"), strip(x).alias("line"))), lambda h: (F.length(h["line"]) < HEADING_LIMIT) & h["line"].rlike(r"^[#\p{Nd}]"))
        return let(F.filter(F.transform(short, heading), lambda h: h["name"].isNotNull()), lambda heads: between(parts, heads))

    def between(parts: Column, heads: Column) -> Column:
        first = F.struct(F.lit(-1).alias("at"), F.lit("0").alias("number"), F.lit("Preamble").alias("name"))
        ends = F.concat(F.transform(heads, lambda h: h["at"]), F.array(F.size(parts)))
        spans = F.zip_with(F.concat(F.array(first), heads), ends, lambda s, e: F.struct(s["number"].alias("number"), s["name"].alias("name"), (s["at"] + 1).alias("from"), (e - s["at"] - 1).alias("n")))
        kept = F.filter(spans, lambda s: s["n"] > 0)
        content = lambda s: F.array_join(F.slice(parts, s["from"] + 1, s["n"]), "\n")
        rows = F.transform(kept, lambda s, i: F.struct(F.coalesce(s["number"], (i + 1).cast("string")).alias("number"), s["name"].alias("name"), content(s).alias("content")))
        whole = F.array(F.struct(F.lit("1").alias("number"), F.lit("Document Content").alias("name"), F.array_join(parts, "\n").alias("content")))
        return let(rows, lambda r: F.when(F.size(r) == 0, whole).otherwise(r))

    return F.when(text.isNotNull(), let(F.split(text, "\n"), made))


def overlap_tail(text: Column, overlap: int = OVERLAP) -> Column:
    """What the next chunk repeats: the last characters, from their first sentence's end if that is not near an edge."""
    def cut(tail: Column) -> Column:
        at = F.instr(tail, ". ")
        return F.when((at > 1) & (at < F.length(tail) - 9), F.substr(tail, at + 2)).otherwise(tail)

    return F.when(F.length(text) <= overlap, text).otherwise(let(F.substring(text, -overlap, overlap), cut))


def pack_paragraphs(name: Column, content: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """The chunks of one section, its name above each: paragraphs are added while they fit; one is never cut."""
    paragraphs = lambda body: F.filter(F.transform(F.split(body, "\n\n"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        longer = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        flush = (F.length(longer) > size) & (acc["cur"] != "")
        fresh = let(overlap_tail(acc["cur"], overlap), lambda tail: F.when(tail == "", p).otherwise(F.concat(tail, F.lit("\n\n"), p)))
        return F.struct(F.when(flush, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"), F.when(flush, fresh).otherwise(longer).alias("cur"))

    packed = lambda body: F.aggregate(paragraphs(body), start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))
    bodies = let(strip(content), lambda body: F.when(F.length(body) <= size, F.array(body)).otherwise(packed(body)))
    return F.transform(bodies, lambda b: F.concat(name, F.lit("\n\n"), b))


def chunks(df: DataFrame, doc_id: str = "doc_id", doc_name: str = "doc_name", doc_type: str = "doc_type", text: str = "text", size: int = CHUNK_SIZE, overlap: int = OVERLAP, dotted_headers: bool = False) -> DataFrame:
    """The chunks of all documents: id, text, doc_id, doc_name, doc_type, section_name, section_number, page_number,
    chunk_index (from 0 over the document) and file_path. Blank documents and sections have none."""
    made = F.filter(sections(F.col(text), dotted_headers), lambda s: strip(s["content"]) != "")
    flat = F.flatten(F.transform(made, lambda s: F.transform(pack_paragraphs(s["name"], s["content"], size, overlap), lambda t: F.struct(s["number"].alias("number"), s["name"].alias("name"), t.alias("text")))))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(doc_name).alias("doc_name"), F.col(doc_type).alias("doc_type"), F.posexplode(flat).alias("chunk_index", "c"))
    return rows.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("id"),
        F.col("c.text").alias("text"), "doc_id", "doc_name", "doc_type", F.col("c.name").alias("section_name"), F.col("c.number").alias("section_number"), page_of(F.col("chunk_index")).alias("page_number"), "chunk_index", F.concat(F.lit("inputs/"), "doc_name").alias("file_path"),
    )


def page_of(chunk_index: Column) -> Column:
    return (F.floor(chunk_index / CHUNKS_A_PAGE) + 1).cast("int")


def windows_of(text: str, size: int = WINDOW) -> list[str]:
    """Windows of at most size that end at the last full stop in them; joined, they are the text."""
    out, at = [], 0
    while at < len(text) or not out:
        end = min(at + size, len(text))
        if end < len(text):
            stop = text.rfind(".", at, end)
            end = stop + 1 if stop > at else end
        out.append(text[at:end])
        at = end
    return out


def sentence_windows(df: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """(key, window_no, window): short texts stay on the JVM side, only longer ones go to Python. Null texts have none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, w) for k, t in zip(b[key], b[text]) for i, w in enumerate(windows_of(t, size))]
            yield pd.DataFrame(rows, columns=[key, "window_no", "window"])

    short = df.filter(F.length(text) <= size).select(key, F.lit(0).alias("window_no"), F.col(text).alias("window"))
    return short.unionByName(df.filter(F.length(text) > size).select(key, text).mapInPandas(run, f"`{key}` {kind}, window_no int, window string"))
