"""Retrieval over an index of chunks: query texts, summaries, sources for violations, search, statistics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.strings import let, strip
from marlstone.operators.vector import embed, hashed_words, knn

# --- fixed values: how quoted terms and summaries are told, and their sizes ---
QUOTED = r"""['"]([^'"]+)['"]"""
IMPORTANT = r"(?idU)Important:\s*(.+?)(?:\.|$)"
NEVER = r"(?idU)(.{0,50}(?:should|must)\s+NOT.+?)(?:\.|$)"
MUST = r"(?idU)(.{0,30}must.+?)(?:\.|$)"
NO_SUMMARY, SUMMARY_LIMIT, TOP_K = "Source reference", 200, 3
# --- end of fixed values ---


def query_text(message: Column) -> Column:
    """The quoted terms of a message, then the message."""
    return F.array_join(F.concat(F.regexp_extract_all(message, F.lit(QUOTED), F.lit(1)), F.array(message)), " ")


def summary(text: Column) -> Column:
    """The first telling sentence of a chunk below its heading, at most 200 characters."""
    def below(parts: Column) -> Column:
        body = F.when(F.size(parts) > 2, F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1)))).otherwise(parts)
        return let(body, first)

    def first(body: Column) -> Column:
        plain = F.filter(F.transform(body, strip), lambda x: (F.length(x) > 20) & ~x.rlike(r"^[-*#]"))
        sentence = F.coalesce(F.left(F.get(plain, F.lit(0)), F.lit(SUMMARY_LIMIT)), F.lit(NO_SUMMARY))
        return let(F.array_join(body, "\n"), lambda content: F.coalesce(*telling(content), sentence))

    def telling(content: Column) -> list[Column]:
        # a plain word that the pattern needs is looked for first: the patterns start anywhere
        low = F.lower(content)
        found = lambda word, p: F.when(word, let(F.regexp_extract(content, p, 0), lambda m: F.when(m != "", F.left(strip(F.regexp_extract(m, p, 1)), F.lit(SUMMARY_LIMIT)))))
        must = F.contains(low, F.lit("must"))
        return [found(F.contains(low, F.lit("important:")), IMPORTANT), found((must | F.contains(low, F.lit("should"))) & low.rlike(r"(?:should|must)\s+not"), NEVER), found(must, MUST)]

    return F.when(text.isNotNull(), let(F.split(text, "\n"), below))


def search(queries: DataFrame, index: DataFrame, n: int | None = TOP_K, embedder: Callable[[pd.Series], pd.Series] = hashed_words, where: Column | None = None) -> DataFrame:
    """The n nearest chunks of each query(query_id, query): query_id, rank, item_id, score, relevance and the chunk.

    index has item_id, embedding and the chunk's columns; where filters the index before it is ranked. n of null or 0
    is the default. An empty index gives no rows. relevance is the cosine rounded to three digits.
    """
    rows = index.filter(where) if where is not None else index
    asked = embed(queries, "query", embedder=embedder)
    near = knn(asked, rows, n or TOP_K)
    return near.join(rows.drop("embedding"), "item_id").withColumn("relevance", F.round("score", 3))


def sources(found: DataFrame) -> DataFrame:
    """The rows of a search as sources: document, section, page, summary, file_path, relevance_score, full_text."""
    return found.select(
        "query_id", "rank", F.col("doc_name").alias("document"), F.col("section_name").alias("section"), F.col("page_number").alias("page"),
        summary(F.col("text")).alias("summary"), "file_path", F.col("relevance").alias("relevance_score"), F.col("text").alias("full_text"),
    )


def attach(violations: DataFrame, found: DataFrame, key: str = "query_id") -> DataFrame:
    """violations with sources, an array in order of rank, empty where there are none."""
    columns = [c for c in found.columns if c not in (key, "rank")]
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("_s"))  # at most n each
    both = violations.join(lists, key, "left")
    kept = F.transform("_s", lambda s: F.struct(*[s[c].alias(c) for c in columns]))
    kind = f"array<struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in found.schema.fields if f.name in columns)}>>"
    return both.withColumn("sources", F.coalesce(kept, F.array().cast(kind))).drop("_s")


def index_stats(index: DataFrame, name: str = "chunks") -> DataFrame:
    """One row: name, number of chunks and documents, and the names of the metadata fields."""
    fields = [c for c in index.columns if c not in ("item_id", "id", "text", "embedding")]
    return index.agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs")).select(F.lit(name).alias("collection"), "n_chunks", "n_docs", F.lit(",".join(fields)).alias("metadata_fields"))


def section_match(retrieved: Column, expected: Column) -> Column:
    """Whether a section's first token, without a full stop at its end, is the expected number or below it."""
    token = F.regexp_replace(F.regexp_extract(retrieved, r"^\s*(\S+)", 1), r"\.+$", "")
    return (token != "") & ((token == expected) | token.startswith(F.concat(expected, F.lit("."))))


def evaluate(results: DataFrame) -> DataFrame:
    """One row on results(test_id, rank, retrieved_section, expected_section, relevance, time_ms): means and accuracies."""
    hit = section_match(F.col("retrieved_section"), F.col("expected_section"))
    tests = results.groupBy("test_id").agg(
        F.avg("time_ms").alias("time_ms"), F.max(F.when(F.col("rank") == 1, F.col("relevance"))).alias("relevance"),
        F.coalesce(F.bool_or(F.when(F.col("rank") == 1, hit)), F.lit(False)).alias("top1"), F.coalesce(F.bool_or(F.when(F.col("rank") <= 3, hit)), F.lit(False)).alias("top3"),
    )
    share = lambda c: F.coalesce(F.try_divide(F.lit(100.0) * F.count_if(c), F.count("*")), F.lit(0.0))
    return tests.agg(F.count("*").alias("total"), F.avg("time_ms").alias("avg_time_ms"), F.avg("relevance").alias("avg_relevance"), F.count_if("top1").alias("top1_correct"), F.count_if("top3").alias("top3_correct"), share(F.col("top1")).alias("top1_accuracy_pct"), share(F.col("top3")).alias("top3_accuracy_pct"))
