"""Readers of documents, models, test cases and code; kinds of files are told by their extension."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.schemas import CALLS, MODEL, RETRIEVAL_TESTS, VALIDATIONS

# --- fixed values: extensions in the order of preference, and the text elements of a word-processor file ---
KINDS = ("pdf", "docx", "txt")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# --- end of fixed values ---


def kind_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, length) of the folder's documents, in order of kind, then path."""
    rows = spark.read.format("binaryFile").load(folder).select("path", "length").withColumn("kind", kind_of(F.col("path"))).filter(F.col("kind").isin(*KINDS))
    return rows.select("path", "kind", "length").orderBy(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), "path")


def docx_text(data: bytes) -> str:
    """The paragraphs of the body, a line each; tables and headers are not read."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
    return "\n".join("".join(text[e.tag](e) for e in p.iter() if e.tag in text) for p in (body if body is not None else []) if p.tag == f"{_W}p")


def pdf_text(data: bytes) -> str:
    """The pages' texts, a line end between them; needs a PDF library, which is optional."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise NotImplementedError("reading PDF needs the package pypdf") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def read_bytes(data: bytes, kind: str) -> str:
    if kind == "txt":
        return data.decode("utf-8")
    if kind == "docx":
        return docx_text(data)
    if kind == "pdf":
        return pdf_text(data)
    raise ValueError(f"unsupported kind of file: {kind}")


def read_documents(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """(doc_id, doc_name, doc_type, path, text, error): every file of the folder. Files of other kinds and unreadable
    ones raise an error, or, if not strict, have a null text and the error."""
    rows = spark.read.format("binaryFile").load(folder).select("path", kind_of(F.col("path")).alias("kind"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, kind, data in zip(b["path"], b["kind"], b["content"]):
                try:
                    out.append((path, kind, read_bytes(bytes(data), kind), None))
                except Exception as e:
                    if strict:
                        raise
                    out.append((path, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "kind", "text", "error"])

    made = rows.mapInPandas(run, "path string, kind string, text string, error string")
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    return made.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), name.alias("doc_name"), F.upper("kind").alias("doc_type"), "path", "text", "error")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files, without Python."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _code(rows: DataFrame) -> DataFrame:
    path = F.input_file_name()
    return rows.select(F.regexp_extract(path, r"([^/\\]+)$", 1).alias("filename"), path.alias("path"), F.col("value").alias("content"))


def read_code(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, path, content) of all Python files below a folder; path tells files of one name apart."""
    return _code(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").text(folder, wholetext=True))


def stream_code(spark: SparkSession, folder: str) -> DataFrame:
    """As read_code, as a stream: every Python file that is saved below the folder, once."""
    return _code(spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(folder))


def read_stages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stage_no, stage, snapshot): the stage files of a run, named <date>_<time>_<number>_<stage>.json, as JSON."""
    rows = spark.read.option("pathGlobFilter", "*_*_*_*.json").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("snapshot"))
    part = lambda i: F.regexp_extract("path", r"_(\d+)_([^_./\\]+)\.json$", i)
    return rows.select("path", part(1).cast("int").alias("stage_no"), part(2).alias("stage"), "snapshot").filter("stage <> ''")


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """Domain models from JSON files, typed; what is missing is null."""
    return spark.read.schema(MODEL).option("multiLine", True).json(path)


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval test cases, a row each; a file without any gives none, a missing file raises."""
    return spark.read.schema(RETRIEVAL_TESTS).option("multiLine", True).json(path).selectExpr("inline(test_cases)")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """The calls of exported usage reports."""
    return spark.read.schema(f"call_history array<struct<{_fields(CALLS)}>>").option("multiLine", True).json(path).selectExpr("inline(call_history)")


def read_validations(spark: SparkSession, path: str) -> DataFrame:
    """The validations of exported reports."""
    return spark.read.schema(f"validation_history array<struct<{_fields(VALIDATIONS)}>>").option("multiLine", True).json(path).selectExpr("inline(validation_history)")


def _fields(schema: str) -> str:
    return ", ".join(f.strip().replace(" ", ":", 1) for f in schema.split(", "))


__all__ = ["list_documents", "read_bytes", "read_calls", "read_code", "read_documents", "read_model", "read_stages", "read_tests", "read_texts", "read_validations", "stream_code"]
