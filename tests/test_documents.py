import re

import pytest
from pyspark.sql import functions as F

from marlstone.operators import chunking, text


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Title\n\n  12 \nPage 3\nScope ....... 4\nBody text\nReferences to others\ntail", "Title\nBody text"),
        ("KAYNAKÇA\nx", ""),
        ("a\r\n b \npage12", "a\nb"),
        ("", ""),
        (None, None),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, raw, text.clean) == want


def test_blank(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, " \n ")], "i int, t string")
    good, bad = text.blank_documents(df, "t")
    assert [r["i"] for r in good.collect()] == [1] and sorted(r["i"] for r in bad.collect()) == [2, 3]


def sections(spark, raw, **k):
    return [(s["number"], s["name"], s["content"]) for s in one(spark, raw, lambda c: chunking.sections(c, **k))]


def test_sections(spark):
    assert sections(spark, "1. Introduction\n1.1 Purpose\nbody\n3 Scope\n\n2024 was a busy year\nx") == [("0", "Preamble", "1. Introduction"), ("1.1", "1.1 Purpose", "body"), ("3", "3 Scope", ""), ("2024", "2024 was a busy year", "x")]
    assert sections(spark, "## Overview\nt\n# Next\nu") == [("1", "Overview", "t"), ("2", "Next", "u")]
    assert sections(spark, "1 A\n2 B") == [("1", "Document Content", "1 A\n2 B")]
    long = "1 " + "x" * 150
    assert sections(spark, long) == [("0", "Preamble", long)]
    assert sections(spark, "1. Intro\nx", dotted_headers=True) == [("1", "1 Intro", "x")]


def overlap(t, n=30):
    if len(t) <= n:
        return t
    tail = t[len(t) - n :]
    p = tail.find(". ")
    return tail[p + 2 :] if 0 < p < len(tail) - 10 else tail


def packed(name, body, size=250):
    body = body.strip()
    if len(body) <= size:
        return [f"{name}\n\n{body}"]
    out, cur = [], ""
    for p in filter(None, (x.strip() for x in body.split("\n\n"))):
        if cur and len(f"{cur}\n\n{p}") > size:
            out.append(cur)
            cur = f"{overlap(cur)}\n\n{p}"
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    return [f"{name}\n\n{x}" for x in [*out, *([cur] if cur else [])]]


@pytest.mark.parametrize("tail", ["Short. Tail of it", "abcde. rest of the text which goes on", ". 456789012345678901234567890123", "x" * 18 + ". 1234567890", "x" * 19 + ". 123456789"])
def test_overlap(spark, tail):
    t = "y" * 40 + tail
    assert one(spark, t, chunking.overlap_tail) == overlap(t)


def test_chunks_against_plain_fold(spark):
    body = "\n\n".join(f"Paragraph {i}. " + "word " * (7 * i % 40) for i in range(30))
    df = spark.createDataFrame([(7, "d.txt", "SRS", f"1 Scope\n{body}\n2 Other\nshort\n3 Empty\n \n"), (8, "e.txt", None, None), (9, "f.txt", "X", "  ")], "doc_id bigint, doc_name string, doc_type string, text string")
    got = sorted(chunking.chunks(df).collect(), key=lambda r: r["chunk_index"])
    want = packed("1 Scope", body) + ["2 Other\n\nshort"]
    assert [r["text"] for r in got] == want
    assert [r["id"] for r in got] == [f"7_chunk_{i}" for i in range(len(want))]
    assert [r["page_number"] for r in got] == [i // 3 + 1 for i in range(len(want))] and got[0]["file_path"] == "inputs/d.txt"


@pytest.mark.parametrize("t", ["", "a" * 25, "aa. bb. cc. dd. ee. ff", "." * 30, "no stop at all " * 3])
def test_windows_are_lossless(t):
    w = chunking.windows_of(t, 10)
    assert "".join(w) == t and all(len(x) <= 10 for x in w)
    assert all(x.endswith(".") or not re.search(r"\.", x[1:]) for x in w[:-1])
