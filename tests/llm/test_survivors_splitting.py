import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from marlstone.llm import splitting as s
from marlstone.llm import survivors as v

ENTITIES = "record_id bigint, model_id bigint, context string, name string, attributes array<string>, source string, extracted_at timestamp_ntz, field string, rank int, _id int, vote int"
TRUST = "source string, trust_rank int"


def plain(x):
    return "".join(ch for ch in (x or "").lower() if ch.isalnum())


def brute(records, trust):
    rank, worst = {a: b for a, b in trust if a is not None}, max([b for _, b in trust], default=0) + 1
    groups = {}
    for r in {repr(r): r for r in records}.values():
        if r[1] is not None and plain(r[2]) and plain(r[3]):
            groups.setdefault((r[1], plain(r[2]), plain(r[3])), []).append(r)
    out = set()
    for g in groups.values():
        if len({r[0] for r in g}) < 2:
            continue
        t = lambda r: rank.get(r[5], worst)
        at = lambda r: r[6].timestamp() if r[6] else -1e18
        n = lambda r: len({plain(a) for a in r[4] or []} - {"", *v.NO_VALUE})
        low = min(r[0] for r in g)
        out.add((low, "name", min(g, key=lambda r: (t(r), -at(r), r[0]))[0]))
        out.add((low, "context", min(g, key=lambda r: (-at(r), t(r), r[0]))[0]))
        best = min(g, key=lambda r: (-n(r), t(r), -at(r), r[0]))
        if n(best):
            out.add((low, "attributes", best[0]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ranks_against_brute_force(spark, seed):
    r = random.Random(seed)
    trust = [("a", 1), ("b", 2), ("c", 2)]
    recs = [
        (i, r.choice([1, 1, 2, None]), r.choice(["Ctx A", "ctx-a", None, " "]), r.choice(["Order", "ORDER ", "o_rder", "N/A", "", None]), r.choice([None, [], ["x", "X", None], ["TBD", "-"], ["p", "q", "p_"]]), r.choice(["a", "b", "c", "zz", None]), r.choice([None, datetime(2025, 1, 1) + timedelta(days=r.randint(0, 3))]))
        for i in range(80)
    ]
    df = spark.createDataFrame([(*x, "f", 1, 2, 3) for x in [*recs, recs[0], recs[5]]], ENTITIES)
    got = [tuple(x) for x in v.suppliers(df, spark.createDataFrame(trust, TRUST)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(recs, trust)


def test_votes(spark):
    at = datetime(2025, 6, 1)
    recs = [(1, 1, "c", "n", ["p"], "b", at), (2, 1, "c", "n", ["p"], "b", at), (3, 1, "C", "N", ["q"], "a", None), (3, 1, "C", "N", ["q"], "a", None)]
    df, trust = spark.createDataFrame([(*x, "f", 1, 2, 3) for x in recs], ENTITIES), spark.createDataFrame([("a", 1), ("b", 2)], TRUST)
    one, many = v.survivors(df, trust).first(), v.survivors(df, trust, spelled=True).first()
    # trust 3 and 2 (the worst rank is 3), a time that is not known has decayed to a thousandth; repeats vote once
    assert one["name_votes"] == one["attributes_votes"] == 2 + 2 + Decimal("0.003") and one["n_records"] == 3 and one["group_id"] == 1
    assert (one["name"], one["name_record"], one["attributes"], one["attributes_record"]) == ("N", 3, ["q"], 3)
    assert (many["name"], many["name_record"], many["name_votes"], many["attributes"], many["attributes_record"]) == ("n", 1, 4, ["p"], 1)


def test_no_records(spark):
    empty = spark.createDataFrame([], ENTITIES)
    for spelled in (False, True):
        assert v.survivors(empty, spark.createDataFrame([], TRUST), spelled=spelled).count() == 0


CHUNKS = "chunk_id string, doc_id bigint, doc_name string, doc_type string, section_name string, section_number string, page_number int, chunk_index int, file_path string, text string, loaded_at timestamp_ntz, piece string, k int, lead int, _key string"
LIMITS = "doc_type string, max_chars int, overlap_chars int"
T = datetime(2025, 1, 1)


def chunk(i, text, kind="a", doc=1, at=T, no=None):
    return (f"c{i}" if i is not None else None, doc, "n", kind, None, "1", 1, i if no is None else no, "f", text, at, "p", 1, 2, "k")


def words(r, n):
    return "".join(r.choice(["lorem ", "ipsum. ", "dolor\n", "sit\n\n", "amet\r\n\r\n", "é😀x ", "a" * 30 + " "]) for _ in range(n))


@pytest.mark.parametrize("size", [1 << 16, 1])
def test_pieces(spark, size):
    r = random.Random(9)
    limits = [(" A ", 40, 10), ("b", 25, 0), ("*", 30, 5), (None, 5, 1)]
    texts = {i: words(r, r.randint(1, 60)) for i in range(12)} | {12: "x" * 500, 13: "x" * 25 + " " + "y" * 100, 14: "", 15: None, 16: "short", 17: " " * 300, 18: "z" * 40, 19: "\r\n" * 100}
    kinds = {i: ["a", "B ", "other", None][i % 4] for i in texts}
    rows = [chunk(i, t, kinds[i], doc=i % 3) for i, t in texts.items()]
    again = [(*x[:10], T + timedelta(days=1), *x[11:]) for x in rows[:4]]
    df = spark.createDataFrame([*rows, *again, rows[5]], CHUNKS)
    lim = spark.createDataFrame(limits, LIMITS)
    cap = lambda i: {"a": (40, 10), "b": (25, 0)}.get((kinds[i] or "").strip().lower(), (30, 5))
    out = s.split_chunks(df, lim, range_bytes=size).collect()
    for i, t in texts.items():
        mine = sorted((x for x in out if x["chunk_id"] == f"c{i}"), key=lambda x: x["piece_no"])
        assert [x["piece_no"] for x in mine] == list(range(len(mine))) and mine
        limit, over = cap(i)
        if t is None or len(t) <= limit:
            assert len(mine) == 1 and mine[0]["text"] == t and mine[0]["cut_kind"] == "whole"
            continue
        assert all(0 < len(x["text"]) <= limit and x["text"] == t[x["start_pos"] : x["start_pos"] + x["n_chars"]] for x in mine)
        assert mine[0]["start_pos"] == 0 and mine[-1]["start_pos"] + mine[-1]["n_chars"] == len(t)
        assert all(b["start_pos"] == a["start_pos"] + a["n_chars"] - over for a, b in zip(mine, mine[1:]))
        assert [(x["start_pos"], x["start_pos"] + x["n_chars"], x["cut_kind"]) for x in mine] == s.pieces_of(t, 0, len(t), limit, over)
    for doc in range(3):
        assert sorted(x["chunk_index"] for x in out if x["doc_id"] == doc) == list(range(sum(x["doc_id"] == doc for x in out)))
    forced = {r_["chunk_id"]: r_["forced"] for r_ in s.counted(df, lim, range_bytes=size)[0].collect()}
    want = {f"c{i}": int(max(map(len, t.replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" "))) > cap(i)[0]) for i, t in texts.items() if t is not None and len(t) > cap(i)[0]}
    assert forced == want


@pytest.mark.parametrize("seed", range(6))
def test_ranges_agree_with_the_whole(tmp_path, seed):
    """Whatever the ranges, the stitched pieces are those of the whole text."""
    r = random.Random(seed)
    text = words(r, 400) if seed % 3 else "".join(r.choice("ab\u00e9\U0001f600" + " " * (seed > 0)) for _ in range(4000))
    text = text[:1000] + "q" * 300 + text[1000:]
    limit, overlap, size = r.choice([(40, 10), (25, 0), (64, 32), (100, 7)]) + (r.choice([997, 1500, 1 << 20]),)
    data = text.encode()
    (tmp_path / "x").write_bytes(b"head" + data)
    out, entry, chars = [], 0, 0
    for no in range(-(-len(data) // size)):
        t, first, last, ends = s.load_range(f"file://{tmp_path}/x", 4, len(data), no, size, limit)
        assert t[first:last] == text[chars : chars + last - first] and (not ends or t[first:] == text[chars:])
        starts, exits, many = s.boundaries(t, first, last, ends, limit, overlap, no == 0)
        if entry >= 0:
            i = starts.index(entry)
            mine = s.pieces_in(t, first, last, ends, limit, overlap, entry, no == 0)
            assert len(mine) == many[i]
            out += [(a - first + chars, z - first + chars, k) for a, z, k in mine]
            entry = exits[i]
        chars += last - first
    assert out == s.pieces_of(text, 0, len(text), limit, overlap) and entry == -1


def test_files_are_split_by_ranges(spark, tmp_path):
    r = random.Random(1)
    texts = {"a.txt": words(r, 3000), "b.txt": "short", "c.txt": "", "d.txt": "z" * 20_000, "e.txt": "w\u00f6rd " * 4000}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    out = s.split_files(spark, f"file://{tmp_path}", 120, 20, 2000).collect()
    for name, t in texts.items():
        mine = sorted((x for x in out if x["path"].endswith(name)), key=lambda x: x["piece_no"])
        want = s.pieces_of(t, 0, len(t), 120, 20) if t else []
        assert [(x["start_pos"], x["start_pos"] + x["n_chars"], x["cut_kind"], x["piece"]) for x in mine] == [(a, z, k, t[a:z]) for a, z, k in want]


def test_split_nothing(spark):
    lim = spark.createDataFrame([], LIMITS)
    assert s.split_chunks(spark.createDataFrame([], CHUNKS), lim).count() == 0
    df = spark.createDataFrame([chunk(1, "x" * 1000)], CHUNKS)
    assert s.split_chunks(df, lim).first()["n_chars"] == 1000
    one = s.split_chunks(df, spark.createDataFrame([("*", 1, 5)], LIMITS)).collect()
    assert len(one) == 1000 and all(r["n_chars"] == 1 for r in one)
    assert s.split_chunks(spark.createDataFrame([chunk(None, "y" * 50, doc=None)], CHUNKS), spark.createDataFrame([("*", 20, 2)], LIMITS)).count() == 3


def test_limits_are_not_read_with_a_cross_join(spark):
    df = spark.createDataFrame([chunk(1, "x" * 100)], CHUNKS)
    plan = s.counted(df, spark.createDataFrame([("*", 20, 2)], LIMITS))[0]._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
