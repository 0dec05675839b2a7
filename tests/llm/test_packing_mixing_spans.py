import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from marlstone.llm import hashing, mixing, packing, sieve, spans, tokens

TOKENS = "doc_id bigint, source string, n_tokens bigint, free int, rank int, _bucket int, container_no int, grp int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], TOKENS)


@pytest.mark.parametrize("seed, capacity", [(0, 50), (1, 97), (2, 1), (3, 512)])
def test_pack(spark, seed, capacity):
    r = random.Random(seed)
    sizes = [r.choice([0, None, 1, 3, capacity // 3, capacity // 2 + 1, capacity, capacity + 1, 3 * capacity + 7, r.randint(1, 2 * capacity), 20]) for _ in range(300)]
    docs = [(i if i % 50 else 7, "s", n) for i, n in enumerate(sizes)] + [(None, "s", 5), (None, "s", 5)]
    out = packing.pack(table(spark, docs), capacity).collect()
    load, got = defaultdict(int), Counter()
    for x in out:
        if x["container_no"] is not None:
            load[x["container_no"]] += x["n_tokens"]
            assert x["n_tokens"] > 0
        got[x["doc_id"]] += x["n_tokens"]
        assert x["start_token"] == x["piece_no"] * capacity
    want = Counter()
    for i, _, n in docs:
        want[i] += n or 0
    assert got == want and max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
    pieces = Counter((x["doc_id"]) for x in out)
    for i, _, n in docs:
        if i not in (7, None):
            assert pieces[i] == (1 if not n else -(-n // capacity))
    least = -(-sum(want.values()) // capacity)
    assert len(load) <= 1.25 * least + 2
    f = packing.fill(packing.pack(table(spark, docs), capacity), capacity).first()
    assert (f["n_containers"], f["least_containers"]) == (len(load), least)


def test_pack_edges(spark):
    assert packing.pack(table(spark, []), 10).count() == 0
    assert [tuple(r) for r in packing.pack(table(spark, [(1, None, 0)]), 10).collect()] == [(1, 0, 0, 0, None)]
    one = packing.pack(table(spark, [(i, "s", 7) for i in range(1000)]), 7)  # one size for all
    assert one.select("container_no").distinct().count() == 1000
    with pytest.raises(ValueError):
        packing.pack(table(spark, []), 0)


def test_configurations_are_near_the_bound():
    r = np.random.default_rng(0)
    sizes, demand = np.array([60, 50, 40, 30]), r.integers(500, 900, 4)
    made = packing.configurations(sizes, demand, 100)
    assert (sum(c * n for c, n in made) == demand).all() and all((c * sizes).sum() <= 100 for c, _ in made)
    assert sum(n for _, n in made) <= np.ceil((sizes * demand).sum() / 100) * 1.05 + 4


def test_best_fit_of_small_items():
    counts, free = np.zeros(11, np.int64), np.zeros(11, np.int64)
    counts[[2, 3]], free[[3, 5]] = [3, 2], [1, 1]
    runs, new = packing.plan_small(counts, free, 10)
    assert new == 1 and sum(z - a for _, a, z, *_ in runs) == 5
    assert packing.plan_small(np.zeros(11, np.int64), free, 10) == ([], 0)


WEIGHTS = "source string, target_share double, max_repeats int, copies int"


def test_mix(spark):
    r = random.Random(5)
    docs = [(i, r.choice(["a", " A", "b", "c", "zz", None]), r.choice([0, 1, 50, r.randint(1, 200)])) for i in range(3000)]
    weights = [("A ", 0.5, 3, 0), ("b", 0.3, 2, 0), ("c", 0.1, 5, 0), ("gone", 0.1, 9, 0), (None, 0.2, 1, 0), ("null", None, 1, 0)]
    t, w = table(spark, docs), spark.createDataFrame(weights, WEIGHTS)
    mixture = mixing.mix(t, w)
    rows = mixture.collect()
    assert len({x["doc_id"] for x in rows}) == len(rows) and all(x["copies"] >= 1 for x in rows)
    cap, size = {"a": 3, "b": 2, "c": 5}, Counter()
    for x in rows:
        assert x["copies"] <= cap[x["source"]]
        size[x["source"]] += x["copies"] * x["n_tokens"]
    total = sum(size.values())
    for s, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(size[s] / total - share) < 0.01
    shares = {x["source"]: x for x in mixing.shares(t, w, mixture).collect()}
    assert abs(sum(x["reached_share"] for x in shares.values()) - 1) < 1e-9 and shares["gone"]["mixed_tokens"] == 0 and shares["zz"]["n_docs"] > 0
    # within a source, copies differ by one at most: no document is left behind
    expected = mixing.plan({s: (sum((x[1] or "").strip().lower() == s and x[2] > 0 for x in docs), sum(x[2] for x in docs if (x[1] or "").strip().lower() == s)) for s in cap}, {"a": (0.5, 3), "b": (0.3, 2), "c": (0.1, 5), "gone": (0.1, 9), "null": (0, 1)})
    for s in cap:
        of = Counter(x["copies"] for x in rows if x["source"] == s)
        assert set(of) <= {int(expected[s]["copies"]), int(expected[s]["copies"]) + 1}


def test_scarce_source_falls_short(spark):
    """A source of one small document does not empty the other; with a total, shares are of that total."""
    t = table(spark, [*[(i, "big", 1000) for i in range(2000)], (9999, "tiny", 100)])
    w = spark.createDataFrame([("big", 0.5, 2, 0), ("tiny", 0.5, 2, 0)], WEIGHTS)
    for total, big in ((None, 10), (1_000_000, 500), (0, 0)):
        rows = mixing.mix(t, w, total).collect()
        assert sum(x["copies"] for x in rows if x["source"] == "big") == big and sum(x["copies"] for x in rows if x["source"] == "tiny") == (2 if big else 0)
    made = {x["source"]: x for x in mixing.shares(t, w, mixing.mix(t, w, 1_000_000), 1_000_000).collect()}
    assert made["tiny"]["short"] and not made["big"]["short"] and made["big"]["wanted_tokens"] == made["big"]["mixed_tokens"] == 500_000
    assert all(x["copies"] == 2 for x in mixing.mix(t, w, 10**9).collect())


def test_shares_are_met_closely(spark):
    r = random.Random(2)
    t = table(spark, [(i, s, r.randint(1, 3000)) for i, s in enumerate(["a"] * 300 + ["b"] * 40)])
    w = spark.createDataFrame([("a", 0.8, 1, 0), ("b", 0.2, 2, 0)], WEIGHTS)
    for x in mixing.shares(t, w, mixing.mix(t, w)).collect():
        assert abs(x["reached_share"] - x["target_share"]) < 0.005 and abs(x["mixed_tokens"] - x["wanted_tokens"]) < 1500


def test_mix_edges(spark):
    w = spark.createDataFrame([("a", 1.0, 2, 0)], WEIGHTS)
    assert mixing.mix(table(spark, []), w).count() == 0 and mixing.mix(table(spark, [(1, "a", 5)]), w.filter("false")).count() == 0
    assert [tuple(r) for r in mixing.mix(table(spark, [(1, "a", 5), (1, "a", 5)]), w).collect()] == [(1, "a", 5, 2)] * 2
    assert mixing.shares(table(spark, []), w, mixing.mix(table(spark, []), w)).first()["reached_share"] == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "a b " * 20_000, "x"), (5, "😀é<|endoftext|>", "x")], "doc_id bigint, text string, n_tokens string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 40_000 - 2 and got[5] > 1
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert all(got[r["doc_id"]] == len(t.encode(r["text"] or "", add_special_tokens=False)) for r in df.collect())


def brute(texts, length):
    where = defaultdict(set)
    for i, t in texts:
        if i is not None and t is not None:
            for p in range(len(t) - length + 1):
                where[t[p : p + length]].add(i)
    out = set()
    for i, t in set(texts):
        if i is None or t is None:
            continue
        lit = [False] * (len(t) + 1)
        for p in range(len(t) - length + 1):
            if len(where[t[p : p + length]]) > 1:
                lit[p : p + length] = [True] * length
        a = None
        for p, on in enumerate(lit):
            if on and a is None:
                a = p
            if not on and a is not None:
                out.add((i, a, p - a))
                a = None
    return out


@pytest.mark.parametrize("seed, length", [(0, 8), (1, 20), (2, 37), (3, 20)])
def test_spans_against_brute_force(spark, seed, length):
    r = random.Random(seed)
    blocks = ["".join(r.choice("abé😀 \n") for _ in range(r.randint(5, 60))) for _ in range(12)]
    texts = [(i, "".join(r.choice(blocks) if r.random() < 0.6 else "".join(r.choice("abcxyz") for _ in range(r.randint(1, 30))) for _ in range(r.randint(0, 14)))) for i in range(40)]
    texts += [(100, texts[3][1]), (101, None), (102, ""), (103, "a" * 90), (104, "a" * 70 + "b"), (3, texts[3][1]), (None, texts[3][1])]
    df = spark.createDataFrame([(*t, 1, 2, "h", 5) for t in texts], "doc_id bigint, text string, h int, at int, _id string, n int").repartition(6)
    got = [tuple(x) for x in spans.shared_spans(df, span=length).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, length)
    share = {x["doc_id"]: x for x in spans.shared_shares(df, spans.shared_spans(df, span=length)).collect()}
    assert share[101]["share"] is None and share[102]["share"] is None and share[100]["share"] in (0.0, 1.0)


def test_many_copies_and_long_texts(spark):
    r = random.Random(7)
    base = "".join(r.choice("abcdefgh") for _ in range(600))
    long = "".join(r.choice("ijklmnop") for _ in range(1_200_000))
    texts = [(i, base) for i in range(300)] + [(1000 + i, f"{i:09d}" * 30 + base[100:400] + f"{-i:09d}" * 9) for i in range(300)] + [(5000, long), (5001, long[500_000:500_400])]
    got = {tuple(x) for x in spans.shared_spans(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert {(i, 0, 600) for i in range(300)} <= got and (5000, 500_000, 400) in got and (5001, 0, 400) in got
    for i in range(300):
        assert (1000 + i, 270, 300) in got or any(x[0] == 1000 + i and x[1] <= 270 and x[1] + x[2] >= 570 for x in got)


def test_notice_everywhere_and_one_character(spark):
    """A notice in every text, and long texts of one character, which are anchors at every place."""
    r = random.Random(9)
    notice = "".join(r.choice("abcdefgh ") for _ in range(230))
    texts = [(i, "".join(r.choice("ijklmn") for _ in range(150)) + notice + "".join(r.choice("opqrst") for _ in range(90))) for i in range(200)]
    texts += [(900, "=" * 1_000_000), (901, "-" * 300 + "=" * 400), (902, "x" * 250), (903, "x" * 199 + "y")]
    got = {tuple(x) for x in spans.shared_spans(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)).collect()}
    ends = [x for x in got if x[0] < 900]
    assert len(ends) == 200 and all(x[1] <= 150 and x[1] + x[2] >= 380 for x in ends)
    assert {x for x in got if x[0] >= 900} == {(900, 0, 1_000_000), (901, 300, 400)}


def test_hashes_of_spans():
    codes = hashing.codes_of("ab😀cd" * 9)
    for letter in (1, 2):
        h = hashing.Spans(codes, letter, 1)
        assert (h.windows(7) == h.of(np.arange(len(codes) - 6), np.arange(7, len(codes) + 1))).all()
        assert h.of(np.array([0]), np.array([7])) == h.of(np.array([5]), np.array([12])) != h.of(np.array([1]), np.array([8]))
        assert (hashing.Spans(codes[5:], letter, 1).windows(7) == h.windows(7)[5:]).all()


def test_spans_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.shared_spans(empty).count() == 0 and spans.shared_shares(empty, spans.shared_spans(empty)).count() == 0
    with pytest.raises(ValueError):
        spans.shared_spans(empty, span=4)


def test_sieve_stops_no_member(spark):
    r = np.random.default_rng(1)
    keys = r.integers(-(2**63), 2**63 - 1, 1000)
    df = spark.createDataFrame([(int(k),) for k in keys], "k bigint")
    words = sieve.build(df, "k", sieve.bits_for(1000))
    assert sieve.passes(words, keys).all() and sieve.passes(words, r.integers(-(2**63), 2**63 - 1, 100_000)).mean() < 0.05
    assert sieve.bits_for(10**12) == 1 << 27
