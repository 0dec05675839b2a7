import random
from datetime import datetime, timedelta

import pytest

from marlstone.operators import references

T0 = datetime(2025, 1, 1)
CONTEXTS = "context_id bigint, model_id bigint, project_name string, context_name string, description string, allowed_dependencies array<string>, registered_at timestamp_ntz, removed_at timestamp_ntz, loaded_at timestamp_ntz, _ref string, _t int"
SHARED = "context_id bigint, context_name string, allowed_dependencies array<string>, registered_at timestamp_ntz, removed_at timestamp_ntz"


def plain(s):
    return "".join(c for c in (s or "").lower() if c.isalnum())


def brute(contexts, shared):
    own = {}
    for r in contexts:
        if r[0] not in own or r[8] > own[r[0]][8]:
            own[r[0]] = r
    cand = [(r[1], plain(r[3]), r[6], r[7]) for r in own.values() if r[1] is not None] + [("*", plain(r[1]), r[3], r[4]) for r in set_of(shared)]
    refs = [("bounded_contexts", r[0], r[1], r[5], r[6]) for r in own.values()] + [("shared_contexts", r[0], None, r[2], r[3]) for r in set_of(shared)]
    out = set()
    for table, i, model, deps, t in refs:
        for n, dep in enumerate(deps or []):
            if dep is None or not dep.strip():
                continue
            mine = [c for c in cand if c[1] and c[1] == plain(dep) and (c[0] == "*" or (model is not None and c[0] == model))]
            if t is not None and any(c[2] is not None and c[2] <= t and (c[3] is None or c[3] > t) for c in mine):
                continue
            reason = "deleted" if t is not None and any(c[2] is not None and c[2] <= t for c in mine) else "later" if mine else "missing"
            out.add((table, i, n, reason, t and t.strftime("%Y-%m")))
    return out


def set_of(shared):
    return [(a, b, list(c) if c is not None else None, d, e) for a, b, c, d, e in {(r[0], r[1], tuple(r[2]) if r[2] is not None else None, r[3], r[4]) for r in shared}]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    names = ["Alpha One", "alpha_one", "Beta", None, " ", "--", "Gamma-2", "ΔELTA", "beta"]
    when = lambda: r.choice([None, *[T0 + timedelta(days=20 * k) for k in range(8)]])
    deps = lambda: r.choice([None, [], [r.choice(names) for _ in range(r.randint(1, 4))]])
    contexts = []
    for i in range(60):
        contexts.append((i % 45, r.choice([1, 1, 1, 2, None]), "p", r.choice(names), None, deps(), when(), when(), T0 + timedelta(seconds=i), "x", 1))
    contexts.append(contexts[-1])
    shared = [(1000 + i, r.choice(names), deps(), when(), when()) for i in range(8)]
    got = references.orphans(spark.createDataFrame(contexts, CONTEXTS), spark.createDataFrame([*shared, shared[0]], SHARED)).filter("direct")
    rows = [tuple(x) for x in got.select("table_name", "context_id", "dep_no", "reason", "period").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(contexts, shared)


def test_empty(spark):
    got = references.orphans(spark.createDataFrame([], CONTEXTS), spark.createDataFrame([], SHARED))
    assert got.count() == 0 and references.report(got).count() == 0 and references.levels(got).count() == 0


def cascade(contexts, shared):
    """(table, id, dep_no) -> depth of every orphan: rounds over all references, all of whose live bearers must be orphans."""
    own = {r[0]: r for r in sorted(contexts, key=lambda r: r[8])}
    nodes = [("bounded_contexts", r[0], r[1], plain(r[3]), r[5], r[6], r[7]) for r in own.values()] + [("shared_contexts", r[0], "*", plain(r[1]), r[2], r[3], r[4]) for r in set_of(shared)]
    refs = {}
    for table, i, model, _, deps, t, _ in nodes:
        for n, dep in enumerate(deps or []):
            if dep is not None and dep.strip():
                mine = [c for c in nodes if c[3] and c[3] == plain(dep) and (c[2] == "*" or (c[2] is not None and c[2] == model and table != "shared_contexts"))]
                refs[table, i, n] = {c[:2] for c in mine if t is not None and c[5] is not None and c[5] <= t and (c[6] is None or c[6] > t)}
    found, depth = {k: 0 for k, v in refs.items() if not v}, 0
    while True:
        lost, depth = {k[:2] for k in found}, depth + 1
        fresh = {k: depth for k, v in refs.items() if k not in found and v <= lost}
        if not fresh:
            return found
        found |= fresh


@pytest.mark.parametrize("seed", range(2))
def test_cascade_against_brute_force(spark, seed):
    r = random.Random(seed)
    names = [f"N{i}" for i in range(30)] + [None, "--"]
    when = lambda: T0 + timedelta(days=r.randint(0, 60))
    contexts = [(i, r.choice([1, 1, 2, None]), "p", r.choice(names), None, [r.choice(names) for _ in range(r.randint(0, 2))], when(), r.choice([None, None, when()]), T0 + timedelta(seconds=i), "x", 1) for i in range(90)]
    shared = [(i, r.choice(names), [r.choice(names)], when(), None) for i in range(8)]
    got = references.orphans(spark.createDataFrame(contexts, CONTEXTS), spark.createDataFrame(shared, SHARED)).collect()
    want = cascade(contexts, shared)
    assert len(got) == len(want) and {(x["table_name"], x["context_id"], x["dep_no"]): x["depth"] for x in got} == want and max(want.values()) > 1


def small(spark):
    """Shared: A (1) refers to nothing that exists, B (2) to A, C (3) to B. Bounded: id 1 is sound, 2 refers to C, 3 to
    id 1's name, 4 and 5 bear one name and 5 alone is an orphan, 6 refers to that name."""
    late = T0 + timedelta(days=1)
    shared = [(1, "A", ["nowhere"], T0, None), (2, "B", ["A"], late, None), (3, "C", ["B"], late, None)]
    deps = {1: ("One", []), 2: ("Two", ["C"]), 3: ("Three", ["One"]), 4: ("Twin", []), 5: ("Twin", ["gone"]), 6: ("Six", ["twin"])}
    own = [(i, 7, "p", name, None, d, late + timedelta(days=40 * (i == 6)), None, T0, "x", 1) for i, (name, d) in deps.items()]
    return spark.createDataFrame(own, CONTEXTS), spark.createDataFrame(shared, SHARED)


def test_cascade_keeps_tables_and_names_apart(spark):
    found = references.orphans(*small(spark))
    got = {(r[0], r[1]): (r[2], r[3]) for r in references.states(found).collect()}
    # bounded 1 and 3 are sound though shared 1 is an orphan; 6 has a sound bearer beside the orphaned one
    assert got == {("shared_contexts", 1): (0, True), ("shared_contexts", 2): (1, False), ("shared_contexts", 3): (2, False), ("bounded_contexts", 2): (3, False), ("bounded_contexts", 5): (0, True)}


def test_cascade_follows_only_live_bearers(spark):
    day = lambda n: T0 + timedelta(days=n)
    own = [(1, 7, "p", "Sales", None, ["gone"], day(0), day(2), T0, "x", 1), (2, 7, "p", "Sales", None, [], day(0), None, T0, "x", 1), (3, 7, "p", "Shop", None, ["Sales"], day(5), None, T0, "x", 1)]
    got = references.states(references.orphans(spark.createDataFrame(own, CONTEXTS), spark.createDataFrame([], SHARED))).collect()
    assert [tuple(r) for r in got] == [("bounded_contexts", 1, 0, True)]


def test_long_chains_have_no_bound(spark):
    own = [(i, 7, "p", f"N{i}", None, [f"N{i - 1}" if i else "gone"], T0, None, T0, "x", 1) for i in range(7)]
    got = references.states(references.orphans(spark.createDataFrame(own, CONTEXTS), spark.createDataFrame([], SHARED))).collect()
    assert {r["context_id"]: r["depth"] for r in got} == {i: i for i in range(7)}


def test_levels(spark, rows):
    found = references.orphans(*small(spark))
    assert rows(references.levels(found)) == [("bounded_contexts", "2025-01", 1, 1, 1, 1), ("shared_contexts", "2025-01", 1, 2, 1, 2)]
    assert ("shared_contexts", "2025-01", "inherited", 2, 2) in rows(references.report(found))


def test_prefix_sums(spark):
    from pyspark.sql import functions as F

    from marlstone.functions.ranks import bucketed_prefix_sum

    r = random.Random(1)
    data = [(r.choice(["a", "b", None]), r.randint(0, 5), i, r.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(data, "g string, b int, i int, v int")
    got = {x["i"]: x["s"] for x in bucketed_prefix_sum(df, ["g"], ["b"], [F.col("i")], F.col("v"), "s").collect()}
    for g in ("a", "b", None):
        total = 0
        for _, _, i, v in sorted((x for x in data if x[0] == g), key=lambda x: (x[1], x[2])):
            total += v
            assert got[i] == total
