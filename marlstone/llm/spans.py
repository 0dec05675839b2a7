"""Long spans that texts share character by character.

Windows are found repeated level by level, each about twice as long as before: anchors of a quarter of the length
first, then windows of twice that around the anchors that another text has too, then whole groups of the full windows
around what is left. An anchor is a window whose hash is the smallest within the full length: any shared span holds
one that both texts choose. A group of neighbouring windows is settled at once: if what all of them cover together
stands in another text, each of them is shared; if what they have in common does not, none is; only groups between the
two are cut into smaller ones, until no candidate is left. So inside a shared span there is a row for a group of
windows, and single windows are compared at its ends alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm import sieve
from marlstone.llm.hashing import AT_ONCE, Spans, codes_of
from marlstone.session import cut

#: Ids of copies up to which they are sent to all executors; code points of a letter of the hashes.
MOST_SENT, LETTER = 2_000_000, 2


def _slide(a: np.ndarray, width: int, best) -> np.ndarray:
    """The least or greatest of each run of width."""
    done = 1
    while done * 2 <= width:
        a = best(a[:-done], a[done:])
        done *= 2
    return best(a[: len(a) - (width - done)], a[width - done :]) if width > done else a


def _portions(ids: np.ndarray, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
    """(ids, codes, bounds, which) of some texts of a batch at a time: text i of them is codes[bounds[i] : bounds[i + 1]]."""
    begin, parts, size = 0, [], 0
    for i, text in enumerate(texts):
        parts.append(codes_of(text))
        size += len(parts[-1])
        if size >= AT_ONCE or i == len(texts) - 1:
            yield ids[begin : i + 1], np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts]), slice(begin, i + 1)
            begin, parts, size = i + 1, [], 0


def _anchored(ids: np.ndarray, codes: np.ndarray, bounds: np.ndarray, span: int):
    """(text's number, hash, hash of the window twice as long from there on, of the one that ends with it, place) of all
    anchors; the doubled hashes are 0 where a text ends before."""
    k, n = span // 4, len(codes)
    of = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(bounds))
    spans = Spans(codes, LETTER)
    h, twice = spans.windows(k), spans.windows(2 * k)
    width = span - k + 1
    low = _slide(h, width, np.minimum)  # of each window of length span
    low[of[: len(low)] != of[span - 1 :]] = 0  # windows that would cross texts choose nothing
    edge = np.zeros(width - 1, np.uint64)
    high = _slide(np.concatenate([edge, low, edge]), width, np.maximum)
    at = np.flatnonzero((high == h) & (h > 0))
    right_ok = (at + 2 * k <= n) & (of[np.minimum(at + 2 * k - 1, n - 1)] == of[at])
    left_ok = (at - k >= 0) & (of[np.maximum(at - k, 0)] == of[at])
    right = np.where(right_ok, twice[np.minimum(at, len(twice) - 1)], np.uint64(0))
    left = np.where(left_ok, twice[np.maximum(at - k, 0)], np.uint64(0))
    return of[at], h[at], right, left, at - bounds[of[at]]


def _of_two(ids: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether another id has an equal key."""
    order = np.lexsort((ids, *keys))
    fresh = np.ones(len(ids), bool)
    fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(ids)) - 1
    out = np.zeros(len(ids), bool)
    out[order] = (ids[order][first] != ids[order][last])[np.cumsum(fresh) - 1]
    return out


def _listed(ids: np.ndarray, places: np.ndarray, columns: dict[str, np.ndarray], by: list[str]) -> pa.RecordBatch:
    """A row for each id and different values of columns, with the list of places. sure: two of these ids have the same
    values of by, so the row need not meet those of other tasks to be known as shared."""
    names = list(columns)
    order = np.lexsort((places, *columns.values(), ids))
    ids, places, cols = ids[order], places[order], [c[order] for c in columns.values()]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = np.any([x[1:] != x[:-1] for x in (ids, *cols)], axis=0)
    first = np.flatnonzero(fresh)
    ids, cols = ids[first], [c[first] for c in cols]
    sure = _of_two(ids, *[cols[names.index(b)] for b in by]) if len(ids) else np.zeros(0, bool)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(places)).astype(np.int32)), pa.array(places.astype(np.int32)))
    signed = [c.view(np.int64) if c.dtype == np.uint64 else c for c in cols]
    return pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(c) for c in signed], lists, pa.array(sure)], ["_id", *names, "places", "sure"])


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that rows of two or more ids have; combined before they move."""
    return rows.groupBy(*key).agg(F.min("_id").alias("_low"), F.max("_id").alias("_high")).filter("_low < _high").select(*key)


def merge(spans: DataFrame, block: int = 4096) -> DataFrame:
    """(_id, a, z) united where they overlap or touch: first within blocks of places, then over the blocks' few spans."""

    def once(df: DataFrame, *part: str) -> DataFrame:
        w = W.partitionBy(*part).orderBy("a", "z")
        far = F.max("z").over(w.rowsBetween(W.unboundedPreceding, -1))
        island = F.sum(F.when(far.isNull() | (F.col("a") > far), 1).otherwise(0)).over(w)
        return df.withColumn("_island", island).groupBy(*part, "_island").agg(F.min("a").alias("a"), F.max("z").alias("z")).drop("_island")

    return once(once(spans.withColumn("_block", F.floor(F.col("a") / block)), "_id", "_block").drop("_block"), "_id")


def _first_groups(starts: np.ndarray, span: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, number of places) of the groups of windows that hold an anchor, for anchors at starts. They are told
    by the distance to the anchor, so that all texts with the anchor have the same groups."""
    reach = span - span // 4 + 1  # windows that hold it begin up to reach - 1 before it
    far = np.arange(width, reach + width, width).clip(max=reach)  # the first place of each group, before the anchor
    many = np.diff(np.concatenate([[0], far]))
    return (starts[:, None] - far[None, :] + 1).ravel(), np.tile(many, len(starts))


def _level(width: int, span: int):
    """The worker of a level: texts with their candidate groups, cut into groups of width places at most, to rows with
    u1 and u2, the hash of what all windows of a group cover (has: the text reaches so far), and c, of what they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, firsts, many = b.column("_text").to_pylist(), b.column("firsts"), b.column("many")
            for ids, codes, bounds, which in _portions(b.column("_id").to_numpy(), texts):
                part = [x.slice(which.start, which.stop - which.start) for x in (firsts, many)]
                of = np.repeat(np.arange(len(ids)), part[0].value_lengths().to_numpy())
                q, w = (x.flatten().to_numpy().astype(np.int64) for x in part)
                pieces = -(-w // width)  # cut into groups of this level
                of, q, w, no = (np.repeat(x, pieces) for x in (of, q, w, np.zeros(len(w), np.int64)))
                no = np.arange(len(q)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                q, w = q + no * width, np.minimum(width, w - no * width)
                size = np.diff(bounds)[of]
                ok = (q + w - 1 >= 0) & (q + span <= size)  # at least one window of the group is in the text
                of, q, w, size = of[ok], q[ok], w[ok], size[ok]
                _, keep = np.unique(np.stack([of, q, w]), axis=1, return_index=True)
                of, q, w, size = of[keep], q[keep], w[keep], size[keep]
                has = (q >= 0) & (q + w - 1 + span <= size)
                base = bounds[of]
                a, z = np.where(has, base + q, base), np.where(has, base + q + w - 1 + span, base + span)
                one, two = Spans(codes, LETTER, 0), Spans(codes, LETTER, 1)
                u1, u2 = (np.where(has, x.of(a, z), np.uint64(0)) for x in (one, two))
                c = one.of(base + q + w - 1, base + q + span)
                out = _listed(ids[of], q, {"u1": u1, "u2": u2, "c": c, "w": w.astype(np.int32), "has": has}, ["u1", "u2"])
                yield out.set_column(out.schema.get_field_index("sure"), "sure", pa.compute.and_(out.column("sure"), out.column("has")))

    return run


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = 200, most_bits: int = 1 << 27) -> DataFrame:
    """(key, start_pos, n_chars): the maximal runs of places of a text that lie in spans of at least span code points
    which a text of another key has too; runs that touch are one.

    key is a bigint. Null and empty texts, ones shorter than span and rows with a null key have none. Repeated rows
    count once; a text that repeats its own spans shares them only if another key has them. Texts that are equal as a
    whole are compared once, whatever their number, and shared from end to end. Windows of the full length are
    compared by 128 bits of hash. span is at least 8. Other columns are not read.
    """
    if span < 8:
        raise ValueError("span must be 8 or more")
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_text")).filter(F.col("_id").isNotNull() & (F.length("_text") >= span))
    marks = docs.select(F.xxhash64("_text").alias("_m"), F.xxhash64(F.lit(1), "_text", F.lit(2)).alias("_o"), F.length("_text").alias("n"), "_id")
    same = marks.groupBy("_m", "_o", "n").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).filter("first < last")
    copied = cut(marks.join(same, ["_m", "_o", "n"]).select("_id", "n", "first").distinct(), "copied")
    # of equal texts, one goes on; the rest leave by an anti-join, without moving texts where their ids are few
    rest = copied.filter("_id <> first").select("_id")
    only = docs.join(F.broadcast(rest) if copied.count() <= MOST_SENT else rest, "_id", "left_anti")

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, codes, bounds, _ in _portions(b.column("_id").to_numpy(), b.column("_text").to_pylist()):
                of, h, _, _, _ = _anchored(ids, codes, bounds, span)
                pairs = np.unique(np.stack([ids[of], h.view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["_id", "h"])

    again = cut(repeated(only.mapInArrow(first_level, "_id long, h long"), "h"), "level1")
    words = spark.sparkContext.broadcast(sieve.build(again, "h", sieve.bits_for(again.count(), most_bits)))

    def second_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, codes, bounds, _ in _portions(b.column("_id").to_numpy(), b.column("_text").to_pylist()):
                of, h, right, left, at = _anchored(ids, codes, bounds, span)
                yes = sieve.passes(words.value, h)
                of, at, both = np.tile(of[yes], 2), np.tile(at[yes], 2), np.concatenate([right[yes], left[yes]])
                yield _listed(ids[of[both != 0]], at[both != 0], {"hh": both[both != 0]}, ["hh"])

    double = cut(only.mapInArrow(second_level, "_id long, hh long, places array<int>, sure boolean"), "level2")
    kept = double.filter("sure").unionByName(double.filter("NOT sure").join(repeated(double, "hh"), "hh", "left_semi").select(double.columns))
    anchors = kept.groupBy("_id").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))  # one text's
    widths = list(dict.fromkeys((max(1, span // 3), max(1, span // 12), 1)))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("places")
            firsts, many = _first_groups(lists.flatten().to_numpy().astype(np.int64), span, widths[0])
            each = len(firsts) // max(1, len(lists.flatten()))
            offsets = pa.array((np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]) * each).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (firsts, many)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), *arrays], ["_id", "firsts", "many"])

    left = cut(anchors.mapInArrow(grouped, "_id long, firsts array<int>, many array<int>"), "groups")
    found = []
    for width, smaller in zip(widths, [*widths[1:], None]):
        # written before, so that a table small enough to be sent is known as such and the texts need not move
        texts = only.join(left, "_id").select("_id", "_text", "firsts", "many")
        rows = cut(texts.mapInArrow(_level(width, span), "_id long, u1 long, u2 long, c long, w int, has boolean, places array<int>, sure boolean"), "level3")
        unsure = rows.filter("NOT sure")
        shared = repeated(rows.filter("has"), "u1", "u2")
        found.append(cut(rows.filter("sure").unionByName(unsure.filter("has").join(shared, ["u1", "u2"], "left_semi").select(rows.columns)), "shared"))
        if smaller is None:
            break
        # groups that are not settled but share their middle are cut; of the settled ones with that middle, which may be
        # many, two of each kind go along, so that the smaller groups meet what stands there
        open_ = cut(unsure.join(shared, ["u1", "u2"], "left_anti").join(repeated(rows, "c"), "c", "left_semi").select("_id", "c", "w", "places"), "open")
        one = F.struct("_id", F.col("places")[0].alias("q"))
        witness = found[-1].groupBy("u1", "u2", "c", "w").agg(F.array_distinct(F.array(F.min(one), F.max(one))).alias("two"))
        witness = witness.join(open_.select("c").distinct(), "c", "left_semi").select("w", F.explode("two").alias("t"))
        lists = open_.select("_id", F.col("places").alias("q"), F.array_repeat("w", F.size("places")).alias("m"))
        lists = lists.unionByName(witness.select("t._id", F.array("t.q").alias("q"), F.array("w").alias("m")))
        left = cut(lists.groupBy("_id").agg(F.flatten(F.collect_list("q")).alias("firsts"), F.flatten(F.collect_list("m")).alias("many")), "groups")
        if left.isEmpty():
            break
    whole = copied.select("_id", F.lit(0).alias("a"), F.col("n").alias("z"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    spans = merge(every.select("_id", F.explode("places").alias("a"), "w").select("_id", "a", (F.col("a") + F.col("w") - 1 + span).alias("z")))
    firsts = copied.filter("_id = first").select("_id")
    spans = spans.join(firsts, "_id", "left_anti").unionByName(whole)
    return spans.select(F.col("_id").alias(key), F.col("a").cast("int").alias("start_pos"), (F.col("z") - F.col("a")).cast("int").alias("n_chars"))


def shared_shares(df: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, shared_chars, share) of every row of df; share is null for null and empty texts."""
    total: Column = F.coalesce(F.length(text), F.lit(0))
    summed = spans.groupBy(F.col(key).alias("_k")).agg(F.sum("n_chars").alias("_s"))
    return df.select(key, total.alias("n_chars")).join(summed, F.col(key) == F.col("_k"), "left").select(key, "n_chars", F.coalesce("_s", F.lit(0)).alias("shared_chars"), F.try_divide(F.coalesce("_s", F.lit(0)), F.col("n_chars")).alias("share"))
