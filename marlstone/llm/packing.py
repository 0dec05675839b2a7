"""Filling containers of fixed capacity with items, by linear grouping.

Only histograms of sizes, whose length is the capacity, come to the driver; there the plan is made: few sizes, the
best configurations of them, how many containers of each. Items and containers meet by their ranks, which are
numbered in the cluster, so the plan stays small whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.ranks import bucketed_prefix_sum, salt
from marlstone.session import cut

#: Items above this share of the capacity are grouped; the number of groups; buckets in which ranks are counted.
LARGE, GROUPS, BUCKETS = 0.25, 48, 256


def group_sizes(counts: np.ndarray, least: int, groups: int = GROUPS) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, number of items) of groups of about equal number, from the largest down.

    A size stays in one group, so a size that a large share of all items have makes a group by itself.
    """
    sizes = [s for s in range(len(counts) - 1, least - 1, -1) if counts[s]]
    total, out, begin, held = sum(int(counts[s]) for s in sizes), [], None, 0
    for s in sizes:
        begin = s if begin is None else begin
        held += int(counts[s])
        if held * groups >= total:
            out.append((s, begin, held))
            begin, held = None, 0
    if begin is not None:
        out.append((sizes[-1], begin, held))
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How many of each size to put into one container so that the values' sum is greatest (each size any number of times).

    Sizes above a quarter of the capacity, of which three fit at most, are all tried at once; else room by room.
    """
    if len(sizes) and int(sizes.min()) * 4 > capacity:
        return _best_of_three(sizes, values, capacity)
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = np.flatnonzero(sizes <= c)
        best[c] = best[c - 1]
        if len(fit):
            gain = best[c - sizes[fit]] + values[fit]
            k = int(np.argmax(gain))
            if gain[k] > best[c] + 1e-12:
                best[c], choice[c] = gain[k], fit[k]
    made, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            made[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return made, float(best[capacity])


def _best_of_three(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    s, v = np.append(sizes, 0), np.append(np.maximum(values, 0), 0.0)  # the last one is an empty place
    room = capacity - s[:, None] - s[None, :]
    # the best single size for every room that two leave
    order = np.argsort(s, kind="stable")
    at = np.searchsorted(s[order], room, side="right") - 1
    top = np.maximum.accumulate(v[order])
    where = np.maximum.accumulate(np.where(v[order] == top, np.arange(len(s)), 0))
    total = np.where(room >= 0, v[:, None] + v[None, :] + top[np.maximum(at, 0)], -1.0)
    i, j = np.unravel_index(int(np.argmax(total)), total.shape)
    made = np.zeros(len(sizes), np.int64)
    for k in (i, j, order[where[at[i, j]]]):
        if k < len(sizes):
            made[k] += 1
    return made, float(total[i, j])


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, number of containers) that hold the demand of all sizes exactly or with empty places at the end.

    The linear program over configurations is solved by column generation: a basis of as many configurations as
    sizes, and the best new configuration for their prices, until none is worth more than a container (or, as prices may
    go round in circles, as many rounds as there are pairs of sizes brought nothing); then whole numbers, and the rest
    greedily.
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(basis)
    least, idle = np.inf, 0
    while idle <= max(64, m * m):
        idle = 0 if amount.sum() < least - 1e-9 else idle + 1
        least = min(least, float(amount.sum()))
        prices = np.linalg.solve(basis.T, np.ones(m))
        column, value = best_configuration(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, column.astype(float))
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.where(up, amount / np.where(up, way, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        amount = np.maximum(amount - step * way, 0)
        amount[out] = step
        basis[:, out] = column
    left, made = demand.astype(np.int64).copy(), []
    for j in range(m):
        column = basis[:, j].round().astype(np.int64)
        used = column > 0
        n = min(int(np.floor(amount[j] + 1e-9)), int((left[used] // column[used]).min()) if used.any() else 0)
        if n > 0:
            made.append((column, n))
            left -= n * column
    while left.sum():  # first fit by falling size
        column, room = np.zeros(m, np.int64), capacity
        for k in np.argsort(-sizes, kind="stable"):
            column[k] = min(int(left[k]), room // int(sizes[k]))
            room -= int(column[k] * sizes[k])
        used = column > 0
        n = int((left[used] // column[used]).min())
        made.append((column, n))
        left -= n * column
    return made


def plan_large(counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], int]:
    """Runs (group, first rank, end rank, first container, items a container), the groups, and the number of containers."""
    groups = group_sizes(counts, int(capacity * LARGE) + 1)
    sizes = np.array([g[1] for g in groups], np.int64)
    made = configurations(sizes, np.array([g[2] for g in groups], np.int64), capacity)
    at, runs, base = np.zeros(len(groups), np.int64), [], 0
    for column, n in made:
        for k in np.flatnonzero(column):
            runs.append((int(k), int(at[k]), int(at[k] + n * column[k]), base, int(column[k])))
            at[k] += n * column[k]
        base += n
    return runs, groups, base


def plan_small(counts: np.ndarray, free: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit of the sizes of counts, from the largest down, into containers with free room.

    Runs (size, first rank, end rank, class, first container of the class, items a container), and the number of new
    containers. A class is the room that a container had at the start; new containers are of class -1.
    """
    rooms: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    for f in np.flatnonzero(free):
        rooms[f].append((int(f), 0, int(free[f])))
    runs, new = [], 0
    for s in range(len(counts) - 1, 0, -1):
        n, rank, f = int(counts[s]), 0, s
        while n:
            while f <= capacity and not rooms[f]:
                f += 1
            if f > capacity:
                k = capacity // s
                need = -(-n // k)
                rooms[capacity].append((-1, new, new + need))
                new += need
                f = capacity
            origin, a, z = rooms[f].pop()
            k = f // s
            full = min(z - a, n // k)
            if full:
                runs.append((s, rank, rank + full * k, origin, a, k))
                rooms[f - k * s].append((origin, a, a + full))
                rank, n, a = rank + full * k, n - full * k, a + full
            if n and a < z:  # n < k: the rest goes into one more
                runs.append((s, rank, rank + n, origin, a, n))
                rooms[f - n * s].append((origin, a, a + 1))
                rank, n, a = rank + n, 0, a + 1
            if a < z:
                rooms[f].append((origin, a, z))
    return runs, new


def buckets_for(n: int) -> int:
    """Hashed buckets in which n rows of one group are ranked: a million rows in each at most, about."""
    return max(BUCKETS, n // 1_000_000)


def _ranked(df: DataFrame, group: str, n: int) -> DataFrame:
    """rank from 0 within group, in hashed buckets, so that a group of any size, n rows at most, is spread."""
    out = bucketed_prefix_sum(df.withColumn("_bucket", salt("doc_id", "piece_no", buckets=buckets_for(n))), [group], ["_bucket"], [F.col("doc_id"), F.col("piece_no")], F.lit(1).cast("bigint"), "_upto")
    return out.withColumn("rank", F.col("_upto") - 1).drop("_bucket", "_upto")


def _placed(df: DataFrame, keys: np.ndarray, starts: np.ndarray, first: np.ndarray, each: np.ndarray, classes: np.ndarray, key: str) -> DataFrame:
    """Add class and place: the container by (key, rank), from runs sorted by (key, first rank)."""
    order = np.lexsort((starts, keys))
    keys, starts, first, each, classes = (x[order] for x in (keys, starts, first, each, classes))
    lows, names = np.searchsorted(keys, np.unique(keys)), np.unique(keys)
    ends = np.append(lows[1:], len(keys))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k, r = b[key].to_numpy(), b["rank"].to_numpy()
            at = np.zeros(len(b), np.int64)
            which = np.searchsorted(names, k)
            for g in np.unique(which):
                mine = which == g
                at[mine] = lows[g] + np.searchsorted(starts[lows[g] : ends[g]], r[mine], side="right") - 1
            yield b.assign(cls=classes[at], place=first[at] + (r - starts[at]) // each[at])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{kinds}, cls int, place long")


def _columns(runs: list[tuple], *at: int) -> list[np.ndarray]:
    return [np.array([r[i] for r in runs], np.int64) for i in at]


def _histogram(df: DataFrame, column: str, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r in df.groupBy(column).agg(F.count("*").alias("n")).filter(F.col(column).between(0, size - 1)).collect():  # at most size rows
        out[r[column]] = r["n"]
    return out


def pack(tokens: DataFrame, capacity: int, most: int = 1 << 20) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens, container_no): every item in one container of that capacity.

    tokens(doc_id, n_tokens). Items longer than the capacity are cut into pieces of the capacity and a rest; a whole
    piece fills a container by itself. Items of no tokens and of unknown size need no room and have container_no
    null. Rows with equal ids are separate items; a null id is an id. Containers are numbered from 0 without gaps.
    """
    if not 1 <= capacity <= most:
        raise ValueError(f"capacity must be from 1 to {most}")
    base = tokens.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_all"))
    whole = F.floor(F.col("n_all") / capacity).cast("int")
    rest = base.withColumn("piece_no", whole).withColumn("n_tokens", (F.col("n_all") % capacity).cast("int")).withColumn("start_token", F.col("piece_no").cast("bigint") * capacity)
    none = rest.filter("n_all = 0").select("doc_id", "piece_no", "start_token", "n_tokens", F.lit(None).cast("bigint").alias("container_no"))
    items = cut(rest.filter("n_tokens > 0").select("doc_id", "piece_no", "start_token", "n_tokens"), "items")
    counts = _histogram(items, "n_tokens", capacity + 1)
    runs, groups, n_large = plan_large(counts, capacity)
    columns = ["doc_id", "piece_no", "start_token", "n_tokens"]
    parts, used = [], None
    if groups:
        of_size = F.lit(-1)
        for g, (low, high, _) in enumerate(groups):
            of_size = F.when(F.col("n_tokens").between(low, high), g).otherwise(of_size)
        large = _ranked(items.filter(F.col("n_tokens") >= groups[-1][0]).withColumn("grp", of_size.cast("int")), "grp", int(counts.sum()))
        k, s, f, e = _columns(runs, 0, 1, 3, 4)
        large = cut(_placed(large, k, s, f, e, np.zeros(len(k), np.int64), "grp").select(*columns, F.col("place").alias("container_no")), "large")
        parts.append(large)
        used = large.groupBy("container_no").agg(F.sum("n_tokens").alias("used")).select("container_no", (F.lit(capacity) - F.col("used")).cast("int").alias("free"))
        used = cut(used, "used")
    smallest = groups[-1][0] if groups else capacity + 1
    small_counts = counts.copy()
    small_counts[smallest:] = 0
    free = _histogram(used, "free", capacity + 1) if used is not None else np.zeros(capacity + 1, np.int64)
    small_runs, n_new = plan_small(small_counts, free, capacity)
    if small_runs:
        small = _ranked(items.filter(F.col("n_tokens") < smallest), "n_tokens", int(counts.sum()))
        k, s, c, f, e = _columns(small_runs, 0, 1, 3, 4, 5)
        small = _placed(small, k, s, f, e, c, "n_tokens")
        parts.append(small.filter("cls = -1").select(*columns, (F.col("place") + n_large).alias("container_no")))
        if used is not None:
            open_ = bucketed_prefix_sum(used.filter("free > 0").withColumn("_bucket", salt("container_no", buckets=buckets_for(n_large))), ["free"], ["_bucket"], [F.col("container_no")], F.lit(1).cast("bigint"), "_upto")
            open_ = open_.select(F.col("free").alias("cls"), (F.col("_upto") - 1).alias("place"), "container_no")
            parts.append(small.filter("cls >= 0").join(open_, ["cls", "place"]).select(*columns, "container_no"))
    # whole pieces, numbered after all others
    full = base.filter(F.col("n_all") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), (whole - 1))).alias("piece_no"))
    n_full = base.agg(F.coalesce(F.sum(F.floor(F.col("n_all") / capacity)), F.lit(0))).first()[0]  # one number
    full = _ranked(full.withColumn("one", F.lit(0)), "one", int(n_full)).select("doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("start_token"), F.lit(capacity).alias("n_tokens"), (F.col("rank") + n_large + n_new).alias("container_no"))
    out = none.unionByName(full)
    for p in parts:
        out = out.unionByName(p)
    return out


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers used, the least possible number, tokens, and the share of room in use."""
    total = packed.filter("container_no IS NOT NULL").agg(F.count_distinct("container_no").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return total.select(F.lit(capacity).alias("capacity_tokens"), "n_containers", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"), "n_tokens", F.try_divide(F.col("n_tokens"), F.col("n_containers") * capacity).alias("fill_share"))
