"""Mixing sources to target shares of all tokens, by systematic sampling.

Each document of a source is expected in equally many copies. Summed up over the source's documents, with one random
offset, the expected copies cross whole numbers; a document comes once for each that it crosses.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.ranks import salt
from marlstone.functions.strings import folded
from marlstone.session import cut

#: Buckets, at least, in which documents of one size are ranked, and rows that are too many for one; offsets that are
#: tried; documents that a share holds at least.
BUCKETS, ROWS_A_BUCKET, OFFSETS, LEAST_DOCS = 64, 1_000_000, 64, 10


def plan(sizes: dict[str, tuple[int, int]], weights: dict[str, tuple[float, int]], total_tokens: int | None = None, least_docs: int = LEAST_DOCS) -> dict[str, dict]:
    """For each source with a weight: share, the tokens wanted of it, and expected copies of a document.

    sizes are (documents, tokens). A source is wanted to hold its share of total_tokens; one that cannot, even with each
    document max_repeats times, falls short, and no other source gets more or less for that. Without total_tokens it is
    the largest at which every source holds its share, but at least so large that each share is worth least_docs of the
    source's mean documents (or all it has): a source of a few tokens does not empty the others but falls short. Shares
    of sources without any tokens are spread over the others in proportion.
    """
    live = {s: w for s, w in weights.items() if w[0] > 0 and w[1] > 0 and sizes.get(s, (0, 0))[1] > 0}
    scale = math.fsum(w[0] for w in live.values())
    share = {s: live[s][0] / scale if s in live else 0.0 for s in weights}
    total = float(total_tokens) if total_tokens is not None else 0.0
    if total_tokens is None and live:
        least = max(min(least_docs, w[1] * sizes[s][0]) * sizes[s][1] / sizes[s][0] / share[s] for s, w in live.items())
        most = max(w[1] * sizes[s][1] / share[s] for s, w in live.items())  # beyond it every source is short
        total = min(max(min(w[1] * sizes[s][1] / share[s] for s, w in live.items()), least), most)
    out = {}
    for s in sorted(weights):
        copies = min(share[s] * total / sizes[s][1], float(weights[s][1])) if s in live else 0.0
        out[s] = {"share": share[s], "wanted": share[s] * total, "copies": copies}
    return out


def _wanted(weights: DataFrame, most_sources: int) -> dict[str, tuple[float, int]]:
    rows = weights.select(folded(F.col("source")).alias("s"), "target_share", "max_repeats").limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    want: dict[str, tuple[float, int]] = {}
    for r in rows:
        if r["s"] is not None and r["target_share"] is not None and r["max_repeats"] is not None:
            w, c = want.get(r["s"], (0.0, r["max_repeats"]))
            want[r["s"]] = (w + r["target_share"], min(c, r["max_repeats"]))
    return want


def _crossed(before: Column, upto: Column, copies: Column, offset: Column) -> Column:
    """How many whole numbers the expected copies of the documents behind before, up to upto, cross."""
    return F.floor(upto * copies + offset) - F.floor(before * copies + offset)


def _per_source(at: dict[str, dict], field: str) -> Column:
    return F.create_map(*[c for s, p in at.items() for c in (F.lit(s), F.lit(p[field]))])[F.col("source")] if at else F.lit(0.0)


def mix(tokens: DataFrame, weights: DataFrame, total_tokens: int | None = None, seed: int = 17, most_sources: int = 10_000) -> DataFrame:
    """(doc_id, source, n_tokens, copies): a row for each document that comes at least once.

    tokens(doc_id, source, n_tokens), weights(source, target_share, max_repeats); total_tokens as in plan. Sources are
    compared without case and outer spaces; documents without a source or of one without a weight are not chosen, nor
    are documents of no tokens. Rows are separate documents, even with equal ids. Weights given twice add up, with the
    smaller cap; null weights and caps are none. More than most_sources weights raise an error.

    Documents of a source are in order of size, then of a hash. Each source's offset is drawn at random among those
    OFFSETS evenly spaced ones that bring its tokens nearest to what is wanted; all of them are tried on the numbers of
    documents of each size, a table with a row for each size, so that a share is missed by less than a document.
    """
    want = _wanted(weights, most_sources)
    docs = tokens.select("doc_id", folded(F.col("source")).alias("source"), "n_tokens")
    weighed = docs.filter(F.col("source").isin(*want) & (F.col("n_tokens") > 0)) if want else docs.filter("false")
    sized = cut(weighed.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "by-size")
    sizes = {r["source"]: (r["n"], r["t"]) for r in sized.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n_tokens")).alias("t")).collect()}  # a row for each weight
    at = {s: p for s, p in plan(sizes, want, total_tokens).items() if p["copies"] > 0}
    upto = F.sum("n").over(W.partitionBy("source").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0))  # a row for each size
    ranked_sizes = sized.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("n"))
    chance = random.Random(seed)
    tries = {s: [(i + chance.random()) / OFFSETS for i in range(OFFSETS)] for s in sorted(at)}
    e = _per_source(at, "copies")
    made = [F.sum(F.col("n_tokens") * _crossed(F.col("_before"), F.col("_upto"), e, _per_source({s: {"u": t[i]} for s, t in tries.items()}, "u"))).alias(f"u{i}") for i in range(OFFSETS)]
    for r in ranked_sizes.groupBy("source").agg(*made).collect() if at else []:  # a row for each weight
        if r["source"] in at:
            goal = at[r["source"]]["copies"] * sizes[r["source"]][1]
            off = [abs(r[f"u{i}"] - goal) for i in range(OFFSETS)]
            at[r["source"]]["offset"] = tries[r["source"]][chance.choice([i for i in range(OFFSETS) if off[i] == min(off)])]
    # within a size, which may have a third of all documents, ranks are counted in buckets
    buckets = max(BUCKETS, sum(n for n, _ in sizes.values()) // ROWS_A_BUCKET)
    bucketed = weighed.withColumn("_bucket", salt("doc_id", buckets=buckets))
    sums = bucketed.groupBy("source", "n_tokens", "_bucket").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("source", "n_tokens").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(ranked_sizes.select("source", "n_tokens", "_before"), ["source", "n_tokens"])
    within = F.row_number().over(W.partitionBy("source", "n_tokens", "_bucket").orderBy("doc_id"))
    ranked = bucketed.withColumn("_within", within).join(sums.select("source", "n_tokens", "_bucket", (F.col("_earlier") + F.col("_before")).alias("_base")), ["source", "n_tokens", "_bucket"])
    rank = F.col("_base") + F.col("_within")
    copies = _crossed(rank - 1, rank, e, _per_source(at, "offset"))
    return ranked.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).filter("copies > 0")


def shares(tokens: DataFrame, weights: DataFrame, mixture: DataFrame, total_tokens: int | None = None, most_sources: int = 10_000) -> DataFrame:
    """The shares that a mixture reached: a row for each source of tokens or weights, with target_share, n_docs,
    n_tokens, wanted_tokens (its share of the total that the mixture was made for), mixed_tokens, reached_share,
    most_copies, and short: whether the cap kept it below its share; 0 where there is nothing."""
    want = _wanted(weights, most_sources)
    have = cut(tokens.groupBy(folded(F.col("source")).alias("source")).agg(F.count("*").alias("n_docs"), F.count_if(F.col("n_tokens") > 0).alias("n"), F.sum("n_tokens").alias("n_tokens")), "sources")
    sizes = {r["source"]: (r["n"], r["n_tokens"]) for r in have.filter(F.col("source").isin(*want) & (F.col("n_tokens") > 0)).collect()} if want else {}  # a row for each weight
    planned = plan(sizes, want, total_tokens)
    got = cut(mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies")), "shares")
    total = got.agg(F.sum("mixed_tokens")).first()[0] or 0  # one number
    rows = [(s, w[0], int(planned[s]["wanted"]), planned[s]["wanted"] > planned[s]["copies"] * sizes.get(s, (0, 0))[1] + 0.5) for s, w in want.items()]
    goal = tokens.sparkSession.createDataFrame(rows, "source string, target_share double, wanted_tokens bigint, short boolean")
    both = have.select(F.col("source").alias("s"), "n_docs", "n_tokens").join(goal, F.col("s").eqNullSafe(F.col("source")), "full")
    both = both.select(F.coalesce("s", "source").alias("source"), "target_share", "n_docs", "n_tokens", "wanted_tokens", "short").join(got, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    reached = F.coalesce(F.try_divide(F.col("mixed_tokens"), F.lit(total)), F.lit(0.0))
    return both.select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), *[zero(c) for c in ("n_docs", "n_tokens", "wanted_tokens", "mixed_tokens")],
        reached.alias("reached_share"), zero("most_copies"), F.coalesce("short", F.lit(False)).alias("short"),
    )
