"""One surviving record for each group of duplicates, field by field.

Fields are turned into long rows; each normalised value of a field collects votes; the value with the best votes and
the best record behind it win by max_by; the winners are turned back into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.strings import letters_digits

# --- fixed values: words that stand for "no value", as letters and digits ---
NO_VALUE = ("na", "none", "null", "nil", "tbd", "tba", "unknown", "undefined", "notavailable", "notapplicable", "novalue")
# --- end of fixed values ---

OLDEST = -(2**62)
LEAST_DECAY = 0.001
FIELDS = ("name", "context", "attributes")


def _attributes(c: Column) -> Column:
    """The different attributes, as letters and digits, without blanks and fillers; null lists have none."""
    keys = F.transform(F.coalesce(c, F.array().cast("array<string>")), letters_digits)
    return F.array_sort(F.array_distinct(F.filter(keys, lambda x: x.isNotNull() & (F.length(x) > 0) & ~x.isin(*NO_VALUE))))


def survivors(df: DataFrame, trust: DataFrame, half_life_days: float = 180.0, spelled: bool = False) -> DataFrame:
    """One row for each group of two or more record_ids with equal model_id, context key and name key.

    Columns: group_id (the smallest record_id), model_id, n_records (its different rows), and for each of name, context and attributes the
    winning value, the record_id that supplies it (null for attributes if no record has any) and the winner's votes.

    A record's vote is its source's trust times its recency decay; the votes of a normalised value of a field are
    summed up. The value that max_by chooses is, in this order, the most complete one, the one with the largest sum,
    and of its records the best one supplies the spelling: for name by trust, time and record_id; for context by time,
    trust and record_id; for attributes by trust, time and record_id. Normalised, the names and contexts of a group
    are one value, and lists of attributes are told by how many different ones they hold (completeness is theirs
    alone). With spelled, the spellings of name and context and the sets of attributes stand for election separately.
    Votes are decimals, so that their sums do not depend on the order of rows.

    Trust: rank 1 is best, sources not listed and null come after all; null times are oldest and have decayed to the
    least vote, a thousandth of their trust, as have times long past. Null names, contexts and models, and ones
    without a letter or digit, form no group. Repeated rows count once. Nothing is collected: a group of any size is
    combined before it moves, and extra columns are not read.
    """
    best = _elected(df, trust, half_life_days, spelled)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}.id").alias("record_id"), F.col(f"_{f}.row").alias("row")) for f in FIELDS])
    asked = best.select("_g", F.explode(each).alias("e")).select("_g", "e.*").filter("record_id IS NOT NULL")
    # only the winners' values move: the election is held over numbers
    value = F.when(F.col("field") == "name", F.col("name")).when(F.col("field") == "context", F.col("context")).otherwise(F.to_json("attributes"))
    rows = df.select(F.col("record_id").alias("_id"), _content().alias("_row"), "name", "context", "attributes").distinct()
    won = asked.join(rows, (F.col("record_id") == F.col("_id")) & (F.col("row") == F.col("_row"))).select("_g", "field", value.alias("value"))
    values = won.groupBy("_g").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])
    out = best.join(values, "_g").withColumn("attributes", F.from_json("attributes", "array<string>"))
    return out.select("group_id", "model_id", "n_records", *[c for f in FIELDS for c in (F.col(f), F.col(f"_{f}.id").alias(f"{f}_record"), F.col(f"_{f}.votes").alias(f"{f}_votes"))])


def _content() -> Column:
    """What tells rows of one record_id apart that are no repeats."""
    return F.xxhash64("context", "name", "attributes", "source", "extracted_at")


def _elected(df: DataFrame, trust: DataFrame, half_life_days: float = 180.0, spelled: bool = False) -> DataFrame:
    """(_g, group_id, model_id, n_records, _name, _context, _attributes): the winners of each group, as (id, row, votes).

    Groups are told by 128 bits of hash of model, context key and name key, so that the long rows hold numbers only.
    """
    worst = trust.agg(F.coalesce(F.max("trust_rank"), F.lit(0)) + 1).first()[0]  # one number
    newest = df.agg(F.max("extracted_at").cast("timestamp").alias("t")).first()["t"]  # one time
    ranks = trust.filter("source IS NOT NULL").groupBy(F.col("source").alias("_source")).agg(F.min("trust_rank").alias("_rank"))
    rows = df.select("record_id", "model_id", "context", "name", "attributes", "source", "extracted_at", _content().alias("row"))
    rows = rows.withColumn("_c", letters_digits(F.col("context"))).withColumn("_n", letters_digits(F.col("name"))).withColumn("_a", _attributes(F.col("attributes")))
    rows = rows.filter("model_id IS NOT NULL AND record_id IS NOT NULL AND length(_c) > 0 AND length(_n) > 0")
    rows = rows.join(ranks, F.col("source") == F.col("_source"), "left").withColumn("trust", -F.coalesce("_rank", F.lit(worst)).cast("bigint"))
    stamp = F.col("extracted_at").cast("timestamp")
    days = (F.lit(newest).cast("timestamp").cast("double") - stamp.cast("double")) / 86400
    decay = F.when(days.isNull(), LEAST_DECAY).otherwise(F.greatest(F.lit(LEAST_DECAY), F.pow(F.lit(0.5), days / half_life_days)))
    vote = ((F.lit(worst + 1) + F.col("trust")) * decay).cast("decimal(18,6)")
    ballot = (lambda c: F.xxhash64(c)) if spelled else (lambda c: F.lit(0).cast("bigint"))
    rows = rows.select(
        F.struct(F.xxhash64("model_id", "_c", "_n").alias("a"), F.xxhash64("_n", F.lit(1), "_c", "model_id").alias("b")).alias("_g"), "model_id", "record_id", "row", "trust",
        F.coalesce(F.unix_micros(stamp), F.lit(OLDEST)).alias("time"), vote.alias("vote"), F.size("_a").alias("n"), ballot(F.trim("name")).alias("bn"), ballot(F.trim("context")).alias("bc"), ballot(F.col("_a")).alias("ba"),
    ).distinct()  # repeated rows vote once

    def field(no: int, lead: Column, ballot: str, *rank: str) -> Column:
        order = F.struct(*[F.col(r).alias(x) for x, r in zip("ab", rank)], (-F.col("record_id")).alias("c"), F.col("row").alias("d"))
        return F.struct(F.lit(no).alias("field"), lead.alias("lead"), F.col(ballot).alias("ballot"), order.alias("rank"))

    fields = F.array(field(0, F.lit(0), "bn", "trust", "time"), field(1, F.lit(0), "bc", "time", "trust"), field(2, F.col("n"), "ba", "trust", "time"))
    long = rows.select("_g", "model_id", "vote", F.explode(fields).alias("f")).select("_g", "model_id", "vote", "f.*")
    ballots = long.groupBy("_g", "field", "lead", "ballot").agg(F.sum("vote").alias("votes"), F.max("rank").alias("rank"), F.max("rank.c").alias("low"), F.min("rank.c").alias("high"), F.count("*").alias("n"), F.first("model_id").alias("model_id"))
    has = (F.col("field") < 2) | (F.col("lead") > 0)
    best = F.max_by(F.struct((-F.col("rank.c")).alias("id"), F.col("rank.d").alias("row"), "votes"), F.when(has, F.struct("lead", "votes", "rank")))
    won = ballots.groupBy("_g", "field").agg(best.alias("best"), F.max("low").alias("low"), F.min("high").alias("high"), F.sum("n").alias("n"), F.first("model_id").alias("model_id"))
    of = lambda i, c: F.max(F.when(F.col("field") == i, F.col(c)))
    out = won.groupBy("_g").agg((-F.max("low")).alias("group_id"), (-F.min("high")).alias("_high"), F.first("model_id").alias("model_id"), of(0, "n").alias("n_records"), *[of(i, "best").alias(f"_{f}") for i, f in enumerate(FIELDS)])
    return out.filter("group_id <> _high").drop("_high")


def suppliers(df: DataFrame, trust: DataFrame, half_life_days: float = 180.0, spelled: bool = False) -> DataFrame:
    """(group_id, field, record_id): which record supplies each field of the survivors, without their values."""
    best = _elected(df, trust, half_life_days, spelled)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}.id").alias("record_id")) for f in FIELDS])
    return best.select("group_id", F.explode(pairs).alias("p")).select("group_id", "p.field", "p.record_id").filter("record_id IS NOT NULL")
