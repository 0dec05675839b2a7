"""References to records that do not exist, over time, and their cascade.

Liveness at a time is found by a sweep: starts, ends and references of one key are sorted by time and summed up.
The sweep is cut into days, so that a key which holds a large share of all rows is spread over tasks. The cascade goes
from the records found orphaned last to the names they bear and on to the references to these names, until none is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.strings import is_blank, letters_digits
from marlstone.session import cut, rounds


def latest_by(df: DataFrame, key: str, at: str) -> DataFrame:
    """The delivery of each key with the latest time; ties and null times go to the largest content."""
    rest = [c for c in df.columns if c not in (key, at)]
    best = df.groupBy(key).agg(F.max_by(F.struct(at, *rest), F.struct(F.col(at), *[F.col(c) for c in rest])).alias("_best"))
    return best.select(key, "_best.*")


def sweep(candidates: DataFrame, refs: DataFrame, keys: list[str], start: str, end: str, at: str) -> DataFrame:
    """refs with n_live, n_known and n_all: how many candidates of equal keys are live at the reference's time
    (start <= at and (end null or end > at)), started by then, and exist at all.

    keys are columns of both; rows of candidates with a null start are never live or started. refs keeps its
    columns. Nothing pairs candidates with references, and no join is needed: each (keys, day) that is asked gets one
    row with the sums of the days before, and then marks and references are summed up in order of time.
    """
    live = F.when(F.col(end).isNull() | (F.col(end) > F.col(start)), 1).otherwise(0)
    begin = candidates.select(*keys, F.col(start).alias("_t"), F.col(start).isNotNull().cast("bigint").alias("_known"), F.when(F.col(start).isNull(), 0).otherwise(live).cast("bigint").alias("_live"), F.lit(1).cast("bigint").alias("_all"))
    none = F.lit(0).cast("bigint")
    finish = candidates.filter(F.col(end) > F.col(start)).select(*keys, F.col(end).alias("_t"), none.alias("_known"), F.lit(-1).cast("bigint").alias("_live"), none.alias("_all"))
    day = F.to_date("_t").alias("_day")
    marks = begin.unionByName(finish).select(*keys, "_t", day, "_known", "_live", "_all")
    asked = refs.select(*keys, F.to_date(at).alias("_day"), none.alias("_known"), none.alias("_live"), none.alias("_all"), F.lit(True).alias("_asked"))
    days = marks.select(*keys, "_day", "_known", "_live", "_all", F.lit(False).alias("_asked")).unionByName(asked)
    days = days.groupBy(*keys, "_day").agg(*[F.sum(c).alias(c) for c in ("_known", "_live", "_all")], F.bool_or("_asked").alias("_asked"))
    every, earlier = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(F.asc_nulls_first("_day")).rowsBetween(W.unboundedPreceding, -1)
    carried = days.select(*keys, "_day", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_known", "_live")], F.sum("_all").over(every).alias("_all"), "_asked").filter("_asked")
    ref = refs.select(*keys, F.col(at).alias("_t"), F.to_date(at).alias("_day"), F.struct(*[F.col(c) for c in refs.columns]).alias("_ref"))
    no_ref, no_time = F.lit(None).cast(ref.schema["_ref"].dataType).alias("_ref"), F.lit(None).cast(ref.schema["_t"].dataType).alias("_t")
    columns = [*keys, "_day", "_t", "_order", "_known", "_live", "_all", "_ref"]
    rows = carried.select("*", no_time, F.lit(0).alias("_order"), no_ref).select(columns)
    rows = rows.unionByName(marks.filter("_t IS NOT NULL").select("*", F.lit(1).alias("_order"), no_ref).withColumn("_all", none).select(columns))
    rows = rows.unionByName(ref.select("*", F.lit(2).alias("_order"), *[none.alias(c) for c in ("_known", "_live", "_all")]).select(columns))
    upto = W.partitionBy(*keys, "_day").orderBy(F.asc_nulls_first("_t"), "_order").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.select("_ref", *[F.sum(f"_{c}").over(upto).alias(f"n_{c}") for c in ("live", "known", "all")]).filter("_ref IS NOT NULL")
    return summed.select("_ref.*", "n_live", "n_known", "n_all")


def members(df: DataFrame, no: int, key: str, columns: list[str], listed: str) -> DataFrame:
    """The non-blank members of a list column with their numbers: all members are counted, from 0."""
    return df.select(F.lit(no).alias("table_no"), F.col(key).alias("context_id"), *columns, F.posexplode(listed).alias("dep_no", "dep")).filter(~is_blank(F.col("dep")))


TABLES = ("bounded_contexts", "shared_contexts")
REF, RECORD, NAME = ["table_no", "context_id", "dep_no", "registered_at"], ["table_no", "context_id"], ["name_a", "name_b"]


def _name_key(scope: Column, name: Column) -> list[Column]:
    """A scope's name as 128 bits of hash: the rows of sweeps and rounds hold numbers only."""
    return [F.xxhash64(scope, name).alias("name_a"), F.xxhash64(name, F.lit("|"), scope).alias("name_b")]


def _table_name() -> Column:
    return F.when(F.col("table_no") == 0, TABLES[0]).otherwise(TABLES[1]).alias("table_name")


def registry(contexts: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bearers, links): the names that records bear, with their times, and the names that references ask for.

    Of a context delivered again the latest delivery counts; shared contexts are taken as they are, repeated rows once.
    A reference of a context asks for its name within its model and among the shared ones, one of a shared context
    among the shared ones only. Null and blank members and names are no references and no bearers (a name with neither
    letters nor digits is borne by nobody); null lists give no rows.
    """
    columns = ["context_id", "context_name", "allowed_dependencies", "registered_at", "removed_at"]
    own = cut(latest_by(contexts.select("model_id", *columns, "loaded_at"), "context_id", "loaded_at").select("model_id", *columns), "latest")
    common = shared.select(F.lit(None).cast("bigint").alias("model_id"), *columns).distinct()
    name = letters_digits(F.col("context_name"))
    bears = lambda df, no, scope: df.filter(F.length(name) > 0).select(F.lit(no).alias("table_no"), "context_id", *_name_key(scope, name), "registered_at", "removed_at")
    bearers = bears(own.filter("model_id IS NOT NULL"), 0, F.col("model_id").cast("string")).unionByName(bears(common, 1, F.lit("*")))
    refs = members(own, 0, "context_id", ["model_id", "registered_at"], "allowed_dependencies").unionByName(members(common, 1, "context_id", ["model_id", "registered_at"], "allowed_dependencies"))
    scopes = F.filter(F.array(F.col("model_id").cast("string"), F.lit("*")), lambda s: s.isNotNull())
    return bearers, refs.select(*REF, letters_digits(F.col("dep")).alias("name"), F.explode(scopes).alias("scope")).select(*REF, *_name_key(F.col("scope"), F.col("name")))


def resolved(bearers: DataFrame, links: DataFrame, ref: list[str]) -> DataFrame:
    """(ref, n_live, n_known, n_all): how many bearers of its name each reference has, of all its scopes."""
    swept = sweep(bearers.select(*NAME, "registered_at", "removed_at"), links.select(*ref, *NAME), NAME, "registered_at", "removed_at", "registered_at")
    return swept.groupBy(*ref).agg(*[F.sum(c).alias(c) for c in ("n_live", "n_known", "n_all")])


#: Rows of a written table up to which it is sent to all executors; beyond, the same join shuffles.
MOST_SENT = 1_000_000


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_SENT else df


def orphans(contexts: DataFrame, shared: DataFrame) -> DataFrame:
    """Every reference that is an orphan: (table_name, context_id, dep_no, registered_at, reason, period, depth, direct).

    A reference is a direct orphan (depth 0) if no bearer of its name is live at its record's registration; reason:
    deleted if one was registered by then, else later if there is one, else missing. It is inherited (reason
    inherited) if it has live bearers and all of them are orphaned: records with an orphan among their references. Its
    depth is the round in which the last of them was found; so one sound bearer keeps a reference sound, and cycles
    of sound records stay sound. Records are keyed by table and id. Null times are never live; empty tables give no rows.

    Each round is a semi-join of the bearers with the records found last, one of the references with the names these
    bear, and a sweep over both; how many of its live bearers are orphaned is carried on for each reference, so no
    bearer is ever paired with a reference. Rounds go on until no record is new, however deep the graph is.
    """
    spark = contexts.sparkSession
    bearers, links = registry(contexts, shared)
    bearers, links = cut(bearers, "bearers"), cut(links, "links")
    known = cut(resolved(bearers, links, REF), "resolved")
    reason = F.when(F.col("n_known") > 0, "deleted").when(F.col("n_all") > 0, "later").otherwise("missing")
    refs, records = rounds(spark, "orphan-refs"), rounds(spark, "orphan-records")
    none = F.lit(0).cast("bigint")
    # lost and open: how many live bearers are orphaned, and how many there are; an orphan has lost them all
    part = refs.add(known.filter("n_live = 0").select(*REF, none.alias("open"), none.alias("lost"), reason.alias("reason")))
    last = records.add(part.select(*RECORD).distinct())
    # only references with live bearers can be inherited; null times have none, so no key of this join is null
    links = cut(links.join(known.filter("n_live > 0").select(*REF, F.col("n_live").alias("open")), REF), "live-links")
    partly = part.filter("lost < open").select(*REF, "open", "lost")
    while n_last := last.count():
        names = cut(bearers.join(_sent(last, n_last), RECORD, "left_semi").select(*NAME, "registered_at", "removed_at"), "names")
        asked = links.join(_sent(names.select(*NAME).distinct(), names.count()), NAME, "left_semi")
        lost = resolved(names, asked, [*REF, "open"]).filter("n_live > 0").select(*REF, "open", F.col("n_live").alias("lost"))
        part = refs.add(lost.unionByName(partly).groupBy(*REF, "open").agg(F.sum("lost").alias("lost")).withColumn("reason", F.lit("inherited")))
        partly = part.filter("lost < open").select(*REF, "open", "lost")
        last = records.add(part.filter("lost >= open").select(*RECORD).distinct().join(records.all(), RECORD, "left_anti"))
    found = refs.all().filter("lost >= open")
    return found.select(_table_name(), "context_id", "dep_no", "registered_at", "reason", F.date_format("registered_at", "yyyy-MM").alias("period"), F.col("round").alias("depth"), (F.col("round") == 0).alias("direct"))


def states(found: DataFrame) -> DataFrame:
    """(table_name, context_id, depth, direct): every record with an orphan, the smallest depth counting."""
    return found.groupBy("table_name", "context_id").agg(F.min("depth").alias("depth"), F.bool_or("direct").alias("direct"))


def report(found: DataFrame) -> DataFrame:
    """Counts of orphans per table, month and reason (deleted, later and missing are direct, inherited ones are not)."""
    return found.groupBy("table_name", "period", "reason").agg(F.count("*").alias("n_refs"), F.count_distinct("context_id").alias("n_contexts"))


def levels(found: DataFrame) -> DataFrame:
    """Per table and month of registration: references and contexts that are direct or only inherited orphans.

    A null time is a period of its own; months without orphans give no rows.
    """
    one = found.groupBy("table_name", "context_id", "period").agg(F.count_if("direct").alias("d"), F.count_if(~F.col("direct")).alias("i"))
    return one.groupBy("table_name", "period").agg(F.sum("d").alias("n_direct_refs"), F.sum("i").alias("n_inherited_refs"), F.count_if(F.col("d") > 0).alias("n_direct"), F.count_if(F.col("d") == 0).alias("n_inherited"))
