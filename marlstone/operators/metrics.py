"""Usage, cost and validation metrics as aggregations over append-only logs; and token sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.ranks import bucketed_prefix_sums

# --- fixed values: prices in dollars for a million tokens, and the projected use ---
INPUT_PRICE, OUTPUT_PRICE, CACHED_PRICE = "0.30", "2.50", "0.03"
A_DAY, DAYS = 1000, 30
CHARS_A_TOKEN = 4
# --- end of fixed values ---

EXACT = "decimal(38,9)"


def token_estimate(text: Column) -> Column:
    """Tokens of a text, offline: a token for each four characters, rounded up; null has none."""
    return F.coalesce(F.ceil(F.length(text) / CHARS_A_TOKEN), F.lit(0)).cast("bigint")


def normalised_calls(df: DataFrame) -> DataFrame:
    """Calls with null counts as 0 and prompt_tokens without cached ones; total_tokens is what is billed."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    cached = n("cached_tokens") if "cached_tokens" in df.columns else F.lit(0).cast("bigint")
    billed = n("prompt_tokens") - cached
    return df.withColumn("cached_tokens", cached).withColumn("completion_tokens", n("completion_tokens")).withColumn("prompt_tokens", billed).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def cost(prompt: Column, completion: Column, cached: Column | None = None) -> Column:
    """Dollars, exact, to six digits; cached tokens cost nothing unless given."""
    price = lambda c, p: c.cast("decimal(20,0)") * F.lit(p).cast("decimal(6,2)")
    total = price(prompt, INPUT_PRICE) + price(completion, OUTPUT_PRICE) + (price(cached, CACHED_PRICE) if cached is not None else F.lit(0).cast("decimal(6,2)"))
    return F.round(total / F.lit(1_000_000).cast("decimal(7,0)"), 6).cast("decimal(18,6)")


def usage(calls: DataFrame) -> DataFrame:
    """Totals and stages in one pass: stage null is the total. Sums of no rows are 0."""
    sums = [F.count("*").alias("call_count"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]]
    out = calls.rollup("stage").agg(F.grouping("stage").alias("is_total"), *sums, F.min("timestamp").alias("first_seen"))
    return out.withColumn("estimated_cost", cost(F.col("prompt_tokens"), F.col("completion_tokens")))


def totals(calls: DataFrame) -> DataFrame:
    """One row of totals, zeros for an empty log."""
    n = calls.agg(F.count("*").alias("total_api_calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}" if c != "total_tokens" else c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])
    return n.withColumn("total_cost", cost(F.col("total_prompt_tokens"), F.col("total_completion_tokens")))


def usage_report(calls: DataFrame) -> DataFrame:
    """One row with a JSON report: summary, cost, and stages in order of first use. The calls are history's rows."""
    stages = calls.groupBy("stage").agg(F.count("*").alias("call_count"), *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")], F.min("timestamp").alias("first"))
    stages = stages.withColumn("estimated_cost", cost(F.col("prompt_tokens"), F.col("completion_tokens")))
    listed = stages.agg(F.array_sort(F.collect_list(F.struct("first", "stage", "call_count", "prompt_tokens", "completion_tokens", "total_tokens", "estimated_cost"))).alias("stages"))  # a row for each stage
    one = totals(calls).withColumn("_one", F.lit(1)).join(listed.withColumn("_one", F.lit(1)), "_one")
    fields = [F.struct("total_api_calls", "total_prompt_tokens", "total_completion_tokens", "total_tokens").alias("summary"), F.struct("total_cost", F.lit("USD").alias("currency")).alias("cost_estimation"), F.col("stages").alias("stage_breakdown")]
    return one.select(F.to_json(F.struct(*fields)).alias("report"))


CALL_FIELDS = ("timestamp", "stage", "operation", "prompt_tokens", "completion_tokens", "total_tokens")
VALIDATION_FIELDS = ("timestamp", "filename", "file_size_chars", "code_file_tokens", "validation_time_ms", "violations_count", "violation_types", "has_sources")


def history(log: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The rows of a log for a detailed report, a JSON object each: however long a log is, no row holds all of it."""
    return log.select(F.to_json(F.struct(*[c for c in fields if c in log.columns])).alias("entry"))


def recorded(files: DataFrame) -> DataFrame:
    """Validations from files with violations(array<struct<type,...>>): counts and types; a missing type is 'Unknown'.
    Files that failed before detection (syntax, no model) are not recorded."""
    early = F.exists("violations", lambda v: v["type"].isin("SyntaxError", "ConfigError"))
    kept = files.filter(~F.coalesce(early, F.lit(False)))
    return kept.withColumn("violations_count", F.coalesce(F.when(F.col("violations").isNotNull(), F.size("violations")), F.lit(0)).cast("bigint")).withColumn("violation_types", F.coalesce(F.transform("violations", lambda v: F.coalesce(v["type"], F.lit("Unknown"))), F.array().cast("array<string>")))


def type_histogram(validations: DataFrame) -> DataFrame:
    """(violation_type, n) over all violations."""
    return validations.select(F.explode("violation_types").alias("violation_type")).groupBy("violation_type").agg(F.count("*").alias("n"))


def sorted_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts, most first, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def share(part: Column, whole: Column, percent: bool = False) -> Column:
    """part of whole; 0 for a whole of 0."""
    return F.coalesce(F.try_divide(part * (100.0 if percent else 1.0), whole), F.lit(0.0))


def validation_parts(v: DataFrame) -> DataFrame:
    """One row of sums from which a summary is made; the sums of parts of a log are those of the log."""
    n = lambda c: F.coalesce(c, F.lit(0))
    time = F.col("validation_time_ms").cast(EXACT)
    return v.agg(
        F.count("*").alias("n"), F.count_if(F.col("violations_count") > 0).alias("n_with"), F.count_if(F.col("violations_count") == 0).alias("n_without"), n(F.sum("violations_count")).alias("found"),
        F.count(time).alias("n_timed"), n(F.sum(time)).alias("time"), n(F.sum("file_size_chars")).alias("size"), n(F.sum("code_file_tokens")).alias("tokens"), F.count_if("has_sources").alias("n_sources"),
    )


def summarised(parts: DataFrame) -> DataFrame:
    """One row of parts: files with and without violations, rates, means and sums; zeros for an empty log."""
    one = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_with", "n_without", "found", "n_timed", "time", "size", "tokens", "n_sources")])
    n, mean = F.col("n"), lambda c: F.round(share(F.col(c), F.col("n")), 2)
    rate = lambda c: F.round(share(F.col(c), n, True), 2)
    time = F.coalesce(F.try_divide(F.col("time"), F.col("n_timed")), F.lit(0)).cast("double")
    return one.select(
        n.alias("total_validations"), F.col("n_with").alias("files_with_violations"), F.col("n_without").alias("files_without_violations"), rate("n_with").alias("violation_rate_percent"),
        F.col("found").alias("total_violations_found"), mean("found").alias("avg_violations_per_file"), F.round(time, 2).alias("avg_validation_time_ms"), F.round(F.col("time").cast("double"), 2).alias("total_validation_time_ms"),
        mean("size").alias("avg_code_size_chars"), F.col("size").alias("total_code_size_chars"), mean("tokens").alias("avg_code_tokens"), F.col("tokens").alias("total_code_tokens"),
        F.col("n_sources").alias("validations_with_sources"), rate("n_sources").alias("source_attachment_rate_percent"),
    )


def validation_summary(v: DataFrame) -> DataFrame:
    """One row: files with and without violations, rates, means and sums; zeros for an empty log."""
    return summarised(validation_parts(v))


def report_of(summary: DataFrame, types: DataFrame) -> DataFrame:
    """One row with a JSON report: a summary and the breakdown of types(violation_type, n)."""
    names = summary.columns
    listed = types.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("violation_type", "n")))).alias("violation_breakdown"))  # a row for each type
    both = summary.withColumn("_one", F.lit(1)).join(listed.withColumn("_one", F.lit(1)), "_one")
    return both.select(F.to_json(F.struct(F.struct(*names).alias("summary"), F.col("violation_breakdown"))).alias("report"))


def validation_report(v: DataFrame) -> DataFrame:
    """One row with a JSON report: summary and breakdown by type. The validations are history's rows."""
    return report_of(validation_summary(v), type_histogram(v))


def running(df: DataFrame, group: list[str], at: list[str], value: str) -> DataFrame:
    """Running sum and mean of value within group in the order of at, exact in decimals; the first of at is a time, by
    whose days a group of any size is spread. Null values count for nothing."""
    v = F.col(value).cast(EXACT)
    rows = bucketed_prefix_sums(df.withColumn("_day", F.to_date(at[0])), group, ["_day"], [F.col(c) for c in at], {"running_sum": v, "running_n": F.when(v.isNotNull(), 1).otherwise(0)})
    rows = rows.drop("_day").withColumn("running_sum", F.when(F.col("running_n") > 0, F.col("running_sum")))
    return rows.withColumn("running_avg", F.try_divide(F.col("running_sum"), F.col("running_n")))


def combined(calls: DataFrame, validations: DataFrame, a_day: int = A_DAY, days: int = DAYS) -> DataFrame:
    """One row: averages for a validation and the projected month, null if nothing was validated; the ratios are of all
    calls."""
    one = totals(calls).withColumn("_one", F.lit(1)).join(validation_summary(validations).withColumn("_one", F.lit(1)), "_one")
    n = F.nullif(F.col("total_validations"), F.lit(0))
    per = lambda c, digits: F.round(F.try_divide(F.col(c).cast("double"), n), digits)
    month = lambda c, digits: F.round(F.try_divide(F.col(c).cast("double"), n) * (a_day * days), digits)
    return one.select(
        "total_api_calls", "total_validations", per("total_cost", 6).alias("avg_cost_per_validation"), F.when(n.isNotNull(), F.col("avg_validation_time_ms")).alias("avg_latency_ms"), per("total_tokens", 2).alias("avg_tokens_per_validation"),
        per("total_prompt_tokens", 2).alias("avg_input_tokens"), per("total_completion_tokens", 2).alias("avg_output_tokens"), month("total_cost", 2).alias("estimated_monthly_cost"), month("total_prompt_tokens", 0).alias("estimated_monthly_input_tokens"), month("total_completion_tokens", 0).alias("estimated_monthly_output_tokens"),
    )


def mean_timings(df: DataFrame) -> DataFrame:
    """The mean of repeated timings of each test."""
    return df.groupBy("test_id").agg(F.avg("time_ms").alias("avg_time_ms"), F.count("*").alias("iterations"))
