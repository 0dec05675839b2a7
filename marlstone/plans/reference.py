"""Queries of the operators on documents, code, models and logs, over whole tables, and SQL to check them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.strings import is_blank
from marlstone.operators import chunking, code, locate, metrics, retrieval, rules, synthesis, vector
from marlstone.operators import text as cleaning
from marlstone.plans.reference_sql import ORACLES
from marlstone.session import cut
from marlstone.tables import spread, table

STOP = ("important:",)  # what stands for a head of references in the test documents


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- documents ---------------------------------------------------------------------------------------------------


def d_clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select("doc_id", cleaning.clean(F.col("text")).alias("cleaned"))


def d01_truncate(spark: SparkSession, d: str) -> DataFrame:
    parts = cleaning.before_references(cleaning.lines(F.col("text")), STOP)
    return spread(table(spark, d, "documents")).select("doc_id", F.size(parts).alias("n_lines")).filter("n_lines >= 0")


def d06_rejected(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.blank_documents(table(spark, d, "documents"), "text")[1].select("doc_id")


def c01_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings of all documents by kind."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).select("doc_id", F.regexp_replace("x", r"^[ \t\r]+|[ \t\r]+$", "").alias("x")).filter(F.length("x") < chunking.HEADING_LIMIT)
    kind = F.when(F.col("x").rlike(r"^(\d+(?:\.\d+)*)[ \t]+(.+)$"), "numbered").when(F.col("x").startswith("#"), "markdown")
    return lines.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def c03_sections(spark: SparkSession, d: str) -> DataFrame:
    s = spread(table(spark, d, "documents")).select("doc_id", F.posexplode(chunking.sections(F.col("text"))).alias("section_ord", "s"))
    return s.select("doc_id", "section_ord", F.col("s.number").alias("section_number"), F.col("s.name").alias("section_name"), F.length("s.content").alias("n_chars"))


def c08_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(spread(table(spark, d, "documents")))


def c05_chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """The indexed chunks by type: sizes, and whether pages follow from the ordinals."""
    c = table(spark, d, "chunks")
    return c.groupBy(F.upper(F.trim("doc_type")).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.count_if(chunking.page_of(F.col("chunk_index")) == F.col("page_number")).alias("n_pages_as_estimated"))


def c08_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "chunk_index").distinct()
    made = F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))
    return c.select("chunk_id", "doc_id", made.alias("made_id"), chunking.page_of(F.col("chunk_index")).alias("page"))


def c10_windows(spark: SparkSession, d: str) -> DataFrame:
    w = chunking.sentence_windows(spread(table(spark, d, "documents")), "doc_id", "text")
    return w.groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.sum(F.length("window")).alias("n_chars"), F.max(F.length("window")).alias("longest"))


def s_documents_by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


# --- search ------------------------------------------------------------------------------------------------------


def _queries(e: DataFrame) -> DataFrame:
    return e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def near(spark: SparkSession, d: str, k: int, where: str = "true") -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector.knn(_queries(e), e.filter(where).select(F.col("vec_id").alias("item_id"), "embedding"), k, keep_self=False)


def r02_knn(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d, 10).select("query_id", "item_id", "rank", F.round("score", 4).alias("score"))


def r04_knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d, 5, "label = 1").select("query_id", "item_id", "rank", F.round("score", 4).alias("score"))


def g17_knn_label_accuracy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label")
    hits = near(spark, d, 3).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").join(e.select(F.col("vec_id").alias("item_id"), "label"), "item_id")
    per = hits.groupBy("query_id").agg(F.bool_or((F.col("rank") == 1) & (F.col("own") == F.col("label"))).alias("top1"), F.bool_or(F.col("own") == F.col("label")).alias("top3"))
    return per.agg(F.count("*").alias("total"), F.count_if("top1").alias("top1_correct"), F.count_if("top3").alias("top3_correct"))


def r02_cells_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the index of cells against the exact search."""
    e = table(spark, d, "embeddings")
    items = e.select(F.col("vec_id").alias("item_id"), "embedding")
    return vector.recall(vector.CellIndex(items).search(_queries(e), 10), vector.knn(_queries(e), items, 10))


def r05_query_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", retrieval.query_text(F.col("text")).alias("query"))


def r06_summary(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "chunks")).select("chunk_id", retrieval.summary(F.col("text")).alias("summary")).distinct()


def _index(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").filter("text IS NOT NULL").dropDuplicates(["chunk_id"])
    number = F.xxhash64("chunk_id")
    return vector.embed(c.withColumn("item_id", number), "text")


def _sourced(spark: SparkSession, d: str, messages: DataFrame) -> DataFrame:
    asked = messages.select("message").distinct().select(F.xxhash64("message").alias("query_id"), retrieval.query_text(F.col("message")).alias("query"))
    return retrieval.sources(retrieval.search(asked, _index(spark, d)))


def r03_sources(spark: SparkSession, d: str) -> DataFrame:
    """The sources of every different message of all violations, over all chunks."""
    return _sourced(spark, d, cut(v_violations(spark, d), "violations"))


def r03_attached(spark: SparkSession, d: str) -> DataFrame:
    """All violations with their sources."""
    found = cut(v_violations(spark, d), "violations")
    made = retrieval.attach(found.withColumn("query_id", F.xxhash64("message")), _sourced(spark, d, found))
    return made.select("submission_id", "type", "subject", "line", "message", F.size("sources").alias("n_sources"), F.transform("sources", lambda s: s["section"]).alias("sections"))


def r07_attach(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours attached to each query row as an ordered array, flattened again."""
    e = table(spark, d, "embeddings")
    made = retrieval.attach(e.select(F.col("vec_id").alias("query_id"), "label"), near(spark, d, 3).select("query_id", "rank", "item_id"))
    return made.select("query_id", "label", (F.size("sources") > 0).alias("has_sources"), F.posexplode_outer(F.transform("sources", lambda s: s["item_id"])).alias("pos", "item_id"))


def r08_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return retrieval.index_stats(c.select(F.col("chunk_id").alias("id"), "text", "doc_id", "doc_name", "section_name"))


def k01_reindex(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.sources.store import reindexed

    docs = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    again = docs.filter("doc_id % 10 = 0")
    return reindexed(docs, again.filter("n > 0").withColumn("lang", F.lit("again")), again)


# --- code and rules ----------------------------------------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_submissions").select("submission_id", "project_name", "filename", "content").distinct()


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return cut(code.parse_code(_files(spark, d).filter("filename LIKE '%.py'"), keep=["submission_id", "project_name", "filename"]), "parsed")


def _models(spark: SparkSession, d: str) -> DataFrame:
    """The latest model of each project."""
    m = table(spark, d, "domain_models").filter("project_name IS NOT NULL")
    return m.groupBy("project_name").agg(F.max_by(F.struct("bounded_contexts", "global_rules"), F.struct("loaded_at", "model_id")).alias("m")).select("project_name", "m.*")


def a01_ast(spark: SparkSession, d: str) -> DataFrame:
    p = _parsed(spark, d)
    return p.select("submission_id", *[F.size(k).alias(f"n_{k}") for k in code.KINDS], "error")


def a04_classes(spark: SparkSession, d: str) -> DataFrame:
    return code.rows_of(_parsed(spark, d), "classes", ["submission_id"])


def a02_imports(spark: SparkSession, d: str) -> DataFrame:
    return code.rows_of(_parsed(spark, d), "imports", ["submission_id"])


def a05_functions(spark: SparkSession, d: str) -> DataFrame:
    return code.rows_of(_parsed(spark, d), "functions", ["submission_id"])


def a06_assignments(spark: SparkSession, d: str) -> DataFrame:
    return code.rows_of(_parsed(spark, d), "assignments", ["submission_id"])


def a07_calls(spark: SparkSession, d: str) -> DataFrame:
    return code.rows_of(_parsed(spark, d), "function_calls", ["submission_id"])


def v_violations(spark: SparkSession, d: str) -> DataFrame:
    return rules.violations(_parsed(spark, d), _models(spark, d))


def _validated(spark: SparkSession, d: str) -> DataFrame:
    found = cut(v_violations(spark, d), "violations")
    files = _files(spark, d).filter("filename LIKE '%.py'").select("submission_id", F.length("content").cast("bigint").alias("file_size_chars"), metrics.token_estimate(F.col("content")).alias("code_file_tokens"), F.lit(0.0).alias("validation_time_ms"), F.lit(False).alias("has_sources"))
    return metrics.recorded(rules.flag(files, found, "submission_id"))


def g12_validation_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.validation_summary(_validated(spark, d))


def g09_violation_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.type_histogram(_validated(spark, d))


BANNED = ("steel", "brass", "large", "small")


def v01_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Synonyms of the models' entities that are names of entities in the same project's models."""
    rel = rules.model_relations(table(spark, d, "domain_models"))
    hits = rules.terms_in(rel["entities"].select("project", "name").distinct(), rel["synonyms"], ["project"])
    return hits.filter(rules.letters_digits(F.col("name")) == F.col("term_key")).select("project", "name", "term", "entity").distinct()


def v02_banned_terms(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    terms = _values(spark, [(t, t) for t in BANNED], "term string, term_key string")
    return rules.terms_in(names, terms, []).select("p_partkey", "term").distinct()


def v03_naming(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "specialist_entities").select(F.lit("class").alias("kind"), "name").distinct()
    return rules.naming(names).select("name")


def v04_context_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Entities found in a context of their model that no context of the model allows to depend on."""
    key = rules.letters_digits
    found = table(spark, d, "specialist_entities").select("model_id", key(F.col("context")).alias("k")).filter("model_id IS NOT NULL AND length(k) > 0").distinct()
    allowed = table(spark, d, "bounded_contexts").select("model_id", F.explode("allowed_dependencies").alias("x")).select("model_id", key(F.col("x")).alias("k"))
    return found.join(allowed, ["model_id", "k"], "left_anti")


def v05_value_objects(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of found entities that name a value object of their project."""
    rel = rules.model_relations(table(spark, d, "domain_models"))
    a = table(spark, d, "specialist_entities").select(F.col("project_name").alias("project"), F.explode("attributes").alias("a")).select("project", rules.letters_digits(F.col("a")).alias("vo_key")).filter("length(vo_key) > 0").distinct()
    return a.join(rel["attributes"].select("project", "vo_key").distinct(), ["project", "vo_key"])


def v06_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that several contexts of a project define."""
    rel = rules.model_relations(table(spark, d, "domain_models"))
    return rel["events"].groupBy("project", "event").agg(F.count_distinct("context_key").alias("n_contexts")).filter("n_contexts > 1")


def x01_keyword(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("text IS NOT NULL").select("chunk_id", locate.keyword(F.col("text")).alias("keyword")).distinct()


def x02_locate(spark: SparkSession, d: str) -> DataFrame:
    """Where the term of each violation, class, function and assignment stands; kind is the violation's type or one of
    these. A term is looked for once a file."""
    parsed = _parsed(spark, d)
    row = lambda df, kind, term: df.select("submission_id", kind.alias("kind"), term.alias("name"), "line")
    terms = row(rules.violations(parsed, _models(spark, d)), F.col("type"), locate.keyword(F.col("message")))
    for part, kind, name in (("classes", "class", "name"), ("functions", "function", "name"), ("assignments", "assignment", "target")):
        terms = terms.unionByName(row(code.rows_of(parsed, part, ["submission_id"]), F.lit(kind), F.col(name)))
    terms = cut(terms, "terms")
    asked = terms.select(F.col("submission_id").alias("_id"), F.col("name").alias("_term")).distinct()
    files = _files(spark, d).select("submission_id", "content")
    at = asked.join(files, F.col("_id").eqNullSafe(F.col("submission_id"))).select("_id", "_term", locate.locate(F.col("content"), F.col("_term")).alias("at"))
    both = terms.join(at, F.col("submission_id").eqNullSafe(F.col("_id")) & F.col("name").eqNullSafe(F.col("_term")))
    return both.select("submission_id", "kind", "name", "line", F.col("at.line").alias("found_line"), F.col("at.col").alias("found_col"))


# --- models ------------------------------------------------------------------------------------------------------


def m02_sentence_fallback(spark: SparkSession, d: str) -> DataFrame:
    s = spread(table(spark, d, "documents")).select("doc_id", F.posexplode(synthesis.sentences(F.col("text"))).alias("no", "sentence"))
    return s


def m01_scout(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.scout(spread(table(spark, d, "documents")).filter(~is_blank(F.col("text"))), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_sentences"))


def m05_synthesise(spark: SparkSession, d: str) -> DataFrame:
    """All stages without a model: the deterministic fallbacks."""
    docs = spread(table(spark, d, "documents")).filter(~is_blank(F.col("text")))
    found = synthesis.scout(docs, "doc_id", "text")
    contexts = synthesis.identify_contexts(found, "doc_id")
    made = synthesis.synthesise(synthesis.analyse(contexts, found, "doc_id"), "doc_id")
    return made.select("doc_id", "model.project_name", F.size("model.bounded_contexts").alias("n_contexts"), "is_fallback")


def m06_models(spark: SparkSession, d: str) -> DataFrame:
    made = synthesis.model_or_fallback(table(spark, d, "model_payloads").select("model_id", "payload").distinct(), "model_id", "payload")
    return made.select("model_id", "model.project_name", F.size("model.bounded_contexts").alias("n_contexts"), "is_fallback")


MESSAGES = [(1, "429 quota exceeded, retry in 37.5s", 0), (2, "Quota exceeded", 2), (3, "quota", 9), (4, "timeout", 1), (5, "429 retry in 3", 0)]


def m09_backoff(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, MESSAGES, "id int, message string, retry int").select("id", synthesis.backoff(F.col("message"), F.col("retry")).alias("wait"))


def m11_lenient_json(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "model_payloads").filter("payload IS NOT NULL").select("model_id", "payload").distinct()
    return p.select("model_id", synthesis.lenient_json(F.col("payload")).alias("j")).select("model_id", F.col("j.error").isNull().alias("is_json"))


# --- metrics -----------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Documents as calls: a stage for each source, text in, project name out."""
    t = table(spark, d, "documents")
    made = t.select(F.col("created_at").alias("timestamp"), F.coalesce(F.lower(F.trim("source")), F.lit("none")).alias("stage"), F.lit("read").alias("operation"), metrics.token_estimate(F.col("text")).alias("prompt_tokens"), metrics.token_estimate(F.col("doc_name")).alias("completion_tokens"))
    return metrics.normalised_calls(made)


def validations(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    bad = F.when(F.col("event_type") == "error", F.array(F.col("event_type"))).otherwise(F.array().cast("array<string>"))
    return e.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("filename"), F.length("props").cast("bigint").alias("file_size_chars"), metrics.token_estimate(F.col("props")).alias("code_file_tokens"), F.col("value").alias("validation_time_ms"), F.size(bad).cast("bigint").alias("violations_count"), bad.alias("violation_types"), (F.col("value") > 50).alias("has_sources"))


def g09_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.type_histogram(_events(spark, d).select(F.array("event_type").alias("violation_types")))


def k05_sorted_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sorted_counts(_events(spark, d), "event_type")


def g03_stage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metrics.usage(calls(spark, d)).select("stage", F.col("is_total").cast("int").alias("is_total"), "call_count", "prompt_tokens", "completion_tokens", "total_tokens", F.col("estimated_cost").cast("double").alias("estimated_cost"))


def g04_cost(spark: SparkSession, d: str) -> DataFrame:
    return metrics.totals(calls(spark, d)).withColumn("total_cost", F.col("total_cost").cast("double"))


def g08_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n_error"), F.count_if(F.col("event_type") != "error").alias("n_other"), F.round(metrics.share(F.count_if(F.col("event_type") == "error"), F.count("*"), True), 4).alias("error_percent"))


def g10_running_avg(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.running(_events(spark, d), ["user_id"], ["ts", "event_id"], "value")
    return r.select("event_id", F.col("running_n"), F.round(F.col("running_sum").cast("double"), 4).alias("running_sum"), F.floor(F.col("running_sum").cast("double") / F.col("running_n") * 10000).alias("running_avg_e4"))


def g11_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.validation_summary(validations(spark, d)).select("total_validations", "files_with_violations", "files_without_violations", "total_violations_found", "total_code_size_chars", "total_code_tokens", "validations_with_sources", "violation_rate_percent", "avg_violations_per_file")


def g13_combined(spark: SparkSession, d: str) -> DataFrame:
    return metrics.combined(calls(spark, d), validations(spark, d)).select("total_api_calls", "total_validations", "avg_tokens_per_validation", "avg_input_tokens", "avg_output_tokens")


def g12_report(spark: SparkSession, d: str) -> DataFrame:
    """What the report says: the summary's counts and the breakdown, read from its JSON."""
    report = metrics.validation_report(validations(spark, d))
    said = lambda path, kind: F.get_json_object("report", f"$.{path}").cast(kind)
    counts = ("total_validations", "files_with_violations", "total_violations_found", "total_code_size_chars", "validations_with_sources")
    return report.select(*[said(f"summary.{c}", "bigint").alias(c) for c in counts], said("summary.violation_rate_percent", "double").alias("violation_rate_percent"), said("violation_breakdown.error", "bigint").alias("n_error"))


def g05_report(spark: SparkSession, d: str) -> DataFrame:
    """What the report says: the totals and each stage, read from its JSON."""
    report = metrics.usage_report(calls(spark, d))
    stages = F.from_json(F.get_json_object("report", "$.stage_breakdown"), "array<struct<stage:string,call_count:bigint,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,estimated_cost:double>>")
    total = F.get_json_object("report", "$.summary.total_tokens").cast("bigint").alias("all_tokens")
    return report.select(total, F.explode(stages).alias("s")).select("all_tokens", "s.*")


def g15_timings(spark: SparkSession, d: str) -> DataFrame:
    t = _events(spark, d).select(F.col("user_id").alias("test_id"), F.col("value").cast("decimal(18,4)").alias("time_ms"))
    return metrics.mean_timings(t).select("test_id", "iterations", F.round(F.col("avg_time_ms").cast("double"), 4).alias("avg_time_ms"))


def g16_section_match(spark: SparkSession, d: str) -> DataFrame:
    """Sections of all chunks against the fixed expectations."""
    s = table(spark, d, "chunks").select("section_number", "section_name").filter("section_name IS NOT NULL").distinct()
    return s.select("section_number", "section_name", retrieval.section_match(F.col("section_name"), F.col("section_number")).alias("matches"))


def g19_code_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_submissions").select("submission_id", metrics.token_estimate(F.col("content")).alias("n_tokens")).distinct()


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        d_clean_lines, d01_truncate, d06_rejected, c01_headings, c03_sections, c08_chunks, c05_chunk_stats, c08_chunk_ids, c10_windows, s_documents_by_source,
        r02_knn, r04_knn_filtered, g17_knn_label_accuracy, r02_cells_recall, r05_query_text, r06_summary, r03_sources, r03_attached, r07_attach, r08_stats, k01_reindex,
        a01_ast, a02_imports, a04_classes, a05_functions, a06_assignments, a07_calls, v_violations, g12_validation_summary, g09_violation_histogram, v01_synonyms, v02_banned_terms, v03_naming, v04_context_boundary, v05_value_objects, v06_events, x01_keyword, x02_locate,
        m02_sentence_fallback, m01_scout, m05_synthesise, m06_models, m09_backoff, m11_lenient_json,
        g09_type_histogram, k05_sorted_counts, g03_stage_rollup, g04_cost, g08_conditional_counts, g10_running_avg, g11_summary, g13_combined, g12_report, g05_report, g15_timings, g16_section_match, g19_code_tokens,
    )
}
