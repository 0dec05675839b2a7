"""Queries of places in code, of what an editor shows, of evaluations and of tables on disk, and SQL to check them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import locate, metrics, retrieval, rules
from marlstone.plans import reference
from marlstone.plans.reference_sql import CALLS_CTE, COST, knn_sql
from marlstone.schemas import MODEL
from marlstone.session import new_path
from marlstone.sources.store import ChunkStore, write_json
from marlstone.tables import table

# --- places in code ------------------------------------------------------------------------------------------------

TERMS = {"class": r"\bclass\s+([A-Za-z_]\w*)", "function": r"\bdef\s+([A-Za-z_]\w*)", "assignment": r"([A-Za-z_]\w*) = ", "word": r"import ([A-Za-z_]\w*)"}


def x02_first_terms(spark: SparkSession, d: str) -> DataFrame:
    """Where the first class, function, assignment and import of every file stand."""
    files = table(spark, d, "code_submissions").filter("content IS NOT NULL").select("submission_id", "content").distinct()
    terms = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("content", p, 1).alias("term")) for k, p in TERMS.items()])
    rows = files.select("submission_id", "content", F.explode(terms).alias("t")).select("submission_id", "content", "t.*")
    at = locate.locate(F.col("content"), F.col("term"))
    return rows.select("submission_id", "kind", "term", at.alias("at")).select("submission_id", "kind", "term", F.col("at.line").alias("line"), F.col("at.col").alias("col"))


def x03_escaped(spark: SparkSession, d: str) -> DataFrame:
    """Whether the name of a chunk's section, taken as it is, stands in the chunk."""
    c = table(spark, d, "chunks").filter("text IS NOT NULL AND section_name IS NOT NULL").select("chunk_id", "text", "section_name").distinct()
    return c.select("chunk_id", F.regexp(F.col("text"), locate.escaped(F.col("section_name"))).alias("found"))


def x04_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "doc_name", "section_name", "section_number", "doc_type").distinct()
    return c.select("chunk_id", locate.diagnostic(F.col("doc_name"), F.col("section_name"), F.array("section_number", "doc_type")).alias("shown"))


def x05_last_by_line(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select(F.col("doc_id").cast("string").alias("uri"), F.col("page_number").alias("line"), F.col("chunk_id").alias("sources"), "chunk_index")
    return locate.last_by_line(c, "chunk_index")


def x06_without_prefix(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", F.col("chunk_id").alias("uri")).distinct()
    return locate.without_prefix(c, "1").select("chunk_id")


def x07_actions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "section_name", "section_number").distinct()
    return locate.actions(c.select("chunk_id", F.array("section_name", "section_number").alias("sections")))


def x08_first_line(spark: SparkSession, d: str) -> DataFrame:
    """The line of each document at which the name of a chunk's section first stands."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("document"))
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "section_name").distinct().join(docs, "doc_id")
    return c.select("chunk_id", locate.first_line_of(F.col("document"), F.col("section_name")).alias("line"))


def v08_allowed_endings(spark: SparkSession, d: str) -> DataFrame:
    """Words of entities' names that a rule may flag: endings that are allowed are none, all runs of words are."""
    names = table(spark, d, "specialist_entities").select(F.trim("name").alias("name")).filter("name IS NOT NULL").distinct()
    terms = names.select(F.explode(rules.words(F.col("name"))).alias("term_key")).distinct().withColumn("term", F.col("term_key"))
    return rules.terms_in(names, terms, []).select("name", "term").distinct()


# --- metrics -------------------------------------------------------------------------------------------------------


def g14_month(spark: SparkSession, d: str) -> DataFrame:
    """Averages of a validation with cost and latency, and the projected month."""
    return metrics.combined(reference.calls(spark, d), reference.validations(spark, d))


def g18_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation of the searches over embeddings, a label in place of a section."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    near = reference.near(spark, d, 3)
    hits = near.join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected_section")), "query_id").join(e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("retrieved_section")), "item_id")
    rows = hits.select(F.col("query_id").alias("test_id"), "rank", "retrieved_section", "expected_section", F.col("score").alias("relevance"), F.col("rank").cast("double").alias("time_ms"))
    made = retrieval.evaluate(rows)
    return made.withColumn("avg_relevance", F.round("avg_relevance", 4)).withColumn("top1_accuracy_pct", F.round("top1_accuracy_pct", 4)).withColumn("top3_accuracy_pct", F.round("top3_accuracy_pct", 4))


# --- tables on disk ------------------------------------------------------------------------------------------------


def k01_store(spark: SparkSession, d: str) -> DataFrame:
    """A store of chunks after the documents of one type were indexed again, with their first chunks only."""
    c = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), "doc_id", "chunk_index", F.length("text").alias("n"), F.lower(F.trim("doc_type")).alias("kind")).distinct()
    store = ChunkStore(spark, new_path(spark, "store"), buckets=16)
    store.index(c, c.select("doc_id"))
    again = c.filter("kind = 'adr'")
    store.index(again.filter("chunk_index = 0").withColumn("n", F.lit(-1)), again.select("doc_id"))
    return store.read().select("id", "doc_id", "n")


def k02_models(spark: SparkSession, d: str) -> DataFrame:
    """Models written as JSON and read again."""
    path = new_path(spark, "models")
    models = table(spark, d, "domain_models").select("project_name", "project_metadata", "bounded_contexts", "global_rules").distinct()
    write_json(models, path)
    back = spark.read.schema(MODEL).json(path)
    return back.select("project_name", F.col("project_metadata.version").alias("version"), F.size("bounded_contexts").alias("n_contexts"), F.col("global_rules.naming_convention").alias("convention"))


QUERIES = {f.__name__: f for f in (x02_first_terms, x03_escaped, x04_diagnostic, x05_last_by_line, x06_without_prefix, x07_actions, x08_first_line, v08_allowed_endings, g14_month, g18_evaluation, k01_store, k02_models)}

_TERMS = " UNION ALL ".join(f"SELECT submission_id, content, '{k}' kind, regexp_extract(content, '{p}', 1) term FROM files" for k, p in TERMS.items())

ORACLES = {
    "x02_first_terms": rf"""WITH files AS (SELECT DISTINCT submission_id, content FROM code_submissions WHERE content IS NOT NULL), t AS ({_TERMS}),
l AS (SELECT submission_id, kind, term, unnest(string_split_regex(content, '\r\n|\n|\r')) x, generate_subscripts(string_split_regex(content, '\r\n|\n|\r'), 1) - 1 i FROM t WHERE term <> ''),
h AS (SELECT *, CASE WHEN regexp_matches(x, 'class\s+' || term || '\b') THEN 1 WHEN regexp_matches(x, 'def\s+' || term || '\b') THEN 2 WHEN regexp_matches(x, '^\s*' || term || '\s*=') THEN 3
  WHEN NOT starts_with(ltrim(x), '#') AND contains(string_split(x, '#')[1], term) THEN 4 END rk FROM l),
f AS (SELECT submission_id, kind, term, first(i ORDER BY rk, i) line, first(instr(x, term) - 1 ORDER BY rk, i) col FROM h WHERE rk IS NOT NULL GROUP BY 1, 2, 3)
SELECT t.submission_id, t.kind, t.term, CAST(coalesce(line, 0) AS INTEGER) line, CAST(coalesce(col, 0) AS INTEGER) col FROM t LEFT JOIN f ON f.submission_id = t.submission_id AND f.kind = t.kind AND f.term = t.term""",
    "x03_escaped": "SELECT chunk_id, contains(text, section_name) found FROM (SELECT DISTINCT chunk_id, text, section_name FROM chunks WHERE text IS NOT NULL AND section_name IS NOT NULL)",
    "x04_diagnostic": r"""SELECT chunk_id, concat_ws(E'\n', doc_name, section_name, nullif(concat_ws(E'\n', '[1] ' || section_number, '[2] ' || doc_type), '')) shown FROM (SELECT DISTINCT chunk_id, doc_name, section_name, section_number, doc_type FROM chunks)""",
    "x05_last_by_line": "SELECT CAST(doc_id AS VARCHAR) uri, page_number line, arg_max(chunk_id, chunk_index) sources FROM chunks GROUP BY 1, 2",
    "x06_without_prefix": "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NULL OR NOT starts_with(chunk_id, '1')",
    "x07_actions": """WITH c AS (SELECT DISTINCT chunk_id, section_name, section_number FROM chunks)
SELECT chunk_id, 0 i, '[1] View Source: ' || section_name title, true preferred FROM c UNION ALL SELECT chunk_id, 1, '[2] View Source: ' || section_number, false FROM c""",
    "x08_first_line": r"""SELECT chunk_id, CAST(CASE WHEN instr(text, section_name) > 0 THEN length(left(text, instr(text, section_name) - 1)) - length(replace(left(text, instr(text, section_name) - 1), E'\n', '')) ELSE 0 END AS INTEGER) line
FROM (SELECT DISTINCT chunk_id, doc_id, section_name FROM chunks) c JOIN documents d USING (doc_id)""",
    "v08_allowed_endings": r"""WITH n AS (SELECT DISTINCT trim(name) name FROM specialist_entities WHERE name IS NOT NULL),
w AS (SELECT name, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w FROM n),
terms AS (SELECT DISTINCT unnest(w) term FROM w),
runs AS (SELECT name, w, array_to_string(w[i:j], '') term FROM w, range(1, 60) a(i), range(1, 60) b(j) WHERE i <= j AND j <= len(w))
SELECT DISTINCT name, term FROM runs SEMI JOIN terms USING (term) WHERE NOT (term IN ('repository', 'service', 'factory', 'gateway', 'aggregate', 'specification') AND term = w[-1])""",
    "g14_month": f"""WITH {CALLS_CTE}, n AS (SELECT count(*) n, round(CAST(sum(CAST(value AS DECIMAL(38,9))) AS DOUBLE) / count(value), 2) ms FROM events), c AS (SELECT count(*) k, {COST} cost, sum(p) p, sum(q) q FROM calls)
SELECT k total_api_calls, n total_validations, round(cost / n, 6) avg_cost_per_validation, ms avg_latency_ms, round((p + q)::DOUBLE / n, 2) avg_tokens_per_validation, round(p::DOUBLE / n, 2) avg_input_tokens, round(q::DOUBLE / n, 2) avg_output_tokens,
  round(cost / n * 30000, 2) estimated_monthly_cost, round(p::DOUBLE / n * 30000, 0) estimated_monthly_input_tokens, round(q::DOUBLE / n * 30000, 0) estimated_monthly_output_tokens FROM n, c""",
    "g18_evaluation": f"""WITH {knn_sql(3)}, h AS (SELECT query_id, avg(rank) t, max(score) FILTER (rank = 1) r, bool_or(rank = 1 AND a.label = b.label) top1, bool_or(a.label = b.label) top3 FROM k JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = item_id GROUP BY 1)
SELECT count(*) total, avg(t) avg_time_ms, round(avg(r), 4) avg_relevance, count(*) FILTER (top1) top1_correct, count(*) FILTER (top3) top3_correct, round(100.0::DOUBLE * count(*) FILTER (top1) / count(*), 4) top1_accuracy_pct, round(100.0::DOUBLE * count(*) FILTER (top3) / count(*), 4) top3_accuracy_pct FROM h""",
    "k01_store": """WITH c AS (SELECT DISTINCT chunk_id id, doc_id, chunk_index, CAST(length(text) AS INTEGER) n, lower(trim(doc_type)) kind FROM chunks), a AS (SELECT DISTINCT doc_id FROM c WHERE kind = 'adr')
SELECT id, doc_id, n FROM c WHERE doc_id NOT IN (SELECT doc_id FROM a) UNION ALL SELECT id, doc_id, -1 FROM c WHERE kind = 'adr' AND chunk_index = 0""",
    "k02_models": "SELECT project_name, project_metadata.version version, CAST(len(bounded_contexts) AS INTEGER) n_contexts, global_rules.naming_convention convention FROM (SELECT DISTINCT project_name, project_metadata, bounded_contexts, global_rules FROM domain_models)",
}
