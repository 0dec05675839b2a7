"""SQL for DuckDB that gives the same results as the queries of the module reference."""

_STRIP = r"regexp_replace({0}, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+$', '', 'g')"
_KEY = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"


def strip(c: str) -> str:
    return _STRIP.format(c)


def key(c: str) -> str:
    return _KEY.format(c)


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, E'\\n')) x, generate_subscripts(string_split(text, E'\\n'), 1) i FROM documents WHERE text IS NOT NULL)"

_MODELS = f"""
c AS (SELECT project_name project, unnest(bounded_contexts) c FROM domain_models),
n AS (SELECT project, c.context_name context, {key('c.context_name')} context_key, c.ubiquitous_language u FROM c WHERE c.context_name IS NOT NULL AND {strip('c.context_name')} <> ''),
e AS (SELECT project, e.name, e.synonyms_to_avoid s FROM (SELECT project, unnest(u.entities) e FROM n) WHERE e.name IS NOT NULL),
v AS (SELECT project, {key('v.name')} vo_key FROM (SELECT project, unnest(u.value_objects) v FROM n) WHERE v.name IS NOT NULL)
"""

CALLS_CTE = """
calls AS (SELECT coalesce(lower(trim(source)), 'none') stage, coalesce(CAST(ceil(length(text) / 4.0) AS BIGINT), 0) p, coalesce(CAST(ceil(length(doc_name) / 4.0) AS BIGINT), 0) q FROM documents)
"""
COST = "CAST(round(CAST((CAST(sum(p) AS DECIMAL(20,0)) * 0.30 + CAST(sum(q) AS DECIMAL(20,0)) * 2.50) AS DECIMAL(28,2)) / 1000000.0, 6) AS DOUBLE)"


def knn_sql(k: int, where: str = "true") -> str:
    return f"""
s AS (SELECT q.vec_id query_id, e.vec_id item_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) score
      FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 AND ({where})),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) rank FROM s QUALIFY rank <= {k})"""


ORACLES = {
    "d_clean_lines": rf"""WITH {_LINES}, s AS (SELECT doc_id, i, {strip('x')} x FROM l),
cut AS (SELECT doc_id, min(i) stop FROM s WHERE regexp_matches(lower(x), '^(references|bibliography|kaynakça)') GROUP BY 1),
k AS (SELECT s.doc_id, string_agg(x, E'\n' ORDER BY i) t FROM s LEFT JOIN cut USING (doc_id) WHERE (stop IS NULL OR i < stop) AND x <> '' AND NOT regexp_matches(x, '^\s*\d+\s*$|^\s*(?i:page)\s*\d+\s*$') AND NOT regexp_matches(x, '\.{{4,}}\s*\d+') GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END cleaned FROM documents d LEFT JOIN k USING (doc_id)""",
    "d01_truncate": rf"""WITH {_LINES}, cut AS (SELECT doc_id, min(i) stop FROM l WHERE starts_with(lower({strip('x')}), 'important:') GROUP BY 1)
SELECT doc_id, CAST(coalesce(stop - 1, len(string_split(text, E'\n'))) AS INTEGER) n_lines FROM documents LEFT JOIN cut USING (doc_id) WHERE text IS NOT NULL""",
    "d06_rejected": f"SELECT doc_id FROM documents WHERE text IS NULL OR {strip('text')} = ''",
    "c01_headings": rf"""WITH {_LINES}, s AS (SELECT doc_id, trim(x, E' \t\r') x FROM l),
k AS (SELECT doc_id, CASE WHEN regexp_matches(x, '^(\d+(?:\.\d+)*)[ \t]+(.+)$') THEN 'numbered' WHEN starts_with(x, '#') THEN 'markdown' END kind FROM s WHERE length(x) < 150)
SELECT kind, count(*) n, count(DISTINCT doc_id) n_docs FROM k WHERE kind IS NOT NULL GROUP BY 1""",
    "c03_sections": rf"""WITH {_LINES}, s AS (SELECT *, {strip('x')} t FROM l),
h AS (SELECT *, CASE WHEN length(t) < 150 AND regexp_matches(t, '^(\d+(?:\.\d+)*)\s+(.+)$') THEN regexp_extract(t, '^(\d+(?:\.\d+)*)\s+(.+)$', 1) END num,
        length(t) < 150 AND starts_with(t, '#') md FROM s),
g AS (SELECT *, num IS NOT NULL OR md hd, sum(CASE WHEN num IS NOT NULL OR md THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) grp FROM h),
heads AS (SELECT doc_id, grp, num, CASE WHEN num IS NOT NULL THEN num || ' ' || regexp_extract(t, '^(\d+(?:\.\d+)*)\s+(.+)$', 2) ELSE {strip("regexp_replace(t, '^#+', '')")} END nm FROM g WHERE hd),
c AS (SELECT doc_id, grp, sum(length(x)) + count(*) - 1 n FROM g WHERE NOT hd GROUP BY 1, 2),
r AS (SELECT c.*, num, nm, row_number() OVER (PARTITION BY c.doc_id ORDER BY grp) k FROM c LEFT JOIN heads USING (doc_id, grp))
SELECT doc_id, CAST(k - 1 AS INTEGER) section_ord, CASE WHEN grp = 0 THEN '0' ELSE coalesce(num, CAST(k AS VARCHAR)) END section_number, CASE WHEN grp = 0 THEN 'Preamble' ELSE nm END section_name, CAST(n AS INTEGER) n_chars FROM r
UNION ALL SELECT doc_id, 0, '1', 'Document Content', CAST(length(text) AS INTEGER) FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM r)""",
    "c08_chunks": rf"""WITH RECURSIVE {_LINES}, s AS (SELECT *, {strip('x')} t FROM l),
h AS (SELECT *, CASE WHEN length(t) < 150 AND regexp_matches(t, '^(\d+(?:\.\d+)*)\s+(.+)$') THEN regexp_extract(t, '^(\d+(?:\.\d+)*)\s+(.+)$', 1) END num,
        length(t) < 150 AND starts_with(t, '#') md FROM s),
g AS (SELECT *, num IS NOT NULL OR md hd, sum(CASE WHEN num IS NOT NULL OR md THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) grp FROM h),
heads AS (SELECT doc_id, grp, num, CASE WHEN num IS NOT NULL THEN num || ' ' || regexp_extract(t, '^(\d+(?:\.\d+)*)\s+(.+)$', 2) ELSE {strip("regexp_replace(t, '^#+', '')")} END nm FROM g WHERE hd),
c AS (SELECT doc_id, grp, string_agg(x, E'\n' ORDER BY i) content FROM g WHERE NOT hd GROUP BY 1, 2),
r AS (SELECT c.*, num, nm, row_number() OVER (PARTITION BY c.doc_id ORDER BY grp) k FROM c LEFT JOIN heads USING (doc_id, grp)),
sec AS (SELECT doc_id, k, CASE WHEN grp = 0 THEN '0' ELSE coalesce(num, CAST(k AS VARCHAR)) END no, CASE WHEN grp = 0 THEN 'Preamble' ELSE nm END nm, {strip('content')} body FROM r
  UNION ALL SELECT doc_id, 1, '1', 'Document Content', {strip('text')} FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM r)),
long AS (SELECT doc_id, k, list_filter(list_transform(string_split(body, E'\n\n'), lambda y: {strip('y')}), lambda y: y <> '') ps FROM sec WHERE length(body) > 250),
f(doc_id, k, ps, i, cur, done) AS (SELECT doc_id, k, ps, 0, '', CAST(NULL AS VARCHAR) FROM long
  UNION ALL
  SELECT doc_id, k, ps, i + 1, CASE WHEN full_ THEN CASE WHEN tail = '' THEN p ELSE tail || E'\n\n' || p END ELSE longer END, CASE WHEN full_ THEN cur END
  FROM (SELECT *, cur <> '' AND length(longer) > 250 full_, CASE WHEN length(cur) <= 30 THEN cur WHEN instr(right(cur, 30), '. ') > 1 AND instr(right(cur, 30), '. ') < 21 THEN substring(right(cur, 30), instr(right(cur, 30), '. ') + 2) ELSE right(cur, 30) END tail
    FROM (SELECT *, ps[i + 1] p, CASE WHEN cur = '' THEN ps[i + 1] ELSE cur || E'\n\n' || ps[i + 1] END longer FROM f WHERE i < len(ps)))),
made AS (SELECT doc_id, k, 0 i, body b FROM sec WHERE body <> '' AND length(body) <= 250
  UNION ALL SELECT doc_id, k, i, done FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, k, i + 1, cur FROM f WHERE i = len(ps) AND cur <> ''),
n AS (SELECT doc_id, k, b, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS INTEGER) j FROM made)
SELECT doc_id || '_chunk_' || j id, nm || E'\n\n' || b AS text, doc_id, doc_name, doc_type, nm section_name, no section_number, CAST(j // 3 + 1 AS INTEGER) page_number, j chunk_index, 'inputs/' || doc_name file_path
FROM n JOIN sec USING (doc_id, k) JOIN (SELECT doc_id, doc_name, doc_type FROM documents) USING (doc_id)""",
    "c05_chunk_stats": "SELECT upper(trim(doc_type)) kind, count(*) n, count(DISTINCT chunk_id) n_chunks, CAST(sum(length(text)) AS BIGINT) n_chars, count(*) FILTER (chunk_index // 3 + 1 = page_number) n_pages_as_estimated FROM chunks GROUP BY 1",
    "c08_chunk_ids": "SELECT DISTINCT chunk_id, doc_id, doc_id || '_chunk_' || chunk_index made_id, CAST(chunk_index // 3 + 1 AS INTEGER) page FROM chunks",
    "c10_windows": r"""WITH RECURSIVE w(doc_id, text, a, z) AS (
  SELECT doc_id, text, 0, 0 FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, text, z, CASE WHEN z + 10000 < length(text) AND instr(reverse(substring(text, z + 1, 10000)), '.') > 0 AND 10000 - instr(reverse(substring(text, z + 1, 10000)), '.') > 0
      THEN z + 10001 - instr(reverse(substring(text, z + 1, 10000)), '.') ELSE least(z + 10000, length(text)) END
  FROM w WHERE z < length(text))
SELECT doc_id, greatest(count(*) FILTER (z > 0), 1) n_windows, CAST(sum(z - a) AS BIGINT) n_chars, CAST(max(z - a) AS INTEGER) longest FROM w GROUP BY 1""",
    "s_documents_by_source": "SELECT lower(trim(source)) source, count(*) n, CAST(sum(n_chars) AS BIGINT) n_chars FROM documents GROUP BY 1",
    "r02_knn": f"WITH {knn_sql(10)} SELECT query_id, item_id, rank, round(score, 4) score FROM k",
    "r04_knn_filtered": f"WITH {knn_sql(5, 'e.label = 1')} SELECT query_id, item_id, rank, round(score, 4) score FROM k",
    "g17_knn_label_accuracy": f"""WITH {knn_sql(3)}, h AS (SELECT query_id, bool_or(rank = 1 AND a.label = b.label) top1, bool_or(a.label = b.label) top3 FROM k JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = item_id GROUP BY 1)
SELECT count(*) total, count(*) FILTER (top1) top1_correct, count(*) FILTER (top3) top3_correct FROM h""",
    "r05_query_text": r"""SELECT doc_id, array_to_string(list_append(regexp_extract_all(text, '[''"]([^''"]+)[''"]', 1), text), ' ') query FROM documents WHERE text IS NOT NULL""",
    "r07_attach": f"""WITH {knn_sql(3)} SELECT e.vec_id query_id, e.label, k.item_id IS NOT NULL has_sources, rank - 1 pos, item_id FROM embeddings e LEFT JOIN k ON k.query_id = e.vec_id""",
    "r08_stats": "SELECT 'chunks' collection, count(*) n_chunks, count(DISTINCT doc_id) n_docs, 'doc_id,doc_name,section_name' metadata_fields FROM chunks",
    "k01_reindex": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'again' ELSE lang END lang, CAST(length(text) AS INTEGER) n FROM documents WHERE doc_id % 10 <> 0 OR length(text) > 0",
    "v01_synonyms": f"""WITH {_MODELS}, s AS (SELECT DISTINCT project, name entity, t term, {key('t')} k FROM (SELECT project, name, unnest(s) t FROM e) WHERE t IS NOT NULL AND {strip('t')} <> '')
SELECT DISTINCT e.project, e.name, s.term, s.entity FROM e JOIN s ON s.project = e.project AND s.k = {key('e.name')} WHERE s.k <> '' AND s.k NOT IN ('repository', 'service', 'factory', 'gateway', 'aggregate', 'specification')""",
    "v02_banned_terms": "SELECT DISTINCT p_partkey, w term FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) w FROM part) WHERE w IN ('steel', 'brass', 'large', 'small')",
    "v03_naming": "SELECT DISTINCT name FROM specialist_entities WHERE NOT regexp_matches(name, '^[A-Z][A-Za-z0-9]*$')",
    "v04_context_boundary": f"""SELECT DISTINCT model_id, {key('context')} k FROM specialist_entities s WHERE model_id IS NOT NULL AND {key('context')} <> '' AND NOT EXISTS (
  SELECT 1 FROM (SELECT model_id, unnest(allowed_dependencies) x FROM bounded_contexts) b WHERE b.model_id = s.model_id AND {key('b.x')} = {key('s.context')})""",
    "v05_value_objects": f"""WITH {_MODELS} SELECT DISTINCT v.project, v.vo_key FROM v JOIN (SELECT DISTINCT project_name project, {key('a')} k FROM (SELECT project_name, unnest(attributes) a FROM specialist_entities)) s ON s.project = v.project AND s.k = v.vo_key WHERE v.vo_key <> ''""",
    "v06_events": f"""WITH {_MODELS} SELECT project, event, count(DISTINCT context_key) n_contexts FROM (SELECT project, context_key, unnest(u.domain_events) event FROM n) WHERE event IS NOT NULL AND {strip('event')} <> '' GROUP BY 1, 2 HAVING count(DISTINCT context_key) > 1""",
    "x01_keyword": "SELECT DISTINCT chunk_id, regexp_extract(text, '''([^'']+)''', 1) keyword FROM chunks WHERE text IS NOT NULL",
    "m02_sentence_fallback": f"""WITH p AS (SELECT doc_id, unnest(string_split(text, '.')) x, generate_subscripts(string_split(text, '.'), 1) i FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, {strip('x')} sentence, i FROM p), k AS (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 no FROM s WHERE length(sentence) > 20)
SELECT doc_id, CAST(no AS INTEGER) no, sentence FROM k WHERE no < 50""",
    "m09_backoff": r"""SELECT id, CAST(CASE WHEN NOT (contains(m, '429') OR contains(lower(m), 'quota')) THEN 0 WHEN regexp_matches(m, 'retry in \d') THEN greatest(CAST(regexp_extract(m, 'retry in (\d+\.?\d*)', 1) AS DOUBLE), 10) ELSE least(15 * pow(2, r), 300) END AS DOUBLE) wait
FROM (VALUES (1, '429 quota exceeded, retry in 37.5s', 0), (2, 'Quota exceeded', 2), (3, 'quota', 9), (4, 'timeout', 1), (5, '429 retry in 3', 0)) t(id, m, r)""",
    "g09_type_histogram": "SELECT event_type violation_type, count(*) n FROM events GROUP BY 1",
    "k05_sorted_counts": "SELECT event_type, count(*) n FROM events GROUP BY 1 ORDER BY n DESC, event_type",
    "g03_stage_rollup": f"""WITH {CALLS_CTE} SELECT stage, CAST(grouping(stage) AS INTEGER) is_total, count(*) call_count, CAST(coalesce(sum(p), 0) AS BIGINT) prompt_tokens, CAST(coalesce(sum(q), 0) AS BIGINT) completion_tokens, CAST(coalesce(sum(p + q), 0) AS BIGINT) total_tokens, {COST} estimated_cost FROM calls GROUP BY ROLLUP (stage)""",
    "g05_report": f"""WITH {CALLS_CTE} SELECT (SELECT CAST(sum(p + q) AS BIGINT) FROM calls) all_tokens, stage, count(*) call_count, CAST(sum(p) AS BIGINT) prompt_tokens, CAST(sum(q) AS BIGINT) completion_tokens, CAST(sum(p + q) AS BIGINT) total_tokens, {COST} estimated_cost FROM calls GROUP BY stage""",
    "g12_report": """SELECT count(*) total_validations, count(*) FILTER (event_type = 'error') files_with_violations, count(*) FILTER (event_type = 'error') total_violations_found, CAST(sum(length(props)) AS BIGINT) total_code_size_chars,
  count(*) FILTER (value > 50) validations_with_sources, round(100.0::DOUBLE * count(*) FILTER (event_type = 'error') / count(*), 2) violation_rate_percent, count(*) FILTER (event_type = 'error') n_error FROM events""",
    "m01_scout": rf"""WITH RECURSIVE w(doc_id, text, a, z) AS (
  SELECT doc_id, text, 0, 0 FROM documents WHERE text IS NOT NULL AND {strip('text')} <> ''
  UNION ALL
  SELECT doc_id, text, z, CASE WHEN z + 10000 < length(text) AND instr(reverse(substring(text, z + 1, 10000)), '.') > 0 AND 10000 - instr(reverse(substring(text, z + 1, 10000)), '.') > 0
      THEN z + 10001 - instr(reverse(substring(text, z + 1, 10000)), '.') ELSE least(z + 10000, length(text)) END
  FROM w WHERE z < length(text)),
p AS (SELECT doc_id, a, unnest(string_split(substring(text, a + 1, z - a), '.')) x FROM w WHERE z > a),
n AS (SELECT doc_id, a, least(50, count(*) FILTER (length({strip('x')}) > 20)) n FROM p GROUP BY 1, 2)
SELECT doc_id, CAST(greatest(sum(n), 1) AS BIGINT) n_sentences FROM n GROUP BY 1""",
    "m05_synthesise": f"SELECT doc_id, 'Generated Domain Model' project_name, 0 n_contexts, true is_fallback FROM documents WHERE text IS NOT NULL AND {strip('text')} <> ''",
    "m11_lenient_json": f"SELECT DISTINCT model_id, json_valid(payload) OR json_valid({strip("replace(replace(payload, '```json', ''), '```', '')")}) is_json FROM model_payloads WHERE payload IS NOT NULL",
    "r06_summary": rf"""WITH c AS (SELECT DISTINCT chunk_id, string_split(text, E'\n') p, text FROM chunks),
b AS (SELECT chunk_id, text, CASE WHEN len(p) > 2 THEN p[3:] ELSE p END l FROM c),
s AS (SELECT chunk_id, text, l, array_to_string(l, E'\n') t FROM b)
SELECT chunk_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(
  CASE WHEN regexp_matches(t, '(?i)Important:\s*([^\n]+?)(?:\.|$)') THEN left({strip(r"regexp_extract(t, '(?i)Important:\s*([^\n]+?)(?:\.|$)', 1)")}, 200) END,
  CASE WHEN regexp_matches(t, '(?i)([^\n]{{0,50}}(?:should|must)\s+NOT[^\n]+?)(?:\.|$)') THEN left({strip(r"regexp_extract(t, '(?i)([^\n]{{0,50}}(?:should|must)\s+NOT[^\n]+?)(?:\.|$)', 1)").replace('{{0,50}}', '{0,50}')}, 200) END,
  CASE WHEN regexp_matches(t, '(?i)([^\n]{{0,30}}must[^\n]+?)(?:\.|$)') THEN left({strip(r"regexp_extract(t, '(?i)([^\n]{{0,30}}must[^\n]+?)(?:\.|$)', 1)").replace('{{0,30}}', '{0,30}')}, 200) END,
  left(list_filter(list_transform(l, lambda x: {strip('x')}), lambda x: length(x) > 20 AND NOT regexp_matches(x, '^[-*#]'))[1], 200), 'Source reference') END summary FROM s""",
    "g04_cost": f"""WITH {CALLS_CTE} SELECT count(*) total_api_calls, CAST(sum(p) AS BIGINT) total_prompt_tokens, CAST(sum(q) AS BIGINT) total_completion_tokens, CAST(sum(p + q) AS BIGINT) total_tokens, {COST} total_cost FROM calls""",
    "g08_conditional_counts": "SELECT user_id, count(*) FILTER (event_type = 'error') n_error, count(*) FILTER (event_type <> 'error') n_other, round(100.0::DOUBLE * count(*) FILTER (event_type = 'error') / count(*), 4) error_percent FROM events GROUP BY 1",
    "g10_running_avg": """SELECT event_id, count(value) OVER w running_n, round(CAST(sum(CAST(value AS DECIMAL(38,9))) OVER w AS DOUBLE), 4) running_sum,
  CAST(floor(CAST(sum(CAST(value AS DECIMAL(38,9))) OVER w AS DOUBLE) / count(value) OVER w * 10000) AS BIGINT) running_avg_e4 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "g11_summary": """SELECT count(*) total_validations, count(*) FILTER (event_type = 'error') files_with_violations, count(*) FILTER (event_type <> 'error') files_without_violations, count(*) FILTER (event_type = 'error') total_violations_found,
  CAST(sum(length(props)) AS BIGINT) total_code_size_chars, CAST(sum(coalesce(CAST(ceil(length(props) / 4.0) AS BIGINT), 0)) AS BIGINT) total_code_tokens, count(*) FILTER (value > 50) validations_with_sources,
  round(100.0::DOUBLE * count(*) FILTER (event_type = 'error') / count(*), 2) violation_rate_percent, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 2) avg_violations_per_file FROM events""",
    "g13_combined": f"""WITH {CALLS_CTE}, n AS (SELECT count(*) n FROM events) SELECT (SELECT count(*) FROM calls) total_api_calls, n total_validations, round((SELECT sum(p + q) FROM calls)::DOUBLE / n, 2) avg_tokens_per_validation,
  round((SELECT sum(p) FROM calls)::DOUBLE / n, 2) avg_input_tokens, round((SELECT sum(q) FROM calls)::DOUBLE / n, 2) avg_output_tokens FROM n""",
    "g15_timings": "SELECT user_id test_id, count(*) iterations, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value), 4) avg_time_ms FROM events GROUP BY 1",
    "g16_section_match": r"""SELECT DISTINCT section_number, section_name, t <> '' AND (t = section_number OR starts_with(t, section_number || '.')) matches
FROM (SELECT section_number, section_name, regexp_replace(regexp_extract(section_name, '^\s*(\S+)', 1), '\.+$', '') t FROM chunks WHERE section_name IS NOT NULL)""",
    "g19_code_tokens": "SELECT DISTINCT submission_id, coalesce(CAST(ceil(length(content) / 4.0) AS BIGINT), 0) n_tokens FROM code_submissions",
}
