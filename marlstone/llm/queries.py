"""Queries of the problems on training data, and SQL for those that SQL can check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import credentials, mixing, packing, spans, splitting, survivors, tokens
from marlstone.session import cut
from marlstone.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_credentials(table(spark, d, "code_submissions"))


def p1_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What became of all literals: how many values and places each step of the method decided."""
    return credentials.decisions(table(spark, d, "code_submissions"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "code_submissions")
    return credentials.redact(files, credentials.find_credentials(files))


def _entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "specialist_entities"), table(spark, d, "source_trust")


def _listed(best: DataFrame) -> DataFrame:
    return best.withColumn("attributes", F.to_json("attributes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.suppliers(*_entities(spark, d))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving records with the votes that their values have."""
    return _listed(survivors.survivors(*_entities(spark, d)))


def p3_voted(spark: SparkSession, d: str) -> DataFrame:
    """Survivors where each spelling stands for election by itself."""
    return _listed(survivors.survivors(*_entities(spark, d), spelled=True))


def _chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "chunks"), table(spark, d, "chunk_limits")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.counted(*_chunks(spark, d))[0].select("chunk_id", "forced").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_chunks(*_chunks(spark, d))


def p5_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The texts that are split by ranges of bytes: how many ranges and pieces each has."""
    ranges = splitting.counted(*_chunks(spark, d))[1]
    made = ranges.groupBy("path", "base").agg(F.first("_key").alias("chunk_id"), F.count("*").alias("n_ranges"), F.sum("n_pieces").alias("n_pieces"), F.max("total").alias("n_bytes"))
    return made.drop("path", "base").distinct()


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Every document's size in tokens, counted once."""
    return cut(tokens.token_counts(table(spark, d, "documents"), "doc_id", "text", keep=["source"]), "sizes")


def _windows(spark: SparkSession, d: str, most: int = 100) -> list[tuple[str, int]]:
    rows = table(spark, d, "context_windows").select("window_name", "capacity_tokens").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} windows")
    return sorted((r["window_name"] or "", r["capacity_tokens"]) for r in rows if r["capacity_tokens"] and r["capacity_tokens"] > 0)


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each window."""
    sizes = _sizes(spark, d)
    # each window is written by itself, so that no plan holds all of them
    parts = [cut(packing.pack(sizes, c).select(F.lit(w).alias("window_name"), "container_no", "doc_id", "piece_no", "start_token", "n_tokens"), "packed") for w, c in _windows(spark, d)]
    return reduce(DataFrame.unionByName, parts)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each window are."""
    sizes = _sizes(spark, d)
    return reduce(DataFrame.unionByName, [packing.fill(cut(packing.pack(sizes, c), "packed"), c).select(F.lit(w).alias("window_name"), "*") for w, c in _windows(spark, d)])


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "source_weights"))


def _all_tokens(sizes: DataFrame) -> int:
    return sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]  # one number


def p7_full(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of as many tokens as all documents have: scarce sources fall short of their shares."""
    sizes = _sizes(spark, d)
    return mixing.mix(sizes, table(spark, d, "source_weights"), total_tokens=_all_tokens(sizes))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that p7_mixture and p7_full reached."""
    sizes, weights = _sizes(spark, d), table(spark, d, "source_weights")
    parts = [mixing.shares(sizes, weights, mixing.mix(sizes, weights, t), t).select(F.lit(name).alias("mixture"), "*") for name, t in (("shares held", None), ("all tokens", _all_tokens(sizes)))]
    return reduce(DataFrame.unionByName, parts)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return spans.shared_shares(docs, spans.shared_spans(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p1_decisions, p3_found, p3_survivors, p3_voted, p5_found, p5_pieces, p5_ranges, p6_packed, p6_fill, p7_mixture, p7_full, p7_shares, p8_found, p8_shares)}

_P3 = r"""
top AS (SELECT coalesce(max(trust_rank), 0) + 1 worst FROM source_trust),
rows_ AS (SELECT DISTINCT record_id, model_id, name, context, attributes, source, extracted_at FROM specialist_entities),
r AS (SELECT e.*, coalesce(t.trust_rank, worst) tr, coalesce(e.extracted_at, TIMESTAMP '0001-01-01') ts,
        CAST((worst + 1 - coalesce(t.trust_rank, worst)) * coalesce(greatest(0.001::DOUBLE, pow(0.5::DOUBLE, (epoch((SELECT max(extracted_at) FROM specialist_entities)) - epoch(e.extracted_at)) / 86400 / 180)), 0.001::DOUBLE) AS DECIMAL(20,6)) vote,
        regexp_replace(lower(e.context), '[^\p{L}\p{N}]', '', 'g') ck, regexp_replace(lower(e.name), '[^\p{L}\p{N}]', '', 'g') nk,
        list_sort(list_distinct(list_filter(list_transform(coalesce(e.attributes, []), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> '' AND x NOT IN ('na', 'none', 'null', 'nil', 'tbd', 'tba', 'unknown', 'undefined', 'notavailable', 'notapplicable', 'novalue')))) ak
      FROM rows_ e CROSS JOIN top LEFT JOIN source_trust t ON t.source = e.source),
g AS (SELECT *, len(ak) na, min(record_id) OVER w group_id, max(record_id) OVER w hi, count(*) OVER w n_records,
        row_number() OVER (w ORDER BY tr, ts DESC, record_id) r1, row_number() OVER (w ORDER BY ts DESC, tr, record_id) r2, row_number() OVER (w ORDER BY len(ak) DESC, tr, ts DESC, record_id) r3
      FROM r WHERE ck <> '' AND nk <> '' AND model_id IS NOT NULL WINDOW w AS (PARTITION BY model_id, ck, nk))
"""


def _elected(name: str, context: str, attributes: str) -> str:
    """SQL of the survivors where the values of a field are told apart by these expressions."""
    part = lambda field, ballot, lead, order, value: f"""SELECT group_id, hi, n_records, model_id, '{field}' field, record_id, {value} v, {lead} lead, sum(vote) OVER (PARTITION BY group_id, {lead}, {ballot}) votes, row_number() OVER (PARTITION BY group_id ORDER BY {order}) rk FROM g"""
    all_ = " UNION ALL ".join(
        (
            part("name", name, "0", "tr, ts DESC, record_id", "name"),
            part("context", context, "0", "ts DESC, tr, record_id", "context"),
            part("attributes", attributes, "na", "tr, ts DESC, record_id", "CAST(attributes AS VARCHAR)"),
        )
    )
    first = lambda f, c: f"max(CASE WHEN field = '{f}' THEN {c} END)"
    return f"""WITH {_P3}, e AS ({all_}),
w AS (SELECT *, row_number() OVER (PARTITION BY group_id, field ORDER BY lead DESC, votes DESC, rk) best FROM e WHERE hi <> group_id AND (field <> 'attributes' OR lead > 0))
SELECT group_id, any_value(model_id) model_id, any_value(n_records) n_records, {first('name', 'v')} name, {first('name', 'record_id')} name_record, {first('name', 'votes')} name_votes,
  {first('context', 'v')} context, {first('context', 'record_id')} context_record, {first('context', 'votes')} context_votes,
  (SELECT any_value(to_json(attributes)) FROM rows_ x WHERE x.record_id = {first('attributes', 'w.record_id')}) attributes, {first('attributes', 'record_id')} attributes_record, {first('attributes', 'votes')} attributes_votes
FROM w WHERE best = 1 GROUP BY group_id"""


def _pieces_sql() -> str:
    """SQL of the pieces of all chunks: one step of the recursion finds the next cut of each text."""
    marks = {"paragraph": (("(?:\\n\\n|\\r\\r)", 2), ("\\r\\n\\r\\n", 4)), "line": (("[\\n\\r]", 1),), "sentence": (("(?:[.!?] |\\.\\t)", 2),), "space": (("[ \\t]", 1),)}

    def last_end(mark: str, n: int, floor: str) -> str:
        begin = f"greatest(0, {floor} + 1 - {n})"
        return f"coalesce({begin} + nullif(length(regexp_extract(substring(text, {begin} + 1, high - {begin}), '(?s)^(.*{mark})', 1)), 0), -1)"

    ends, cuts, kinds = [], [], []
    for floor in ("soft", "low"):
        for kind, of in marks.items():
            e = f"{kind}_{floor}"
            ends.append(f"greatest({', '.join(last_end(m, n, floor) for m, n in of)}) {e}" if len(of) > 1 else f"{last_end(*of[0], floor)} {e}")
            # not between the two of a line end
            cut = f"CASE WHEN {e} > {floor} THEN CASE WHEN substring(text, {e}, 1) = chr(13) AND substring(text, {e} + 1, 1) = chr(10) THEN CASE WHEN {e} < high THEN {e} + 1 WHEN {e} - 1 > {floor} THEN {e} - 1 END ELSE {e} END END"
            cuts.append(cut)
            kinds.append(f"WHEN {cut} IS NOT NULL THEN '{kind}'")
    return f"""WITH RECURSIVE c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, doc_id DESC, chunk_index DESC) rn FROM chunks) WHERE rn = 1),
t AS (SELECT c.*, greatest(1, max_chars) m, least(overlap_chars, greatest(1, max_chars) // 2) o FROM c JOIN chunk_limits k ON lower(k.doc_type) = CASE WHEN lower(trim(c.doc_type)) IN (SELECT lower(doc_type) FROM chunk_limits) THEN lower(trim(c.doc_type)) ELSE '*' END),
w(chunk_id, text, m, o, k, pos, a, z, kind) AS (SELECT chunk_id, text, m, o, -1, 0, 0, 0, '' FROM t WHERE length(text) > m
  UNION ALL
  SELECT chunk_id, text, m, o, k + 1, CASE WHEN kind <> 'end' THEN z - o END, pos, z, kind
  FROM (SELECT *, CASE WHEN rest THEN length(text) ELSE coalesce({', '.join(cuts)}, high) END z, CASE WHEN rest THEN 'end' {' '.join(kinds)} ELSE 'forced' END kind
    FROM (SELECT *, {', '.join(ends)}
      FROM (SELECT chunk_id, text, m, o, k, pos, pos + o low, pos + greatest(o, m // 2) soft, pos + m high, length(text) - pos <= m rest FROM w WHERE pos IS NOT NULL)))),
p AS (SELECT chunk_id, k, a, z - a n, kind, substring(text, a + 1, z - a) piece FROM w WHERE k >= 0
  UNION ALL SELECT chunk_id, 0, 0, coalesce(length(text), 0), 'whole', text FROM t WHERE text IS NULL OR length(text) <= m)
SELECT t.chunk_id, t.doc_id, t.doc_name, t.doc_type, t.section_name, t.section_number, CAST(row_number() OVER (PARTITION BY t.doc_id ORDER BY t.chunk_index NULLS FIRST, t.chunk_id, k) - 1 AS INTEGER) chunk_index,
  CAST(k AS INTEGER) piece_no, CAST(a AS INTEGER) start_pos, CAST(n AS INTEGER) n_chars, kind cut_kind, piece AS text FROM t JOIN p USING (chunk_id)"""


ORACLES = {
    "p5_pieces": _pieces_sql(),
    "p3_survivors": _elected("1", "1", "1"),
    "p3_voted": _elected("trim(name)", "trim(context)", "ak"),
    "p3_found": f"""WITH {_P3} SELECT group_id, 'name' field, record_id FROM g WHERE r1 = 1 AND group_id <> hi
UNION ALL SELECT group_id, 'context', record_id FROM g WHERE r2 = 1 AND group_id <> hi
UNION ALL SELECT group_id, 'attributes', record_id FROM g WHERE r3 = 1 AND na > 0 AND group_id <> hi""",
    "p5_found": r"""
WITH c AS (SELECT DISTINCT chunk_id, text, CASE WHEN lower(trim(doc_type)) IN (SELECT lower(doc_type) FROM chunk_limits) THEN lower(trim(doc_type)) ELSE '*' END t FROM chunks),
l AS (SELECT c.chunk_id, c.text, max_chars m FROM c JOIN chunk_limits k ON lower(k.doc_type) = c.t WHERE length(c.text) > k.max_chars)
SELECT DISTINCT chunk_id, CAST(list_max(list_transform(regexp_split_to_array(text, '[ \t\r\n]'), lambda x: length(x))) > m AS INTEGER) forced FROM l""",
}
