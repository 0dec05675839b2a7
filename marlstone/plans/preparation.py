"""Queries of the general data-preparation problems: nested records (p2_) and missing references (p4_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import nested, references
from marlstone.tables import table


def _models(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return nested.model_tables(table(spark, d, "domain_models"), table(spark, d, "model_payloads"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.model_leaves(_models(spark, d))


def p2_contexts(spark: SparkSession, d: str) -> DataFrame:
    t = _models(spark, d)["bounded_contexts"]
    return t.select("model_id", "parent_key", "row_key", F.col("ords")[0].alias("context_no"), F.col("f_context_name").alias("context_name"), F.col("f_description").alias("description"))


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    made = _models(spark, d)
    part = lambda path, kind: made[f"bounded_contexts.ubiquitous_language_{path}"].select("model_id", "parent_key", "row_key", F.col("ords")[0].alias("context_no"), F.lit(kind).alias("item_kind"), F.col("ords")[1].alias("item_no"), F.col("f_name").alias("name"))
    return part("entities", "entity").unionByName(part("value_objects", "value_object"))


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all child tables that do not point to exactly one parent, and keys that are not unique."""
    return nested.broken_links(_models(spark, d))


def _typed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables of the typed models alone, which SQL can check."""
    t = table(spark, d, "domain_models").select("model_id", "bounded_contexts").distinct()
    return nested.flatten(t, "model_id", "bounded_contexts")


def p2_typed_contexts(spark: SparkSession, d: str) -> DataFrame:
    t = _typed(spark, d)["bounded_contexts"]
    return t.select("model_id", F.col("ords")[0].alias("context_no"), F.col("f_context_name").alias("context_name"), F.col("f_description").alias("description"), "parent_key", "row_key")


def p2_typed_items(spark: SparkSession, d: str) -> DataFrame:
    made = _typed(spark, d)
    part = lambda path, kind: made[f"bounded_contexts.ubiquitous_language_{path}"].select("model_id", "parent_key", F.col("ords")[0].alias("context_no"), F.lit(kind).alias("item_kind"), F.col("ords")[1].alias("item_no"), F.col("f_name").alias("name"))
    return part("entities", "entity").unionByName(part("value_objects", "value_object"))


def p2_typed_leaves(spark: SparkSession, d: str) -> DataFrame:
    return nested.model_leaves(_typed(spark, d))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(table(spark, d, "bounded_contexts"), table(spark, d, "shared_contexts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct rows of the cascade."""
    return _orphans(spark, d).filter("direct").select("table_name", "context_id", "dep_no", "reason", "period")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month and reason, inherited ones among them."""
    return references.report(_orphans(spark, d))


def p4_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Records of the registry with direct or inherited orphans, with their depth in the cascade."""
    return references.states(_orphans(spark, d))


def p4_levels(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table and month."""
    return references.levels(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_contexts, p2_items, p2_links, p2_typed_contexts, p2_typed_items, p2_typed_leaves, p4_found, p4_report, p4_cascade, p4_levels)}

_P4 = r"""
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY loaded_at DESC NULLS LAST) rn FROM bounded_contexts) WHERE rn = 1),
common AS (SELECT DISTINCT * FROM shared_contexts),
cand AS (SELECT 'bounded_contexts:' || context_id rec, model_id, registered_at, removed_at, regexp_replace(lower(context_name), '[^\p{L}\p{N}]', '', 'g') k FROM own WHERE model_id IS NOT NULL
         UNION ALL SELECT 'shared_contexts:' || context_id, NULL, registered_at, removed_at, regexp_replace(lower(context_name), '[^\p{L}\p{N}]', '', 'g') FROM common),
refs AS (SELECT 'bounded_contexts' table_name, context_id, model_id, registered_at t, generate_subscripts(allowed_dependencies, 1) - 1 dep_no, unnest(allowed_dependencies) dep FROM own
         UNION ALL SELECT 'shared_contexts', context_id, NULL, registered_at, generate_subscripts(allowed_dependencies, 1) - 1, unnest(allowed_dependencies) FROM common),
named AS (SELECT *, regexp_replace(lower(dep), '[^\p{L}\p{N}]', '', 'g') k FROM refs WHERE dep IS NOT NULL AND trim(dep, E' \t\r\n') <> ''),
pairs AS (SELECT r.table_name, r.context_id, r.dep_no, r.t, c.rec, c.k IS NOT NULL is_cand, coalesce(c.registered_at <= r.t, false) known, coalesce(c.registered_at <= r.t AND (c.removed_at IS NULL OR c.removed_at > r.t), false) live
         FROM named r LEFT JOIN cand c ON c.k = r.k AND c.k <> '' AND (c.model_id IS NULL OR c.model_id = r.model_id)),
seen AS (SELECT table_name, context_id, CAST(dep_no AS INTEGER) dep_no, t, bool_or(live) live, bool_or(known) known, count(*) FILTER (is_cand) n FROM pairs GROUP BY ALL),
found AS (SELECT table_name, context_id, dep_no, CASE WHEN known THEN 'deleted' WHEN n > 0 THEN 'later' ELSE 'missing' END reason, strftime(t, '%Y-%m') period FROM seen WHERE NOT live)
"""
_CASCADE = _P4 + r""",
links AS (SELECT table_name || ':' || context_id child, table_name, context_id, CAST(dep_no AS INTEGER) dep_no, t, list(DISTINCT rec) bearers FROM pairs WHERE live GROUP BY ALL),
s(n, ids, before) AS (SELECT 0, (SELECT coalesce(list(DISTINCT table_name || ':' || context_id), []) FROM found), -1
  UNION ALL SELECT n + 1, list_distinct(list_concat(ids, (SELECT coalesce(list(DISTINCT child), []) FROM links WHERE list_has_all(s.ids, bearers)))), len(ids) FROM s WHERE len(ids) > before),
last_ AS (SELECT ids FROM s ORDER BY n DESC LIMIT 1),
inherited AS (SELECT table_name, context_id, dep_no, 'inherited' reason, strftime(t, '%Y-%m') period FROM links, last_ WHERE list_has_all(ids, bearers)),
every AS (SELECT *, true direct FROM found UNION ALL SELECT *, false FROM inherited)
"""

_P2 = """
m AS (SELECT DISTINCT model_id, bounded_contexts FROM domain_models),
c AS (SELECT model_id, CAST(generate_subscripts(bounded_contexts, 1) - 1 AS INTEGER) cn, unnest(bounded_contexts) c FROM m)
"""

ORACLES = {
    "p2_links": "SELECT CAST(0 AS BIGINT) n_without_parent, CAST(0 AS BIGINT) n_with_several, CAST(0 AS BIGINT) n_repeated_keys",
    "p2_typed_contexts": f"WITH {_P2} SELECT model_id, cn context_no, c.context_name, c.description, CAST(model_id AS VARCHAR) parent_key, model_id || '/bounded_contexts:' || cn row_key FROM c",
    "p2_typed_items": f"""WITH {_P2}, i AS (SELECT model_id, cn, 'entity' k, CAST(generate_subscripts(c.ubiquitous_language.entities, 1) - 1 AS INTEGER) n, unnest(list_transform(c.ubiquitous_language.entities, lambda x: x.name)) name FROM c
  UNION ALL SELECT model_id, cn, 'value_object', CAST(generate_subscripts(c.ubiquitous_language.value_objects, 1) - 1 AS INTEGER), unnest(list_transform(c.ubiquitous_language.value_objects, lambda x: x.name)) FROM c)
SELECT model_id, model_id || '/bounded_contexts:' || cn parent_key, cn context_no, k item_kind, n item_no, name FROM i""",
    "p2_typed_leaves": r"""
WITH m AS (SELECT DISTINCT model_id, bounded_contexts FROM domain_models),
c AS (SELECT model_id, generate_subscripts(bounded_contexts, 1) - 1 cn, unnest(bounded_contexts) c FROM m),
i AS (SELECT model_id, cn, 'entity' item_kind, generate_subscripts(c.ubiquitous_language.entities, 1) - 1 n, unnest(list_transform(c.ubiquitous_language.entities, lambda x: x.synonyms_to_avoid)) l FROM c
      UNION ALL SELECT model_id, cn, 'value_object', generate_subscripts(c.ubiquitous_language.value_objects, 1) - 1, unnest(list_transform(c.ubiquitous_language.value_objects, lambda x: x.attributes)) FROM c),
f AS (SELECT *, generate_subscripts(l, 1) - 1 ln, unnest(l) leaf FROM i)
SELECT DISTINCT model_id, CAST(cn AS INTEGER) context_no, item_kind, CAST(n AS INTEGER) item_no, CASE item_kind WHEN 'entity' THEN 'synonym' ELSE 'attribute' END leaf_kind, CAST(ln AS INTEGER) leaf_no, leaf
FROM f WHERE leaf IS NOT NULL AND trim(leaf, E' \t\r\n') <> ''""",
    "p4_found": f"WITH {_P4} SELECT * FROM found",
    "p4_report": f"WITH RECURSIVE {_CASCADE} SELECT table_name, period, reason, count(*) n_refs, count(DISTINCT context_id) n_contexts FROM every GROUP BY ALL",
    "p4_cascade": f"""WITH RECURSIVE {_CASCADE}, d AS (SELECT rec, min(n) depth FROM (SELECT n, unnest(ids) rec FROM s) GROUP BY 1)
SELECT split_part(rec, ':', 1) table_name, CAST(split_part(rec, ':', 2) AS BIGINT) context_id, depth, depth = 0 direct FROM d""",
    "p4_levels": f"""WITH RECURSIVE {_CASCADE}, o AS (SELECT table_name, context_id, period, count(*) FILTER (direct) d, count(*) FILTER (NOT direct) i FROM every GROUP BY ALL)
SELECT table_name, period, CAST(sum(d) AS BIGINT) n_direct_refs, CAST(sum(i) AS BIGINT) n_inherited_refs, count(*) FILTER (d > 0) n_direct, count(*) FILTER (d = 0) n_inherited FROM o GROUP BY ALL""",
}
