"""Detection of violations of a domain model: each rule is a join of a code relation with a relation of the model.

Terms meet identifiers by the words of both, in equi-joins, so no term is compared with every identifier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.strings import is_blank, letters_digits
from marlstone.operators.code import identifiers, rows_of
from marlstone.session import cut

# --- fixed values: allowed endings, primitive types, emitting calls, forms of names ---
ALLOWED = ("repository", "service", "factory", "gateway", "aggregate", "specification")
PRIMITIVES = ("str", "int", "float", "bool", "bytes", "complex", "dict", "list", "tuple")
EMITS = r"(?i)(emit|publish|trigger)\w*$"
PASCAL, SNAKE = r"^[A-Z][A-Za-z0-9]*$", r"^_{0,2}[a-z][a-z0-9_]*$"
# --- end of fixed values ---


def words(name: Column) -> Column:
    """The lower-case words of a camel-case or snake-case name."""
    split = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(split), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_runs(name: Column) -> Column:
    """All runs of neighbouring words, joined: what a term may match."""
    w = words(name)
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), "")))
    return F.when(n > 0, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


def pascal(snake: Column) -> Column:
    return F.regexp_replace(F.initcap(F.regexp_replace(snake, "_", " ")), " ", "")


def model_relations(models: DataFrame, project: str = "project_name") -> dict[str, DataFrame]:
    """Flat relations of the models' nested columns by project: contexts, dependencies, names, synonyms, attributes,
    events and banned terms. models has project_name, bounded_contexts and global_rules, one row for a project."""
    contexts = models.select(F.col(project).alias("project"), F.explode("bounded_contexts").alias("c")).filter("c IS NOT NULL")
    named = contexts.select("project", F.col("c.context_name").alias("context"), letters_digits(F.col("c.context_name")).alias("context_key"), F.col("c.allowed_dependencies").alias("deps"), "c.ubiquitous_language").filter(~is_blank(F.col("context")))
    language = named.select("project", "context", "context_key", "ubiquitous_language.*")
    entities = language.select("project", "context", "context_key", F.explode("entities").alias("e")).filter("e.name IS NOT NULL")
    values = language.select("project", "context", "context_key", F.explode("value_objects").alias("v")).filter("v.name IS NOT NULL")
    return {
        "contexts": named.select("project", "context", "context_key").distinct(),
        "dependencies": named.select("project", "context_key", F.explode("deps").alias("d")).filter(~is_blank(F.col("d"))).select("project", "context_key", letters_digits(F.col("d")).alias("dep_key")).distinct(),
        "entities": entities.select("project", "context", "context_key", F.col("e.name").alias("name"), letters_digits(F.col("e.name")).alias("name_key")).distinct(),
        "names": entities.select("project", F.col("e.name").alias("name")).unionByName(values.select("project", F.col("v.name").alias("name"))).distinct(),
        "synonyms": entities.select("project", F.col("e.name").alias("entity"), F.explode("e.synonyms_to_avoid").alias("term")).filter(~is_blank(F.col("term"))).withColumn("term_key", letters_digits(F.col("term"))).filter("length(term_key) > 0").distinct(),
        "attributes": values.select("project", F.col("v.name").alias("value_object"), letters_digits(F.col("v.name")).alias("vo_key"), F.explode_outer("v.attributes").alias("attribute")).withColumn("attribute_key", letters_digits(F.col("attribute"))).distinct(),
        "events": language.select("project", "context", "context_key", F.explode("domain_events").alias("event")).filter(~is_blank(F.col("event"))).distinct(),
        "banned": models.select(F.col(project).alias("project"), F.explode("global_rules.banned_global_terms").alias("term")).filter(~is_blank(F.col("term"))).withColumn("term_key", letters_digits(F.col("term"))).filter("length(term_key) > 0").distinct(),
    }


def terms_in(names: DataFrame, terms: DataFrame, on: list[str], name: str = "name") -> DataFrame:
    """names joined with the terms that one of their runs of words equals; allowed endings do not count as runs."""
    ending = F.element_at(words(F.col(name)), -1)
    runs = F.filter(word_runs(F.col(name)), lambda r: ~(r.isin(*ALLOWED) & (r == ending)))
    return names.withColumn("term_key", F.explode(runs)).join(terms, [*on, "term_key"])


def own_contexts(parsed: DataFrame, rel: dict[str, DataFrame], key: str, filename: str, project: str) -> DataFrame:
    """(key, own_key): the context a file belongs to: a segment of its path is named like it, else it has most of the
    entities that the file's classes are named after; ties go to the first name; none if neither."""
    path = parsed.select(F.col(key), F.col(project).alias("project"), F.explode(F.split(F.regexp_replace(filename, r"\.[^./\\]*$", ""), r"[/\\]")).alias("s")).withColumn("context_key", letters_digits(F.col("s"))).join(rel["contexts"], ["project", "context_key"]).select(key, "context_key", F.lit(1 << 30).alias("n"))
    owned = rows_of(parsed, "classes", [key, project]).select(key, F.col(project).alias("project"), "name").join(rel["entities"].select("project", "name", "context_key"), ["project", "name"]).groupBy(key, "context_key").agg(F.count("*").alias("n"))
    best = path.unionByName(owned).groupBy(key, "context_key").agg(F.max("n").alias("n"))
    return best.groupBy(key).agg(F.min_by("context_key", F.struct(-F.col("n"), F.col("context_key"))).alias("own_key"))


def naming(names: DataFrame) -> DataFrame:
    """Classes that are not in Pascal case and functions that are not in snake case; dunder names are in snake case."""
    return names.filter(((F.col("kind") == "class") & ~F.col("name").rlike(PASCAL)) | ((F.col("kind") == "function") & ~F.col("name").rlike(SNAKE)))


def violations(parsed: DataFrame, models: DataFrame, key: str = "submission_id", filename: str = "filename", project: str = "project_name") -> DataFrame:
    """(key, filename, type, subject, line, message, suggestion) of all rules over parsed code and its project's model.

    Files that do not parse have one SyntaxError and files without a model one ConfigError, before any other. Names
    that equal an entity or value object are never flagged for terms; null filenames are not checked as names.
    """
    # written once: every rule below reads its relations from them
    models = cut(models.select("project_name", "bounded_contexts", "global_rules"), "latest-models")
    rel = model_relations(models)
    keep = [key, filename, project]
    has_model = parsed.join(models.select(F.col("project_name").alias("_p")).distinct(), F.col(project) == F.col("_p"), "left").withColumn("_known", F.col("_p").isNotNull()).drop("_p")
    early = has_model.filter(~F.col("_known") | F.col("error").isNotNull()).select(
        key, filename, F.when(~F.col("_known"), "ConfigError").otherwise("SyntaxError").alias("type"), F.col(filename).alias("subject"), F.lit(0).alias("line"),
        F.when(~F.col("_known"), F.lit("No domain model")).otherwise(F.col("error")).alias("message"), F.when(~F.col("_known"), F.lit("Provide a domain model")).otherwise(F.lit("Fix the syntax")).alias("suggestion"),
    )
    good = has_model.filter(F.col("_known") & F.col("error").isNull()).drop("_known")
    own = own_contexts(good, rel, key, filename, project)
    row = lambda df, kind, subject, message, suggestion: df.select(key, filename, F.lit(kind).alias("type"), subject.alias("subject"), "line", message.alias("message"), suggestion.alias("suggestion"))
    said = F.format_string

    ids = identifiers(good, keep, filename).withColumn("project", F.col(project)).filter("name IS NOT NULL")
    bare = F.when(F.col("kind") == "file", F.regexp_replace(F.regexp_extract("name", r"([^/\\]*)$", 1), r"\.[^.]*$", "")).otherwise(F.col("name"))
    ids = ids.withColumn("bare", bare)
    free = ids.join(rel["names"].withColumnRenamed("name", "bare"), ["project", "bare"], "left_anti")
    parts = [early]
    syn = terms_in(free.filter("kind <> 'file'"), rel["synonyms"], ["project"], "bare")
    parts.append(row(syn, "SynonymViolation", F.col("name"), said("%s '%s' uses the synonym '%s' of '%s'", "kind", "name", "term", "entity"), said("Use '%s'", "entity")))
    ban = terms_in(free, rel["banned"], ["project"], "bare")
    parts.append(row(ban, "BannedTermViolation", F.col("name"), said("%s '%s' contains the banned term '%s'", "kind", "name", "term"), said("Leave out '%s'", "term")))
    bad = naming(free)
    parts.append(row(bad, "NamingConventionViolation", F.col("name"), said("%s '%s' breaks the naming convention", "kind", "name"), F.when(F.col("kind") == "class", F.lit("Use PascalCase")).otherwise(F.lit("Use snake_case"))))

    imports = rows_of(good, "imports", keep).withColumn("project", F.col(project)).withColumn("context_key", letters_digits(F.split("module", r"\.")[0]))
    outside = imports.join(rel["contexts"], ["project", "context_key"]).join(own, key).filter("own_key <> context_key")
    outside = outside.join(rel["dependencies"].select("project", F.col("context_key").alias("own_key"), F.col("dep_key").alias("context_key")), ["project", "own_key", "context_key"], "left_anti")
    parts.append(row(outside, "ContextBoundaryViolation", F.col("module"), said("import of '%s' reaches into '%s'", "module", "context"), said("Do not depend on '%s'", "context")))

    params = rows_of(good, "functions", keep).select(*keep, F.col(project).alias("project"), F.col("name").alias("function"), "line", F.explode("parameters").alias("p")).filter(F.col("p.type").isin(*PRIMITIVES)).withColumn("attribute_key", letters_digits(F.col("p.name")))
    loose = params.join(rel["attributes"].filter("length(attribute_key) > 0"), ["project", "attribute_key"])
    parts.append(row(loose, "ValueObjectViolation", F.col("p.name"), said("parameter '%s' of '%s' is a plain %s", "p.name", "function", "p.type"), said("Use '%s'", "value_object")))
    sets = rows_of(good, "assignments", keep).filter("value_type = 'str' AND instr(target, '.') > 0").withColumn("project", F.col(project)).withColumn("vo_key", letters_digits(F.col("target")))
    literal = sets.join(rel["attributes"].select("project", "value_object", "vo_key").distinct(), ["project", "vo_key"])
    parts.append(row(literal, "ValueObjectViolation", F.col("target"), said("assignment of a literal to '%s'", "target"), said("Use '%s'", "value_object")))

    calls = rows_of(good, "function_calls", keep).filter(F.col("function").rlike(EMITS)).withColumn("project", F.col(project)).withColumn("event", F.explode(F.array_distinct("args")))
    at_home = calls.join(rel["events"], ["project", "event"]).join(own, key)
    places = [c for c in (key, filename, "event", "line", "no")]
    away = at_home.groupBy(*places).agg(F.bool_or(F.col("own_key") == F.col("context_key")).alias("home"), F.min("context").alias("context")).filter("NOT home")
    parts.append(row(away, "DomainEventViolation", F.col("event"), said("event '%s' is defined in '%s'", "event", "context"), said("Emit it in '%s'", "context")))
    return reduce(DataFrame.unionByName, parts).distinct()


def flag(files: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """files with their violations and is_violation: true if there is any."""
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("type", "line", "subject", "message", "suggestion"))).alias("violations"))  # one file's
    both = files.join(lists, key, "left")
    return both.withColumn("is_violation", F.coalesce(F.size("violations") > 0, F.lit(False)))
