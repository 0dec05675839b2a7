"""Deeply nested records as flat tables whose rows point to their parents.

A merged schema is inferred from typed columns and from JSON text, every array level becomes a child table, and
each child row carries the root's key, its parent's surrogate key and its ordinals on the way down.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.session import cut

#: The levels of a domain model: field -> fields of its members. A leaf list holds plain strings.
LEAVES = ("synonyms_to_avoid", "attributes")
ITEMS = ("entities", "value_objects")


def _key(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def _get(node: dict, field: str):
    """The member of that name in any letter style; an exact name goes first."""
    if field in node:
        return node[field]
    want = _key(field)
    return next((v for k, v in node.items() if _key(k) == want), None)


def _values_in(text: str) -> Iterator:
    """The JSON values of a text, whatever words stand around them. Brackets that begin no value are words; what stands
    within a value that breaks off is part of it and no value of its own."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        at = min((i for i in (text.find("{", at), text.find("[", at)) if i >= 0), default=-1)
        if at < 0:
            return
        try:
            value, at = decoder.raw_decode(text, at)
            yield value
        except ValueError as e:
            at = max(at + 1, getattr(e, "pos", 0))


def read_json_text(text: str | None, good: Callable[[object], bool] = lambda value: True):
    """The first complete JSON value that is good of a text that may be fenced, quoted as a JSON string or surrounded by
    words. None for null, blank and incomplete texts, and where no value is good."""
    if text is None:
        return None
    s = text.lstrip("\ufeff").strip()
    for _ in range(3):  # text quoted as a JSON string, at most twice
        try:
            value = json.loads(s)
        except ValueError:
            return next((v for v in _values_in(s) if good(v)), None)
        if not isinstance(value, str):
            return value if good(value) else None
        s = value.lstrip("\ufeff").strip()
    return None


def _members(node) -> list:
    """The members of a list; an object in place of a list counts its values; anything else has none."""
    return node if isinstance(node, list) else list(node.values()) if isinstance(node, dict) else []


def _text(node) -> str | None:
    return node if node is None or isinstance(node, str) else json.dumps(node, ensure_ascii=False)


def _plain(node):
    """A value with its names in lower case and without signs; names that become equal are numbered."""
    if isinstance(node, list):
        return [_plain(x) for x in node]
    if not isinstance(node, dict):
        return node
    out: dict = {}
    for k, v in node.items():
        name = "".join(c if c.isalnum() or c == "_" else "_" for c in k.lower()) or "_"
        n = 1
        while name in out:
            n += 1
            name = f"{name.removesuffix(f'_{n - 1}')}_{n}"
        out[name] = _plain(v)
    return out


def _with_others(made: dict, node: dict, known: tuple[str, ...]) -> dict:
    """made and, under other, the fields of node that are none of known."""
    keys = {_key(k) for k in known}
    others = {k: v for k, v in node.items() if _key(k) not in keys}
    return {**made, "other": _plain(others)} if others else made


def _leaf(node) -> dict | None:
    """A leaf as an object with a name, whatever else an object in its place has."""
    if isinstance(node, dict):
        return _with_others({"name": _text(_get(node, "name"))}, node, ("name",))
    return None if node is None else {"name": _text(node)}


def _leaf_list(node) -> list | None:
    if node is None:
        return None
    return [_leaf(x) for x in (node if isinstance(node, list) else [node])]


def _find_contexts(value):
    """The contexts of a model, wherever its wrapper puts them; the outermost go first."""
    level = [value]
    while level:
        below = []
        for node in level:
            if isinstance(node, dict):
                found = _get(node, "bounded_contexts")
                if found is not None:
                    return found
            below += [v for v in _members(node) if isinstance(v, (dict, list))]
        level = below
    return None


def canonical_contexts(value) -> list | None:
    """The contexts of a parsed model in the shape of the typed tables, with every field that these do not have."""
    found = _find_contexts(value)
    if found is None:
        return None
    out = []
    for c in _members(found):
        if not isinstance(c, dict):
            out.append({"context_name": _text(c)} if isinstance(c, str) else {})
            continue
        language = _get(c, "ubiquitous_language")
        within = language if isinstance(language, dict) else {}
        made: dict = {}
        for kind in ITEMS:
            items = _get(within, kind)
            items = _get(c, kind) if items is None else items
            if items is None:
                continue
            made[kind] = [
                _with_others({"name": _text(_get(i, "name")), "description": _text(_get(i, "description")), **{f: _leaf_list(_get(i, f)) for f in LEAVES}}, i, ("name", "description", *LEAVES))
                if isinstance(i, dict)
                else {"name": _text(i)}
                for i in _members(items)
            ]
        events = _get(within, "domain_events")
        made["domain_events"] = _leaf_list(_get(c, "domain_events") if events is None else events)
        made = _with_others(made, within, (*ITEMS, "domain_events"))
        context = {"context_name": _text(_get(c, "context_name")), "description": _text(_get(c, "description")), "allowed_dependencies": _leaf_list(_get(c, "allowed_dependencies")), "ubiquitous_language": made}
        own = ("context_name", "description", "allowed_dependencies", *ITEMS, "domain_events", *(("ubiquitous_language",) if isinstance(language, dict) or language is None else ()))
        out.append(_with_others(context, c, own))
    return out


def canonical_json(df: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """(key, out, paths): each text as JSON in the canonical shape, null where there is no complete model in it; and the
    (path, kind) pairs of its schema, each with one text of a batch only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made, paths, told = [], [], set()
            for t in b[text]:
                try:
                    contexts = canonical_contexts(read_json_text(t, lambda v: _find_contexts(v) is not None))
                except RecursionError:  # nested beyond what any model can be
                    contexts = None
                made.append(None if contexts is None else json.dumps(contexts, ensure_ascii=False))
                found: set = set()
                if contexts is not None:
                    _paths(contexts, "$", found)
                paths.append([f"{k} {p}" for p, k in sorted(found - told)])
                told |= found
            yield pd.DataFrame({key: b[key], out: pd.Series(made, dtype=object, index=b.index), "paths": pd.Series(paths, dtype=object, index=b.index)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, `{out}` string, paths array<string>")


# --- merged schema -----------------------------------------------------------------------------------------------


def merge_types(a: T.DataType | None, b: T.DataType | None) -> T.DataType:
    """The type that holds both: fields of structs are united, unlike scalars become strings."""
    if a is None or isinstance(a, T.NullType):
        return b or T.NullType()
    if b is None or isinstance(b, T.NullType) or a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = list(dict.fromkeys([*a.names, *b.names]))
        return T.StructType([T.StructField(n, merge_types(a[n].dataType if n in a.names else None, b[n].dataType if n in b.names else None)) for n in names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge_types(a.elementType, b.elementType))
    if T.StringType() in (a, b):  # a plain name in place of an object that has one
        one = a if isinstance(a, T.StructType) else b
        if isinstance(one, T.StructType) and "name" in one.names and one["name"].dataType == T.StringType():
            return one
    if isinstance(a, T.MapType) or isinstance(b, T.MapType):
        return T.MapType(T.StringType(), T.StringType())
    return T.StringType()


def _paths(value, at: str, found: set) -> None:
    if isinstance(value, dict):
        found.add((at, "struct"))
        for k, v in value.items():
            _paths(v, f"{at}.{k}", found)
    elif isinstance(value, list):
        found.add((at, "array"))
        for v in value:
            _paths(v, f"{at}.[]", found)
    elif value is not None:
        found.add((at, "boolean" if isinstance(value, bool) else "double" if isinstance(value, float) else "long" if isinstance(value, int) else "string"))
    else:
        found.add((at, "void"))


def _narrow(rows: DataFrame, most_fields: int) -> tuple[DataFrame, list[str]]:
    """rows(path, kind) without what lies below objects of more than most_fields different names, and these objects,
    level by level from the root."""
    wide: list[str] = []
    depth = 1
    while True:
        steps = F.split("path", r"\.")
        below = rows.filter(F.size(steps) > depth).select("path", "kind", F.array_join(F.slice(steps, 1, depth), ".").alias("_at"), F.get(steps, F.lit(depth)).alias("_name"))
        if below.isEmpty():
            return rows, wide
        many = cut(below.groupBy("_at").agg(F.count_distinct("_name").alias("n")).filter(F.col("n") > most_fields).select("_at"), "wide")
        wide += [r["_at"] for r in many.collect()]  # of one level, all below narrow ones
        rows = cut(rows.withColumn("_at", F.array_join(F.slice(steps, 1, depth), ".")).withColumn("_deep", F.size(steps) > depth).join(many.withColumn("_wide", F.lit(True)), "_at", "left").filter("_wide IS NULL OR NOT _deep").select("path", "kind"), "narrow")
        depth += 1


def infer_json_schema(pairs: DataFrame, most_paths: int = 5000, most_fields: int = 200) -> T.DataType:
    """The merged type of canonical JSON from the (path, kind) pairs of all rows.

    There are as many different pairs as the schema has nodes. Where there are more than most_paths, objects whose
    names are data (more than most_fields different ones) become maps from names to JSON text.
    """
    rows, wide = pairs.distinct(), []
    if rows.limit(most_paths + 1).count() > most_paths:
        rows, wide = _narrow(cut(rows, "paths"), most_fields)
    kinds: dict[str, set] = {}
    for r in rows.collect():
        kinds.setdefault(r["path"], set()).add(r["kind"])

    def build(at: str) -> T.DataType:
        made = None
        for kind in sorted(kinds.get(at, ())):
            if kind == "struct" and at in wide:
                one: T.DataType = T.MapType(T.StringType(), T.StringType())
            elif kind == "struct":
                begin = at + "."
                names = sorted({p[len(begin) :].split(".")[0] for p in kinds if p.startswith(begin)} - {"[]"})
                one = T.StructType([T.StructField(n, build(f"{at}.{n}")) for n in names])
            elif kind == "array":
                one = T.ArrayType(build(f"{at}.[]"))
            else:
                one = {"boolean": T.BooleanType(), "double": T.DoubleType(), "long": T.LongType(), "string": T.StringType(), "void": T.NullType()}[kind]
            made = merge_types(made, one)
        return made or T.NullType()

    return build("$")


def without_void(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType) and t.fields:
        return T.StructType([T.StructField(f.name, without_void(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(without_void(t.elementType))
    if isinstance(t, T.StructType) and not t.fields:
        return T.StringType()
    return T.StringType() if isinstance(t, T.NullType) else t


def as_type(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """c with the fields of want, in its order; missing ones are null."""
    if have == want:
        return c
    if isinstance(want, T.StructType):
        if isinstance(have, T.StringType) and "name" in want.names:
            return F.when(c.isNotNull(), F.struct(*[(c if f.name == "name" else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]))
        if not isinstance(have, T.StructType):
            return F.lit(None).cast(want)
        made = F.struct(*[(as_type(c[f.name], have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])
        return F.when(c.isNotNull(), made)
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: as_type(x, have.elementType, want.elementType))
    return c.cast(want)


# --- flattening --------------------------------------------------------------------------------------------------


def flatten(df: DataFrame, root: str, column: str, delivery: str | None = None) -> dict[str, DataFrame]:
    """Child tables of the nested column, by path of field names joined with '.'.

    Each has root, parent_key, row_key (surrogate keys: the root's value and the ordinals on the way, joined
    with '/'), ords (the ordinals from the outermost in), value (a scalar member) or the member's scalar fields as
    f_<field>. Structs between arrays do not make a level of their own; their scalar fields are named with '_'.
    Null and empty lists give no rows, null members give a row with null fields; a map is a list of its keys and values.
    Nothing is dropped or reordered. delivery is a column that tells the rows of one root apart; it becomes part of the
    keys, so that they stay unique. df needs no other columns; root may be null and then has an empty key.
    """
    out: dict[str, DataFrame] = {}

    def scalars(c: Column, t: T.DataType, prefix: str) -> tuple[list[Column], list[tuple[str, Column, T.ArrayType]]]:
        flat, lists = [], []
        for f in t.fields:
            name = f"{prefix}{f.name}"
            if isinstance(f.dataType, T.StructType):
                a, b = scalars(c[f.name], f.dataType, f"{name}_")
                flat, lists = flat + a, lists + b
            elif isinstance(f.dataType, T.ArrayType):
                lists.append((name, c[f.name], f.dataType))
            elif isinstance(f.dataType, T.MapType):
                entry = T.StructType([T.StructField("key", f.dataType.keyType), T.StructField("value", f.dataType.valueType)])
                lists.append((name, F.map_entries(c[f.name]), T.ArrayType(entry)))
            else:
                flat.append(c[f.name].alias(f"f_{name}"))
        return flat, lists

    def level(rows: DataFrame, source: Column, kind: T.ArrayType, path: str) -> None:
        made = rows.select("_root", F.col("_key").alias("_parent"), F.col("_ords").alias("_up"), F.posexplode(source).alias("_pos", "_item"))
        made = made.select("_root", "_parent", F.concat(F.coalesce("_parent", F.lit("")), F.lit(f"/{path.rpartition('.')[2]}:"), F.col("_pos").cast("string")).alias("_key"), F.concat("_up", F.array("_pos")).alias("_ords"), "_item")
        item, lists = kind.elementType, []
        if isinstance(item, T.StructType):
            flat, lists = scalars(F.col("_item"), item, "")
        elif isinstance(item, T.ArrayType):
            flat, lists = [], [("list", F.col("_item"), item)]
        else:
            flat = [F.col("_item").alias("value")]
        out[path] = made.select(F.col("_root").alias(root), F.col("_parent").alias("parent_key"), F.col("_key").alias("row_key"), F.col("_ords").alias("ords"), *flat)
        for name, c, t in lists:
            level(made, c, t, f"{path}.{name}")

    own = F.coalesce(F.col(root).cast("string"), F.lit(""))
    own = F.concat_ws("#", own, F.col(delivery).cast("string")) if delivery else own
    start = df.select(F.col(root).alias("_root"), own.alias("_key"), F.array().cast("array<int>").alias("_ords"), F.col(column).alias("_col"))
    level(start, F.col("_col"), df.schema[column].dataType, column)
    return out


def all_models(models: DataFrame, payloads: DataFrame) -> DataFrame:
    """(model_id, delivery, bounded_contexts) of the typed table and of the payloads under one merged schema.

    Repeated deliveries of a model with the same content count once; deliveries of different content are told apart by a
    hash of it. Payloads that are null, blank or incomplete give no row; a null list of contexts stays null. Fields
    of payloads that the typed table does not have are kept in the struct other of their level.
    """
    content = lambda c: F.lower(F.hex(F.xxhash64(c))).alias("delivery")
    typed = models.select("model_id", "bounded_contexts").distinct()
    # written once: the texts are parsed in Python, and the tables below read only the nested columns they need
    text = cut(canonical_json(payloads.select("model_id", "payload").distinct(), "model_id", "payload", "canonical").filter("canonical IS NOT NULL"), "payloads")
    pair = F.split("p", " ")
    pairs = text.select(F.explode("paths").alias("p")).select(pair[1].alias("path"), pair[0].alias("kind"))
    have = models.schema["bounded_contexts"].dataType
    merged = without_void(merge_types(have, infer_json_schema(pairs)))
    both = typed.select("model_id", content("bounded_contexts"), as_type(F.col("bounded_contexts"), have, merged).alias("bounded_contexts"))
    parsed = text.select("model_id", "canonical").distinct().select("model_id", content("canonical"), F.from_json("canonical", merged).alias("bounded_contexts"))
    return cut(both.unionByName(parsed), "models")


def model_tables(models: DataFrame, payloads: DataFrame) -> dict[str, DataFrame]:
    """All flat tables of all models: contexts, their dependencies, items, events, leaves and what else payloads have."""
    return flatten(all_models(models, payloads), "model_id", "bounded_contexts", "delivery")


def broken_links(tables: dict[str, DataFrame]) -> DataFrame:
    """One row over all child tables: rows whose parent_key no row of the parent table has, rows with more than one
    parent, and keys that more than one row of a table has."""
    rows = reduce(DataFrame.unionByName, [t.select(F.lit(path).alias("_in"), F.lit(path.rpartition(".")[0]).alias("_of"), "parent_key", "row_key") for path, t in tables.items()])
    keys = rows.groupBy("_in", "row_key").agg(F.count("*").alias("n"))
    asked = rows.filter("_of <> ''").groupBy("_of", "parent_key").agg(F.count("*").alias("children"))
    met = asked.join(keys.select(F.col("_in").alias("_of"), F.col("row_key").alias("parent_key"), "n"), ["_of", "parent_key"], "left")
    none = F.lit(0).cast("bigint")
    parts = met.select(F.when(F.col("n").isNull(), F.col("children")).alias("n_without_parent"), F.when(F.col("n") > 1, F.col("children")).alias("n_with_several"), none.alias("n_repeated_keys"))
    parts = parts.unionByName(keys.select(none.alias("n_without_parent"), none.alias("n_with_several"), (F.col("n") > 1).cast("bigint").alias("n_repeated_keys")))
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns])


def model_leaves(tables: dict[str, DataFrame]) -> DataFrame:
    """Synonyms and attributes with the numbers of their context, item and self; blank leaves are left out."""
    from marlstone.functions.strings import is_blank

    parts = []
    for items, kind in (("entities", "entity"), ("value_objects", "value_object")):
        for leaves, leaf in (("synonyms_to_avoid", "synonym"), ("attributes", "attribute")):
            t = tables.get(f"bounded_contexts.ubiquitous_language_{items}.{leaves}")
            if t is not None:
                value = F.col("f_name" if "f_name" in t.columns else "value")
                parts.append(
                    t.filter(~is_blank(value)).select(
                        "model_id", F.col("ords")[0].alias("context_no"), F.lit(kind).alias("item_kind"), F.col("ords")[1].alias("item_no"), F.lit(leaf).alias("leaf_kind"), F.col("ords")[2].alias("leaf_no"), value.alias("leaf")
                    )
                )
    return reduce(DataFrame.unionByName, parts).distinct()
