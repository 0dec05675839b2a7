"""Domain models from documents in stages, with an injected model call, and the clean-up of what it answers.

Calls go through a seam: a function of a list of prompts that returns a list of answers. The default is offline and
takes the deterministic fallback of each stage.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.strings import strip
from marlstone.operators.chunking import sentence_windows
from marlstone.schemas import MODEL

# --- fixed values: limits and fallbacks of the stages ---
TRIES, LEAST_DELAY, LEAST_SENTENCE, MOST_SENTENCES = 5, 6.0, 20, 50
FIRST_WAIT, LEAST_WAIT, MOST_WAIT, FINISHED = 15.0, 10.0, 300.0, "STOP"
CONTEXT_CAP, SPECIALIST_CAP, FIRST_CAP = 50_000, 60_000, 1000
DEFAULT_CONTEXT = "CoreDomain"
FALLBACK = {
    "project_name": "Generated Domain Model",
    "project_metadata": {"version": "1.0", "generated_at": None, "description": "Auto-generated domain model from SRS document"},
    "bounded_contexts": [],
    "global_rules": {"naming_convention": "PascalCase", "banned_global_terms": ["Manager", "Util", "Helper"]},
}
# --- end of fixed values ---

Caller = Callable[[list[str]], list[str]]


def sentences(text: Column, least: int = LEAST_SENTENCE, most: int = MOST_SENTENCES) -> Column:
    """The fallback of the first stage: stripped parts between full stops of more than least characters, most at most."""
    return F.slice(F.filter(F.transform(F.split(text, r"\."), strip), lambda s: F.length(s) > least), 1, most)


def backoff(message: Column, retry: Column) -> Column:
    """Seconds to wait after an error: what a quota error asks for, 10 at least; else 15 doubled each time, 300 at
    most; 0 for other errors."""
    quota = F.contains(message, F.lit("429")) | F.contains(F.lower(message), F.lit("quota"))
    asked = F.nullif(F.regexp_extract(message, r"retry in (\d+\.?\d*)", 1), F.lit("")).cast("double")
    wait = F.when(asked.isNotNull(), F.greatest(asked, F.lit(LEAST_WAIT))).otherwise(F.least(F.lit(FIRST_WAIT) * F.pow(F.lit(2.0), retry), F.lit(MOST_WAIT)))
    return F.when(quota, wait).otherwise(F.lit(0.0))


def complete(finish_reason: Column) -> Column:
    """Whether an answer was finished; no reason means no answer."""
    return F.coalesce(finish_reason == FINISHED, F.lit(False))


def lenient_json(text: Column) -> Column:
    """struct(json, error, raw): the text if it is JSON, else without code fences, else an error and 500 characters."""
    bare = strip(F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    found = F.coalesce(valid(text), valid(bare))
    return F.struct(found.alias("json"), F.when(found.isNull(), F.lit("json_parse_failed")).alias("error"), F.when(found.isNull(), F.left(text, F.lit(500))).alias("raw"))


def normalise(value) -> dict | None:
    """A parsed model with its optional fields filled in; None if a required field is missing or has another shape."""
    if not isinstance(value, dict) or not {"project_name", "project_metadata", "bounded_contexts"} <= set(value):
        return None
    out = dict(value)
    out.setdefault("global_rules", {"naming_convention": "PascalCase", "banned_global_terms": []})
    if not isinstance(out["bounded_contexts"], list):
        return None
    contexts = []
    for c in out["bounded_contexts"]:
        if not isinstance(c, dict) or not isinstance(c.get("context_name"), str):
            return None
        language = c.get("ubiquitous_language")
        language = {} if language is None else language
        if not isinstance(language, dict):
            return None
        entities, values, events = (language.get(k) for k in ("entities", "value_objects", "domain_events"))
        if not isinstance(entities, list) or not isinstance(values, list):  # both are required
            return None
        if any(not isinstance(x, dict) or not isinstance(x.get("name"), str) for x in [*entities, *values]):
            return None
        names = [e["name"] if isinstance(e, dict) else e for e in events or [] if isinstance(e, str) or (isinstance(e, dict) and "name" in e)] if isinstance(events, list) else events
        contexts.append({**c, "allowed_dependencies": c.get("allowed_dependencies"), "ubiquitous_language": {"entities": [{**e, "synonyms_to_avoid": e.get("synonyms_to_avoid")} for e in entities], "value_objects": [{**v, "attributes": v.get("attributes", [])} for v in values], "domain_events": names}})
    return {**out, "bounded_contexts": contexts}


def _usable(value) -> bool:
    """Whether a model has the schema's types."""
    text = lambda x: x is None or isinstance(x, str)
    texts = lambda x: x is None or (isinstance(x, list) and all(isinstance(i, str) for i in x))
    rules, meta = value.get("global_rules"), value.get("project_metadata")
    if not isinstance(value["project_name"], str) or not isinstance(meta, dict) or not all(text(v) for v in meta.values()):
        return False
    if rules is not None and not (isinstance(rules, dict) and text(rules.get("naming_convention")) and texts(rules.get("banned_global_terms"))):
        return False
    return all(
        text(c.get("description")) and texts(c["allowed_dependencies"]) and texts(c["ubiquitous_language"]["domain_events"]) and all(texts(e["synonyms_to_avoid"]) for e in c["ubiquitous_language"]["entities"]) and all(isinstance(v["attributes"], list) and texts(v["attributes"]) for v in c["ubiquitous_language"]["value_objects"])
        for c in value["bounded_contexts"]
    )


def model_or_fallback(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, model, is_fallback): each answer as a model of the schema, or the minimal model if it cannot be one."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                made = None
                for s in (t, (t or "").replace("```json", "").replace("```", "").strip()):
                    try:
                        made = normalise(json.loads(s)) if s else None
                        break
                    except (ValueError, RecursionError):
                        continue
                good = made is not None and _usable(made)
                out.append((k, json.dumps(made if good else FALLBACK, ensure_ascii=False), not good))
            yield pd.DataFrame(out, columns=[key, "_m", "is_fallback"])

    made = df.select(key, text).mapInPandas(run, f"`{key}` {kind}, _m string, is_fallback boolean")
    return made.select(key, F.from_json("_m", MODEL).alias("model"), "is_fallback")


QUOTA, ASKED = ("429", "quota"), r"retry in (\d+\.?\d*)"


def seconds_to_wait(message: str, retry: int) -> float:
    """What backoff gives for one message, for a worker that has it at hand."""
    if not any(q in message.lower() for q in QUOTA):
        return 0.0
    asked = re.search(ASKED, message)
    return max(float(asked[1]), LEAST_WAIT) if asked else min(FIRST_WAIT * 2.0**retry, MOST_WAIT)


def call_model(prompts: DataFrame, key: str, prompt: str, caller: Caller, delay: float = LEAST_DELAY, tries: int = TRIES, partitions: int = 1) -> DataFrame:
    """(key, answer, finish_reason): each prompt's answer, null after the last try. A caller gives answers, or (answer,
    finish reason) pairs: one that was not finished is asked for again, and after the last try it is taken as it is.
    Calls of a partition are delay seconds apart; the number of partitions is the number of callers at a time."""
    kind = prompts.schema[key].dataType.simpleString()

    def ask(text: str, pause: Callable[[], None]) -> tuple[str | None, str | None]:
        answer = reason = None
        for retry in range(tries):
            pause()
            try:
                got = caller([text])[0]
            except Exception as e:
                time.sleep(seconds_to_wait(str(e), retry) if delay else 0)
                continue
            answer, reason = got if isinstance(got, tuple) else (got, FINISHED)
            if reason == FINISHED:
                break
        return answer, reason

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0

        def pause() -> None:
            nonlocal last
            wait = delay - (time.monotonic() - last)
            if last and wait > 0:
                time.sleep(wait)
            last = time.monotonic()

        for b in batches:
            made = [ask(p, pause) for p in b[prompt]]
            yield pd.DataFrame({key: b[key].to_numpy(), "answer": pd.Series([a for a, _ in made], dtype=object).to_numpy(), "finish_reason": pd.Series([r for _, r in made], dtype=object).to_numpy()})

    return prompts.select(key, prompt).coalesce(partitions).mapInPandas(run, f"`{key}` {kind}, answer string, finish_reason string")


def scout(df: DataFrame, key: str, text: str, caller: Caller | None = None) -> DataFrame:
    """(key, no, sentence): the sentences of each window in order; a document without any gives its first 1000
    characters. Without a caller, or where an answer is no list, the fallback sentences of the window."""
    windows = sentence_windows(df, key, text)
    if caller is None:
        made = windows.select(key, "window_no", F.col("window"), sentences(F.col("window")).alias("s"))
    else:
        rows = windows.withColumn("_k", F.struct(key, "window_no")).withColumn("_k", F.to_json("_k"))
        answers = call_model(rows, "_k", "window", caller).withColumn("_s", F.coalesce(F.from_json("answer", "sentences array<string>")["sentences"], F.from_json("answer", "array<string>")))
        made = rows.join(answers, "_k", "left").select(key, "window_no", "window", F.coalesce("_s", sentences(F.col("window"))).alias("s"))
    listed = made.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("window_no", "s"))), lambda w: w["s"])).alias("s"), F.min_by("window", "window_no").alias("w"))
    kept = F.when(F.size("s") > 0, F.col("s")).otherwise(F.array(F.left("w", F.lit(FIRST_CAP))))
    return listed.select(key, F.posexplode(kept).alias("no", "sentence"))


def _capped(text: Column, most: int | None) -> Column:
    return text if most is None else F.left(text, F.lit(most))


def identify_contexts(found: DataFrame, key: str, caller: Caller | None = None, most_chars: int | None = CONTEXT_CAP) -> DataFrame:
    """(key, contexts): the contexts of a document's sentences, cut at most_chars as one prompt must be (None: whole);
    the default without an answer."""
    joined = found.groupBy(key).agg(_capped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "sentence"))), lambda s: s["sentence"]), "\n"), most_chars).alias("prompt"))
    default = F.array(F.lit(DEFAULT_CONTEXT))
    if caller is None:
        return joined.select(key, default.alias("contexts"))
    answers = call_model(joined, key, "prompt", caller)
    named = F.coalesce(F.from_json("answer", "contexts array<string>")["contexts"], F.from_json("answer", "array<string>"))
    return answers.select(key, F.when(F.size(named) > 0, named).otherwise(default).alias("contexts"))


def analyse(contexts: DataFrame, found: DataFrame, key: str, caller: Caller | None = None, most_chars: int | None = SPECIALIST_CAP) -> DataFrame:
    """(key, context, analysis): one call for all contexts of a document, its sentences cut at most_chars (None:
    whole); an empty analysis for a context without an answer."""
    joined = found.groupBy(key).agg(_capped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "sentence"))), lambda s: s["sentence"]), "\n"), most_chars).alias("text"))
    each = contexts.select(key, F.explode("contexts").alias("context"))
    if caller is None:
        return each.withColumn("analysis", F.lit("{}"))
    prompts = contexts.join(joined, key).select(key, F.concat(F.to_json("contexts"), F.lit("\n"), "text").alias("prompt"))
    answers = call_model(prompts, key, "prompt", caller).select(key, F.explode(F.from_json("answer", "analyses array<struct<context:string,analysis:string>>")["analyses"]).alias("a")).select(key, "a.*")
    return each.join(answers, [key, "context"], "left").withColumn("analysis", F.coalesce("analysis", F.lit("{}")))


def synthesise(analyses: DataFrame, key: str, caller: Caller | None = None) -> DataFrame:
    """(key, model, is_fallback): the final model of each document's analyses."""
    prompts = analyses.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct("context", "analysis")))).alias("prompt"))
    answers = prompts.select(key, F.lit(None).cast("string").alias("answer")) if caller is None else call_model(prompts, key, "prompt", caller)
    return model_or_fallback(answers, key, "answer")
