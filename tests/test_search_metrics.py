import json
import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import metrics, retrieval, synthesis, vector


def test_knn_is_exact_with_ties(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, (300, 4)).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "item_id bigint, embedding array<float>").repartition(5)
    got = vector.knn(df.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), df, 7, block=2).collect()
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    for q in range(0, 300, 50):
        mine = sorted((r["rank"], r["item_id"], r["score"]) for r in got if r["query_id"] == q)
        scores = u @ u[q]
        assert len(mine) == 7 and np.allclose([m[2] for m in mine], np.sort(scores)[::-1][:7])
    assert vector.knn(df.filter("false").withColumnRenamed("item_id", "query_id"), df, 3).count() == 0
    q = df.filter("item_id % 10 = 0").withColumnRenamed("item_id", "query_id")
    both = [sorted((r["query_id"], r["rank"], r["item_id"]) for r in vector.knn(q, df, 3, most_sent=n).collect()) for n in (1 << 16, 12)]
    assert both[0] == both[1] and len(both[0]) == 90


def test_cell_index_recall(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item_id bigint, embedding array<float>")
    q = df.filter("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    assert vector.recall(vector.CellIndex(df, cells=12).search(q, 5, probes=8), vector.knn(q, df, 5)).first()["recall"] >= 0.9


def of(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


def test_query_and_summary(spark):
    assert of(spark, "Class 'A' uses \"B\"", retrieval.query_text) == "A B Class 'A' uses \"B\""
    assert of(spark, "none here", retrieval.query_text) == "none here"
    for t, want in [("H\n\nImportant: Use X. More.", "Use X"), ("H\n\nIt must NOT leak. End.", "It must NOT leak"), ("H\n\nshort", "Source reference"), ("H\n\n- a list line that is long enough\nA plain line that is long enough", "A plain line that is long enough"), (None, None)]:
        assert of(spark, t, retrieval.summary) == want


def test_section_match(spark):
    cases = [("3.1 Name", "3.1", True), ("3.1 Name", "3", True), ("3.1 Name", "3.11", False), ("4. Deps", "4", True), ("", "4", False)]
    df = spark.createDataFrame(cases, "a string, b string, w boolean")
    assert all(r["w"] == r["m"] for r in df.withColumn("m", retrieval.section_match(F.col("a"), F.col("b"))).collect())


def test_search_and_attach(spark):
    index = spark.createDataFrame([(1, "red apple tree", "d1", "A", 1, "p"), (2, "blue car", "d2", "B", 1, "p"), (3, None, "d3", "C", 1, "p")], "item_id bigint, text string, doc_name string, section_name string, page_number int, file_path string")
    index = vector.embed(index, "text")
    asked = spark.createDataFrame([(10, "apple tree"), (11, "car")], "query_id bigint, query string")
    found = retrieval.sources(retrieval.search(asked, index, 0))
    top = {r["query_id"]: r["document"] for r in found.filter("rank = 1").collect()}
    assert top == {10: "d1", 11: "d2"}
    assert {r["document"] for r in retrieval.sources(retrieval.search(asked, index, 5, where=F.col("doc_name") == "d2")).collect()} == {"d2"}
    made = {r["query_id"]: len(r["sources"]) for r in retrieval.attach(spark.createDataFrame([(10,), (12,)], "query_id bigint"), found).collect()}
    assert made == {10: 3, 12: 0}
    r = spark.createDataFrame([(1, 1, "3.1 X", "3", 0.5, 10.0), (1, 2, "4 Y", "3", 0.4, 10.0), (2, 1, "4 Y", "3", 0.3, 20.0), (2, 3, "3 Z", "3", 0.2, 20.0)], "test_id int, rank int, retrieved_section string, expected_section string, relevance double, time_ms double")
    e = retrieval.evaluate(r).first()
    assert (e["total"], e["top1_correct"], e["top3_correct"], e["top1_accuracy_pct"], e["avg_time_ms"]) == (2, 1, 2, 50.0, 15.0)


CALLS = [("t1", "Scout", "a", 635, 359, 0), ("t2", "Architect", "b", 374, 66, 0), ("t3", "Specialist", "c", 463, 5276, 0), ("t4", "Synthesizer", "d", 5769, 6579, 0)]


def test_golden_usage(spark):
    calls = metrics.normalised_calls(spark.createDataFrame(CALLS, "timestamp string, stage string, operation string, prompt_tokens bigint, completion_tokens bigint, cached_tokens bigint"))
    t = metrics.totals(calls).first()
    assert (t["total_api_calls"], t["total_prompt_tokens"], t["total_completion_tokens"], t["total_tokens"]) == (4, 7241, 12280, 19521) and float(t["total_cost"]) == 0.032872
    stages = {r["stage"]: float(r["estimated_cost"]) for r in metrics.usage(calls).filter("is_total = 0").collect()}
    assert stages == {"Scout": 0.001088, "Architect": 0.000277, "Specialist": 0.013329, "Synthesizer": 0.018178}
    assert json.loads(metrics.usage_report(calls).first()["report"])["summary"]["total_tokens"] == 19521 and metrics.history(calls, metrics.CALL_FIELDS).count() == 4
    assert metrics.totals(calls.filter("false")).first()["total_tokens"] == 0
    cost = spark.range(1).select(metrics.cost(F.lit(7000), F.lit(5000), F.lit(3000)).alias("c"), metrics.cost(F.lit(10000), F.lit(5000)).alias("d")).first()
    assert (float(cost["c"]), float(cost["d"])) == (0.01469, 0.0155)
    cached = metrics.normalised_calls(spark.createDataFrame([("t", "s", "o", 10, None, 4)], "timestamp string, stage string, operation string, prompt_tokens bigint, completion_tokens bigint, cached_tokens bigint")).first()
    assert (cached["prompt_tokens"], cached["total_tokens"]) == (6, 6)


def test_validations(spark):
    files = spark.createDataFrame([("a", [("X",), (None,)]), ("b", []), ("c", [("SyntaxError",)]), ("d", None)], "filename string, violations array<struct<type:string>>")
    v = metrics.recorded(files).withColumns({"validation_time_ms": F.lit(3.0), "file_size_chars": F.lit(8).cast("bigint"), "code_file_tokens": F.lit(2).cast("bigint"), "has_sources": F.lit(False), "timestamp": F.lit("t")})
    s = metrics.validation_summary(v).first()
    assert (s["total_validations"], s["files_with_violations"], s["total_violations_found"], s["violation_rate_percent"]) == (3, 1, 2, 33.33)
    assert {(r[0], r[1]) for r in metrics.type_histogram(v).collect()} == {("X", 1), ("Unknown", 1)}
    assert metrics.validation_summary(v.filter("false")).first()["violation_rate_percent"] == 0
    assert json.loads(metrics.validation_report(v).first()["report"])["violation_breakdown"] == {"Unknown": 1, "X": 1} and metrics.history(v, metrics.VALIDATION_FIELDS).count() == 3
    c = metrics.combined(metrics.normalised_calls(spark.createDataFrame([("t", "s", "o", 30, 10)], "timestamp string, stage string, operation string, prompt_tokens bigint, completion_tokens bigint")), v.filter("false")).first()
    assert c["avg_tokens_per_validation"] is None


def test_lenient_json_and_fallback(spark):
    good = '{"project_name": "P", "project_metadata": {"version": "1"}, "bounded_contexts": [{"context_name": "C", "ubiquitous_language": {"entities": [{"name": "E"}], "value_objects": [{"name": "V"}], "domain_events": [{"name": "X"}, 5, "Y"]}}]}'
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, "{"), (4, None), (5, good.replace('"value_objects": [{"name": "V"}], ', "")), (6, good.replace('[{"name": "V"}]', "null"))]
    df = spark.createDataFrame(rows, "id int, t string")
    made = {r["id"]: r for r in synthesis.model_or_fallback(df, "id", "t").collect()}
    assert {i: r["is_fallback"] for i, r in made.items()} == {1: False, 2: False, 3: True, 4: True, 5: True, 6: True}
    c = made[1]["model"]["bounded_contexts"][0]["ubiquitous_language"]
    assert c["domain_events"] == ["X", "Y"] and c["value_objects"][0]["attributes"] == [] and made[3]["model"]["global_rules"]["banned_global_terms"] == ["Manager", "Util", "Helper"]
    errors = {r["id"]: r["j"]["error"] for r in df.select("id", synthesis.lenient_json(F.col("t")).alias("j")).collect()}
    assert errors[1] is None and errors[2] is None and errors[3] == "json_parse_failed"


def test_stages_with_a_caller(spark):
    def caller(prompts):
        return ['{"sentences": ["S1", "S2"]}' if "Doc" in p else '{"contexts": ["K"]}' for p in prompts]

    docs = spark.createDataFrame([(1, "Doc one. It is a long enough sentence.")], "doc_id bigint, text string")
    quick = lambda p, k, c, f: synthesis.call_model(p, k, c, f, delay=0)
    assert quick(docs, "doc_id", "text", caller).first()["answer"].startswith('{"sentences"')
    found = synthesis.scout(docs, "doc_id", "text", caller)
    assert [r["sentence"] for r in found.orderBy("no").collect()] == ["S1", "S2"]
    assert synthesis.identify_contexts(found, "doc_id", caller).first()["contexts"] == ["K"]

    def broken(prompts):
        raise ValueError("down")

    assert quick(docs, "doc_id", "text", broken).first()["answer"] is None
    # answers that are not finished are asked for again; the last one is taken as it is
    def cut_off(prompts, left=[2]):  # noqa: B006
        left[0] -= 1
        return [("part", "MAX_TOKENS") if left[0] >= 0 else ("whole", "STOP")]

    assert [tuple(r)[1:] for r in quick(docs, "doc_id", "text", cut_off).collect()] == [("whole", "STOP")]
    assert [tuple(r)[1:] for r in quick(docs, "doc_id", "text", lambda p: [("part", "MAX_TOKENS")]).collect()] == [("part", "MAX_TOKENS")]
    for m, r in (("429 retry in 12.5", 0), ("Quota", 1), ("quota", 9), ("other", 0), ("429 retry in 3", 2)):
        row = spark.createDataFrame([(m, r)], "m string, r int").select(synthesis.backoff(F.col("m"), F.col("r")).alias("w")).first()
        assert row["w"] == synthesis.seconds_to_wait(m, r)
    long = spark.createDataFrame([(1, 0, "x" * 60_000)], "doc_id bigint, no int, sentence string")
    seen = lambda p: ['{"contexts": ["%d"]}' % len(p[0])]
    assert [synthesis.identify_contexts(long, "doc_id", seen, n).first()["contexts"] for n in (50_000, None)] == [["50000"], ["60000"]]
    assert synthesis.scout(docs.select("doc_id", F.lit("x. y").alias("text")), "doc_id", "text").first()["sentence"] == "x. y"
    assert synthesis.identify_contexts(found, "doc_id").first()["contexts"] == ["CoreDomain"]
    wait = spark.createDataFrame([("429 retry in 12.5", 0), ("quota", 1), ("other", 0)], "m string, r int").select(synthesis.backoff(F.col("m"), F.col("r")).alias("w"))
    assert [r["w"] for r in wait.collect()] == [12.5, 30.0, 0.0]
    done = spark.createDataFrame([("STOP",), ("MAX_TOKENS",), (None,)], "f string").select(synthesis.complete(F.col("f")).alias("c"))
    assert [r["c"] for r in done.collect()] == [True, False, False]


def test_history_and_running_sums(spark):
    log = spark.createDataFrame([("2025-01-01 10:00:00", "s", 1, None), ("2025-01-02 10:00:00", "s", 2, 3.5)], "timestamp string, stage string, id int, value double")
    assert [json.loads(r[0]) for r in metrics.history(log, metrics.CALL_FIELDS).collect()] == [{"timestamp": f"2025-01-0{i} 10:00:00", "stage": "s"} for i in (1, 2)]
    rows = metrics.running(log.withColumn("t", F.col("timestamp").cast("timestamp")), ["stage"], ["t", "id"], "value").orderBy("id").collect()
    assert [(r["running_n"], r["running_sum"], r["running_avg"]) for r in rows] == [(0, None, None), (1, 3.5, 3.5)]
