import json
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.sources import files, store
from marlstone.streaming import logs


def docx(path, paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')


def test_documents(spark, tmp_path):
    (tmp_path / "b.TXT").write_text("héllo\nx", encoding="utf-8")
    docx(tmp_path / "a.docx", ["one", "two"])
    (tmp_path / "c.bin").write_bytes(b"\xff")
    assert [r["kind"] for r in files.list_documents(spark, str(tmp_path)).collect()] == ["docx", "txt"]
    got = {r["doc_name"]: (r["text"], r["error"] is None) for r in files.read_documents(spark, str(tmp_path), strict=False).collect()}
    assert got["b.TXT"] == ("héllo\nx", True) and got["a.docx"] == ("one\ntwo", True) and got["c.bin"] == (None, False)
    with pytest.raises(Exception):
        files.read_documents(spark, str(tmp_path)).collect()
    assert files.read_texts(spark, str(tmp_path / "b.TXT")).first()["text"] == "héllo\nx"


def test_json_and_code(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"test_cases": [{"id": 1, "violation_type": "v", "message": "m", "expected_section": "3.1"}]}))
    assert files.read_tests(spark, str(tmp_path / "t.json")).first()["expected_section"] == "3.1"
    (tmp_path / "m.json").write_text(json.dumps({"project_name": "P", "bounded_contexts": [{"context_name": "C", "allowed_dependencies": None}]}, indent=1))
    assert files.read_model(spark, str(tmp_path / "m.json")).first()["bounded_contexts"][0]["context_name"] == "C"
    (tmp_path / "r.json").write_text(json.dumps({"call_history": [{"timestamp": "t", "stage": "s", "operation": "o", "prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}]}))
    assert files.read_calls(spark, str(tmp_path / "r.json")).first()["total_tokens"] == 3
    (tmp_path / "v.json").write_text(json.dumps({"validation_history": [{"timestamp": "t", "violation_types": ["a", "b"], "has_sources": False}]}))
    assert files.read_validations(spark, str(tmp_path / "v.json")).first()["violation_types"] == ["a", "b"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.py").write_text("a = 1")
    assert [(r["filename"], r["content"]) for r in files.read_code(spark, str(tmp_path)).collect()] == [("x.py", "a = 1")]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.py").write_text("b = 2")
    assert len({r["path"] for r in files.read_code(spark, str(tmp_path)).collect()}) == 2
    q = files.stream_code(spark, str(tmp_path)).writeStream.format("memory").queryName("saved").start()
    q.processAllAvailable()
    q.stop()
    assert {r["content"] for r in spark.table("saved").collect()} == {"a = 1", "b = 2"}
    (tmp_path / "20260115_171759_1_scout.json").write_text('{"stage": 1}')
    (tmp_path / "20260115_171759_3_specialist.json").write_text('[\n]')
    stages = files.read_stages(spark, str(tmp_path)).orderBy("stage_no").collect()
    assert [(r["stage_no"], r["stage"], r["snapshot"]) for r in stages] == [(1, "scout", '{"stage": 1}'), (3, "specialist", "[\n]")]


def test_chunk_store(spark, tmp_path):
    s = store.ChunkStore(spark, f"{tmp_path}/index", buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id string, id string, text string")
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "doc_id string")
    assert s.count() == 0
    s.index(rows(("a", "a0", "x"), ("b", "b0", "y")), ids("a", "b"))
    for _ in range(2):  # again changes nothing
        s.index(rows(("a", "a0", "new"), ("a", "a1", "z")), ids("a"))
    assert sorted((r["id"], r["text"]) for r in s.read().collect()) == [("a0", "new"), ("a1", "z"), ("b0", "y")]
    s.index(rows(), ids("b"))  # a document that has become empty is deleted
    assert sorted(r["id"] for r in s.read().collect()) == ["a0", "a1"] and s.metadata_fields() == ["doc_id"]


def test_reports(spark, tmp_path):
    store.write_report(spark.createDataFrame([('{"a": 1}',)], "report string"), f"{tmp_path}/x/report")
    assert spark.read.text(f"{tmp_path}/x/report").first()[0] == '{"a": 1}'
    store.write_json(spark.range(2), f"{tmp_path}/y")
    assert spark.read.json(f"{tmp_path}/y").count() == 2
    df = spark.createDataFrame([("2025-01-01",), ("2025-02-01",)], "timestamp string")
    assert store.since(df, "2025-01-15").count() == 1


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(1, "click", 2.0), (2, "view", 3.0), (3, "click", 1.0)], "n int, event_type string, value double").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,n,0,0)"))
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = logs.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() == 3
    v = stream.select(F.col("event_type").alias("filename"), F.array("event_type").alias("violation_types"), F.lit(1).cast("bigint").alias("violations_count"), F.col("value").alias("validation_time_ms"), F.lit(4).cast("bigint").alias("file_size_chars"), F.lit(1).cast("bigint").alias("code_file_tokens"), F.lit(True).alias("has_sources"))
    q = logs.histogram(v).writeStream.format("memory").queryName("h").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r[0], r[1]) for r in spark.table("h").collect()} == {("click", 2), ("view", 1)}
    logs.report_each_batch(v, f"{tmp_path}/log", f"{tmp_path}/report", f"{tmp_path}/cp").awaitTermination()
    assert json.loads(spark.read.text(f"{tmp_path}/report").first()[0])["summary"]["total_validations"] == 3
