import json

from pyspark.sql import functions as F

from foliora.cli import main
from foliora.operators import document as D
from foliora.plans.pipeline import extract
from foliora.sources.files import known_names

SCHEMA = "doc_id string, page int, region_id int, script string, confidence double, text string"
ROWS = [("d", 2, 1, "latin", 0.9, "Take 500mg aspirin"), ("d", 1, 1, "arabic", 0.5, "٥٠٠ مجم"), ("d", 1, 2, "mixed", None, "x"), ("d", 3, 1, None, 0.1, None)]


def test_assemble(spark):
    r = D.assemble(spark.createDataFrame(ROWS, SCHEMA)).first()
    assert r["pages_processed"] == 3 and r["full_text_arabic"] == "500 mg\n\nx" and r["full_text_english"] == "x\n\nTake 500 mg aspirin"
    assert [f["region_id"] for f in r["flagged"]] == [1] and len(r["strengths"]) == 2
    assert D.assemble(spark.createDataFrame([], SCHEMA)).count() == 0


def test_export_and_files(spark, tmp_path):
    out = extract(spark, spark.createDataFrame(ROWS, SCHEMA), known_names(spark))
    D.write_documents(out, str(tmp_path))
    doc = json.loads((tmp_path / "d_ocr.json").read_text())
    assert doc["drug_info"]["inn"] == "aspirin" and doc["drug_info"]["strength"] == "500 mg" and doc["ocr_metadata"]["requires_manual_review"]
    assert "## Detected Strengths" in (tmp_path / "d_ocr.md").read_text()


def test_layout(spark):
    df = spark.createDataFrame([(101, 50, "mixed"), (101, 50, "arabic"), (101, 50, None)], "w int, h int, script string")
    rows = df.select(D.split_layout(F.col("w"), F.col("h"), F.col("script")).alias("r")).collect()
    assert [(r["x"], r["w"], r["direction"]) for r in rows[0]["r"]] == [(0, 50, "ltr"), (50, 51, "rtl")] and rows[1]["r"][0]["direction"] == "rtl" and len(rows[2]["r"]) == 2


def test_jobs(spark):
    jobs = spark.createDataFrame([("a", 1, None), ("a", 2, 3), ("b", 3, None)], "job_id string, seq bigint, pages int")
    assert {(r["job_id"], r["seq"]) for r in D.latest_jobs(jobs).collect()} == {("a", 2), ("b", 3)}
    assert [(r["job_id"], r["total"]) for r in D.last_jobs(jobs, 1).collect()] == [("b", 2)] and D.last_jobs(jobs, 0).count() == 0


def test_export_merges_metadata(spark):
    res = spark.createDataFrame([("d", "a.pdf", 1, "", "", "", [3], {"dpi": '3"0', "requires_manual_review": "no", "x": None}), ("e", "b.pdf", 1, "", "", "", [], None)], "doc_id string, source_file string, pages_processed int, full_text_arabic string, full_text_english string, full_text_combined string, regions_flagged_for_review array<int>, metadata map<string,string>")
    empty = spark.createDataFrame([], SCHEMA)
    whole = D.assemble(empty).select("strengths").schema
    res = res.withColumn("strengths", F.lit(None).cast(whole["strengths"].dataType)).withColumn("inn_matches", F.expr(f"cast(array() as {D.MATCHES})"))
    docs = {r["doc_id"]: json.loads(r["document"])["ocr_metadata"] for r in D.export_document(res).collect()}
    assert docs["d"] == {"regions_flagged_for_review": [3], "requires_manual_review": "no", "dpi": '3"0', "x": None}
    assert docs["e"] == {"regions_flagged_for_review": [], "requires_manual_review": False}
    out = D.response(D.markdown(D.export_document(res)), F.lit("j"), "both")
    assert out.columns == ["job_id", "source_file", "pages_processed", "document", "markdown"] and "markdown" not in D.response(out, F.lit("j")).columns


def test_matches_bidi_and_boxes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    whole = D.with_matches(D.assemble(df, bidi=True), known_names(spark)).first()
    assert [m["matched"] for m in whole["inn_matches"]] == ["aspirin"] and len(whole["strengths"]) == 2 and whole["fields"] == [] and whole["metadata"] == {}
    boxed = spark.createDataFrame([("d", 1, 7, (30, 30, 30, 30), "a"), ("d", 2, 8, None, ""), ("d", 3, 9, (0, 0, 9, 9), "")], "doc_id string, page int, region_key bigint, bbox struct<x:int,y:int,w:int,h:int>, text string")
    rows = {r["page"]: r for r in D.page_boxes(boxed, 100.0, 100.0).collect()}
    assert rows[1]["x0"] == 7.2 and rows[2]["region_key"] is None and set(rows) == {1, 2, 3}
    modes = spark.createDataFrame([(10, 10, "mixed"), (None, None, "mixed")], "w int, h int, script string")
    assert [len(r["r"]) for r in modes.select(D.layout(F.col("w"), F.col("h"), F.col("script")).alias("r")).collect()] == [2, 0]
    assert [len(r["r"]) for r in modes.select(D.layout(F.col("w"), F.col("h"), F.col("script"), "full").alias("r")).collect()] == [1, 0]


def test_cli_missing_input(capsys):
    assert main(["process", "--input", "/nowhere.pdf", "--regions", "/nowhere"]) == 1
