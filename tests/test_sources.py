import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliora.operators import imaging as I
from foliora.sources import files as S
from foliora.sources import recognition as R


class Server(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self._send({"response": "" if body["prompt"] == "first" else f" read {len(body['images'][0])} "})

    def do_GET(self):
        self._send({"models": [{"name": "base-reader:latest"}]})

    def _send(self, obj):
        data = json.dumps(obj).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def url():
    s = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/"
    s.shutdown()


def test_recognise(spark, url):
    df = spark.createDataFrame([(1, b"abc"), (2, None)], "key bigint, image binary")
    got = {r["key"]: r for r in R.recognise(df, url, "m").collect()}
    assert got[1]["text"] == "read 4" and got[1]["confidence"] == 0.4 and got[2]["error"] == "no image"
    again = R.recognise(df.filter("key = 1"), url, "m", "first", "second", parallel=1).first()
    assert again["prompt_fallback_used"] and again["text"] == "read 4"
    assert R.recognise(df.filter("key = 1"), "http://127.0.0.1:9", "m", timeout=2).first()["error"] == "connection_error"


def test_health(spark, url):
    h = R.health(spark, url, ["base-reader", "other"])
    assert {r["model"]: r["available"] for r in h.collect()} == {"base-reader": True, "other": False}
    assert R.all_available(h).first()["code"] == 503 and not R.health(spark, "http://127.0.0.1:9", ["a"]).first()["available"]


def test_scan_and_render(spark, tmp_path):
    for n in ("a.PNG", "b.pdf", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    files = S.scan_files(spark, str(tmp_path))
    assert sorted(r["kind"] for r in files.collect()) == ["image", "pdf", "unsupported"]
    with pytest.raises(Exception):
        S.scan_files(spark, str(tmp_path), strict=True).collect()
    pages = S.render_pages(files).collect()
    assert len([p for p in pages if p["error"]]) == 3
    (tmp_path / "a.PNG").write_bytes(I.encode_png(np.arange(24, dtype=np.uint8).reshape(2, 4, 3)))
    page = S.render_pages(files).filter("path like '%PNG'").first()
    assert page["page_num"] == 1 and I.as_array(page["image"]["h"], page["image"]["w"], page["image"]["c"], bytes(page["image"]["data"])).tolist() == np.arange(24).reshape(2, 4, 3).tolist()
    with pytest.raises(ValueError):
        S.uploaded(spark, [("x.docx", b"")])
    assert [r["kind"] for r in S.uploaded(spark, [("x.PDF", b"1"), ("y.bmp", b"2")]).collect()] == ["pdf", "image"]


def test_png_filters():
    """Every filter of a line is undone."""
    import struct
    import zlib

    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    lines = []
    for y in range(5):
        cur, up = x[y].astype(int), x[y - 1].astype(int) if y else np.zeros((7, 3), int)
        left, corner = np.vstack([np.zeros((1, 3), int), cur[:-1]]), np.vstack([np.zeros((1, 3), int), up[:-1]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        lines.append(bytes([y]) + ((cur - (0, left, up, (left + up) // 2, paeth)[y]) % 256).astype(np.uint8).tobytes())
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"    "
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines)))
    assert (I.decode_png(data) == x[..., ::-1]).all() and (I.decode_png(I.encode_png(x)) == x).all() and (I.decode_png(I.encode_png(x[..., 0])) == x[..., 0]).all()
    with pytest.raises(ValueError):
        I.decode_png(b"x")


def test_files_to_documents(spark, tmp_path, url):
    """Files through recognition to written documents, by the command line."""
    from foliora.cli import main

    for n in ("one_en.png", "two_ar.png", "three.png"):
        (tmp_path / n).write_bytes(I.encode_png(np.zeros((4, 4, 3), np.uint8)))
    (tmp_path / "bad.png").write_bytes(b"x")
    from foliora.plans.pipeline import read_regions

    rows = {r["doc_id"]: r for r in read_regions(S.scan_files(spark, str(tmp_path)), url).collect()}
    assert rows["one_en"]["script"] == "latin" and rows["two_ar"]["script"] == "arabic" and rows["three"]["script"] == "mixed"
    assert all(rows[k]["text"].startswith("read") for k in ("one_en", "two_ar", "three")) and rows["bad"]["error"] and rows["bad"]["confidence"] == 0.0
    assert main(["batch", "--input-dir", str(tmp_path), "--output", str(tmp_path / "out"), "--format", "both", "--ollama-url", url]) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{n}_ocr.{s}" for n in ("one_en", "two_ar", "three", "bad") for s in ("json", "md"))
    assert main(["process", "-i", str(tmp_path / "one_en.png"), "-o", str(tmp_path / "one"), "--ollama-url", url]) == 0
    assert [p.name for p in (tmp_path / "one").iterdir()] == ["one_en_ocr.json"]
    assert main(["health", "--ollama-url", url]) == 1


def test_images(spark):
    x = np.arange(2 * 5 * 3, dtype=np.uint8).reshape(2, 5, 3)
    a, b = I.halves(x)
    assert a.shape == (2, 2, 3) and b.shape == (2, 3, 3) and (I.swap_channels(I.swap_channels(x)) == x).all()
    rows = spark.createDataFrame([(1, (2, 5, 3, x.tobytes())), (2, None)], "key bigint, image struct<h:int,w:int,c:int,data:binary>")
    got = {r["key"]: r for r in I.preprocess(rows, deskew=True, denoise=False, contrast=False).collect()}
    assert got[2]["error"] == "no image" and got[1]["image"]["w"] == 5
    pdf = I.merge_images(spark.createDataFrame([("d", 1, b"x")], "doc_id string, ord int, content binary")).first()
    assert pdf["doc_id"] == "d" and (pdf["pdf"] or pdf["error"])
    assert spark.createDataFrame([("abc",), (None,)], "t string").select(I.display_order(F.col("t")).alias("t")).collect()[0]["t"] == "abc"


def test_stream(spark, tmp_path):
    from foliora.streaming.watch import read_jobs, upsert_jobs, watch_regions

    schema = "region_key bigint, text string"
    spark.createDataFrame([(1, "500mg"), (2, None)], schema).write.parquet(str(tmp_path / "in"))
    q = watch_regions(spark, str(tmp_path / "in"), schema).writeStream.format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["clean"] for r in spark.table("w").collect()} == {"500 mg", None}
    jobs = "job_id string, seq bigint"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], jobs).write.parquet(str(tmp_path / "jobs"))
    upsert_jobs(spark.readStream.schema(jobs).parquet(str(tmp_path / "jobs")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    state = lambda: {(r["job_id"], r["seq"]) for r in read_jobs(spark, str(tmp_path / "out"), jobs).collect()}
    assert state() == {("a", 2), ("b", 1)} and read_jobs(spark, str(tmp_path / "none"), jobs).count() == 0
    spark.createDataFrame([("b", 5), ("c", 3)], jobs).write.mode("append").parquet(str(tmp_path / "jobs"))
    upsert_jobs(spark.readStream.schema(jobs).parquet(str(tmp_path / "jobs")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert state() == {("a", 2), ("b", 5), ("c", 3)}
    with pytest.raises(Exception):  # another checkpoint must not pass over what is kept
        upsert_jobs(spark.readStream.schema(jobs).parquet(str(tmp_path / "jobs")), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
