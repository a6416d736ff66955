"""Command line: process one file, batch a folder, ask for the models' health. Text comes from a model server or from recorded regions."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from foliora.functions.text import stem_of, suffix_of
from foliora.operators import document as D
from foliora.plans.pipeline import ARABIC_MODEL, LATIN_MODEL, URL, extract, read_regions
from foliora.session import build_session, cut_lineage
from foliora.sources.files import BATCH, load_names, scan_files
from foliora.sources.recognition import health


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliora")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("process", "batch"):
        s = sub.add_parser(name)
        s.add_argument(*(("--input", "-i") if name == "process" else ("--input-dir",)), dest="input", required=True)
        s.add_argument("--output", "-o", default="output")
        s.add_argument("--format", "-f", choices=["json", "markdown", "both"], default="json")
        s.add_argument("--ollama-url", dest="url", default=URL)
        s.add_argument("--confidence", type=float, default=D.REVIEW)
        s.add_argument("--names", help="reference list")
        s.add_argument("--regions", help="Parquet of recorded regions, in place of the model server")
        s.add_argument("--bidi", action="store_true", help="texts with Arabic in display order")
        if name == "process":
            s.add_argument("--dpi", type=int, default=300)
    sub.add_parser("health").add_argument("--ollama-url", dest="url", default=URL)
    a = p.parse_args(argv)
    if a.command == "health":
        rows = health(build_session(), a.url, [LATIN_MODEL, ARABIC_MODEL]).collect()
        for r in rows:
            print(f"{r['model']}: {'available' if r['available'] else 'NOT FOUND'}")
        return 0 if all(r["available"] for r in rows) else 1
    if not Path(a.input).exists():
        print(f"not found: {a.input}", file=sys.stderr)
        return 1
    spark = build_session()
    files = scan_files(spark, a.input)
    if a.command == "batch":
        files = files.filter(suffix_of(F.col("path")).isin(BATCH))
    if not files.select("path").take(1):
        print(f"no supported files in {a.input}", file=sys.stderr)
        return 1
    if a.regions:
        names = files.select(stem_of(F.col("path")).alias("doc_id")).distinct()
        regions = spark.read.parquet(a.regions).join(names, "doc_id", "left_semi")
    else:
        regions = read_regions(files, a.url, getattr(a, "dpi", 300))
    out = cut_lineage(extract(spark, regions, load_names(spark, a.names), a.confidence, a.bidi))
    # JSON is always written, Markdown where asked for
    D.write_documents(out, a.output, "json" if a.format == "json" else "both")
    failed = regions.filter("error is not null").select("doc_id", "error").distinct() if "error" in regions.columns else None
    bad = {r["doc_id"] for r in failed.toLocalIterator() if not print(f"failed: {r['doc_id']}: {r['error']}")} if failed is not None else set()
    total = out.count()
    print(f"done: {total - len(bad)}/{total} files processed")
    return 0


if __name__ == "__main__":
    sys.exit(main())
