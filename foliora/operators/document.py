"""Layout, routing, assembly of documents, exports and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliora.functions.text import clean_region, extract_strengths
from foliora.operators.matching import match_all

REVIEW = 0.85


def split_layout(w: Column, h: Column, script: Column) -> Column:
    """Heuristic regions of a page: two halves where mixed, else one; ARRAY<STRUCT>."""
    s = F.coalesce(script, F.lit("mixed"))
    mid = F.floor(w / 2).cast("int")

    def region(k, x, width, sc, d):
        return F.struct(F.lit(k).alias("region_id"), x.cast("int").alias("x"), F.lit(0).alias("y"), width.cast("int").alias("w"), h.alias("h"), sc.alias("script"), d.alias("direction"))

    two = F.array(region(1, F.lit(0), mid, F.lit("latin"), F.lit("ltr")), region(2, mid, w - mid, F.lit("arabic"), F.lit("rtl")))
    one = F.array(region(1, F.lit(0), w, s, F.when(s == "arabic", "rtl").otherwise("ltr")))
    return F.when(s == "mixed", two).otherwise(one)


def full_layout(w: Column, h: Column, script: Column) -> Column:
    """One region for the whole page; ARRAY<STRUCT>."""
    s = F.coalesce(script, F.lit("mixed"))
    return F.array(F.struct(F.lit(1).alias("region_id"), F.lit(0).alias("x"), F.lit(0).alias("y"), w.cast("int").alias("w"), h.alias("h"), s.alias("script"), F.when(s == "arabic", "rtl").otherwise("ltr").alias("direction")))


def layout(w: Column, h: Column, script: Column, mode: str = "heuristic") -> Column:
    """Regions of a page by mode: heuristic splits it, any other keeps it whole; a page without an image (null size) has none."""
    return F.when(w.isNull() | h.isNull(), F.array()).otherwise((split_layout if mode == "heuristic" else full_layout)(w, h, script))


def route(script: Column, has_image: Column) -> Column:
    """Recogniser for a region: latin, arabic, both, none (other scripts) or skipped (no image)."""
    known = F.when(script == "latin", "latin").when(script == "arabic", "arabic").when(script == "mixed", "both").otherwise("none")
    return F.when(~has_image & (known != "none"), "skipped").otherwise(known)


FIELDS = "array<struct<name:string,value:string,confidence:double,needs_review:boolean>>"
MATCHES = "array<struct<pos:int,input:string,matched:string,score:double>>"


def assemble(regions: DataFrame, threshold: float = REVIEW, bidi: bool = False) -> DataFrame:
    """One row for each doc_id: pages, the three texts in reading order, flagged regions, strengths of the combined text, and no fields or metadata yet.

    bidi puts the three texts of regions with Arabic in display order; strengths are read from the logical order.
    """
    df = regions.select("doc_id", "page", "region_id", "script", "confidence", F.coalesce("text", F.lit("")).alias("text")).withColumn("clean", clean_region(F.col("text"), F.col("script")))
    df = df.withColumn("shown", clean_region(F.col("text"), F.col("script"), bidi=True) if bidi else F.col("clean"))
    full = "text <> ''"
    order = "within group (order by page, region_id)"
    low = F.expr(f"{full} and confidence < {threshold}")

    def texts(column: str, which: str = "") -> Column:
        return F.expr(f"coalesce(listagg({column}, '\\n\\n') {order} filter (where {full}{which}), '')")

    out = df.groupBy("doc_id").agg(
        F.count_distinct(F.coalesce("page", F.lit(1))).cast("int").alias("pages_processed"),
        texts("shown", " and coalesce(script, '') <> 'latin'").alias("full_text_arabic"),
        texts("shown", " and coalesce(script, '') <> 'arabic'").alias("full_text_english"),
        texts("shown").alias("full_text_combined"),
        *([texts("clean").alias("logical")] if bidi else []),
        F.array_sort(F.collect_list(F.when(low, F.struct("page", "region_id")))).alias("flagged"),
    )
    out = out.withColumn("strengths", extract_strengths(F.col("logical" if bidi else "full_text_combined")))
    return out.withColumn("fields", F.expr(f"cast(array() as {FIELDS})")).withColumn("metadata", F.expr("cast(map() as map<string,string>)"))


def with_matches(documents: DataFrame, names: DataFrame, text: str = "full_text_combined") -> DataFrame:
    """The documents with ``inn_matches``, the valid matches of their text in the order of their tokens."""
    if "logical" in documents.columns:
        text = "logical"
    m = match_all(documents.select("doc_id", F.col(text).alias("text")), names)
    m = m.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "input", "matched", "score"))).alias("inn_matches"))
    return documents.join(m, "doc_id", "left").withColumn("inn_matches", F.coalesce("inn_matches", F.expr(f"cast(array() as {MATCHES})")))


def merged(base: Column, more: Column) -> Column:
    """Two maps as one; where both have a key, the second wins."""
    more = F.coalesce(more, F.expr("cast(map() as map<string,string>)"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k)), more)


def _json_text(c: Column) -> Column:
    """A string as JSON text; null as null."""
    return F.regexp_extract(F.to_json(F.array(c), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", 1)


def export_document(results: DataFrame, ts: Column | None = None) -> DataFrame:
    """The nested export row as JSON text (nulls kept); ts is a parameter so that output can be repeated."""
    first = F.try_element_at("strengths", F.lit(1))
    doc = F.struct(
        F.lit("1.0").alias("schema_version"),
        (F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX") if ts is not None else F.lit(None).cast("string")).alias("extraction_timestamp"),
        "source_file", "pages_processed",
        F.struct(F.struct(F.lit("").alias("arabic"), F.lit("").alias("english")).alias("trade_name"), F.try_element_at("inn_matches", F.lit(1))["matched"].alias("inn"), F.when(first.isNotNull(), F.concat_ws(" ", first["value"], first["unit"])).alias("strength"), F.col("strengths").alias("all_strengths"), *[F.lit("").alias(c) for c in ("dosage_form", "manufacturer", "origin_country", "atc_code")]).alias("drug_info"),
        F.struct(F.col("full_text_arabic").alias("arabic"), F.col("full_text_english").alias("english"), F.col("full_text_combined").alias("combined")).alias("text_content"),
        "inn_matches",
    )
    own = F.create_map(F.lit("regions_flagged_for_review"), F.to_json("regions_flagged_for_review"), F.lit("requires_manual_review"), F.to_json(F.array(F.size("regions_flagged_for_review") > 0)).substr(F.lit(2), F.when(F.size("regions_flagged_for_review") > 0, 4).otherwise(5)))
    more = F.transform_values("metadata", lambda _, v: _json_text(v)) if "metadata" in results.columns else F.lit(None).cast("map<string,string>")
    entries = F.transform(F.map_entries(merged(own, more)), lambda e: F.concat(_json_text(e["key"]), F.lit(":"), e["value"]))
    text = F.to_json(doc, {"ignoreNullFields": "false"})
    return results.withColumn("document", F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"ocr_metadata":{'), F.array_join(entries, ","), F.lit("}}")))


def response(results: DataFrame, job_id: Column, fmt: str = "json") -> DataFrame:
    """job_id, source_file, pages_processed, document and, where asked for, markdown: what a caller gets and the job store keeps."""
    keep = [job_id.alias("job_id"), "source_file", "pages_processed", "document"]
    return results.select(*keep, *(["markdown"] if fmt in ("markdown", "both") else []))


def markdown(results: DataFrame, title: str = "Extraction Report", ts: Column | None = None) -> DataFrame:
    """The report as Markdown text; sections only where they have content. The headings and labels below."""
    nl = "\n"

    def lines(*parts):
        return F.concat_ws(nl, *[F.lit(p) if isinstance(p, str) else p for p in parts])

    head = [F.lit(f"# {title}"), F.lit(""), F.concat(F.lit("**Source:** `"), F.coalesce(F.when(F.col("source_file") != "", F.col("source_file")), F.lit("unknown")), F.lit("`  "))]
    if ts is not None:
        head.append(F.concat(F.lit("**Extracted:** "), F.date_format(ts, "yyyy-MM-dd HH:mm 'UTC'"), F.lit("  ")))
    head += [F.concat(F.lit("**Pages processed:** "), F.coalesce(F.col("pages_processed").cast("string"), F.lit("None")), F.lit("  ")), F.concat(F.lit("**Regions flagged for review:** "), F.size("regions_flagged_for_review").cast("string")), F.lit("")]
    names = F.transform("inn_matches", lambda m: F.concat(F.lit("- `"), F.coalesce(m["input"], F.lit("")), F.lit("` → **"), F.coalesce(m["matched"], F.lit("")), F.lit("** (score: "), F.coalesce(F.bround(m["score"], 0).cast("bigint").cast("string"), F.lit("0")), F.lit("%)")))
    doses = F.transform("strengths", lambda s: F.concat(F.lit("- "), F.coalesce(s["value"], F.lit("")), F.lit(" "), F.coalesce(s["unit"], F.lit(""))))
    flags = F.transform("regions_flagged_for_review", lambda r: F.concat(F.lit("- Region ID `"), r.cast("string"), F.lit("`")))
    parts = [
        *head,
        F.when(F.size("inn_matches") > 0, lines("## Identified Drug Names (INN Match)", "", F.array_join(names, nl), "")),
        F.when(F.size("strengths") > 0, lines("## Detected Strengths / Doses", "", F.array_join(doses, nl), "")),
        F.when(F.coalesce("full_text_arabic", F.lit("")) != "", lines("## ‏النص العربي (Arabic Content)", "", F.col("full_text_arabic"), "")),
        F.when(F.coalesce("full_text_english", F.lit("")) != "", lines("## English Content", "", F.col("full_text_english"), "")),
        F.when(F.size("regions_flagged_for_review") > 0, lines("## Regions Requiring Manual Review", "", F.array_join(flags, nl), "")),
    ]
    return results.withColumn("markdown", F.concat_ws(nl, *parts))


def write_documents(df: DataFrame, folder: str, fmt: str = "both") -> None:
    """Files {stem}_ocr.json and .md for each row (source_file, document, markdown); equal stems get the row's doc_id. Repeated tasks overwrite their own files.

    folder is a path or a URI of any file system that Arrow knows; on a cluster it must be a URI that all executors share.
    """
    from foliora.functions.text import stem_of

    if "://" not in folder and not df.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError("name the output folder by a URI that all executors share")
    named = df.withColumn("stem", F.coalesce(F.when(stem_of(F.col("source_file")) != "", stem_of(F.col("source_file"))), F.lit("ocr_result")))
    n = F.count("*").over(Window.partitionBy("stem"))
    named = named.withColumn("name", F.when(n > 1, F.concat_ws("_", "stem", "doc_id")).otherwise(F.col("stem"))).select("name", "document", "markdown")

    def write(rows):
        import os

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        store.create_dir(root, recursive=True)
        for r in rows:
            for suffix, text, kinds in (("json", r["document"], ("json", "both")), ("md", r["markdown"], ("markdown", "both"))):
                if fmt in kinds:
                    with store.open_output_stream(f"{root}/{r['name']}_ocr.{suffix}") as f:
                        f.write((text or "").encode())

    named.foreachPartition(write)


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The last state of every job, by seq; a map-side aggregate, no sort."""
    cols = [c for c in jobs.columns if c != "job_id"]
    return jobs.groupBy("job_id").agg(F.max_by(F.struct(*cols), F.struct("seq", "loaded_at") if "loaded_at" in cols else F.col("seq")).alias("r")).select("job_id", "r.*")


def last_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest jobs first, with the total number of jobs; limit 0 gives none, a negative one is refused."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    total = jobs.select(F.count_distinct("job_id").alias("n"))
    return latest_jobs(jobs).orderBy(F.desc("seq")).limit(limit).withColumn("total", total.scalar())


def page_boxes(regions: DataFrame, w: float, h: float, dpi: float = 300.0) -> DataFrame:
    """doc_id, page, region_key, x0, y0, x1, y1, text: every page with the boxes of its regions that have text; a page without any gives one row of nulls."""
    f = lambda c: F.col(f"bbox.{c}").cast("double")
    corners = overlay_box(f("x"), f("y"), f("w"), f("h"), F.lit(w), F.lit(h), dpi)
    boxes = regions.filter("bbox is not null and text <> ''").select("doc_id", "page", "region_key", *[F.bround(b, 6).alias(n) for b, n in zip(corners, ("x0", "y0", "x1", "y1"))], "text")
    return regions.select("doc_id", "page").distinct().join(boxes, ["doc_id", "page"], "left")


def overlay_box(x: Column, y: Column, w: Column, h: Column, pw: Column, ph: Column, dpi: float = 300.0) -> list[Column]:
    """Corners of a pixel box in points, inside a page of pw by ph points, at least one point wide and high."""
    s = dpi / 72
    x0, y0 = F.greatest(F.lit(0.0), F.least(x / s, pw)), F.greatest(F.lit(0.0), F.least(y / s, ph))
    return [x0, y0, F.greatest(x0 + 1, F.least((x + w) / s, pw)), F.greatest(y0 + 1, F.least((y + h) / s, ph))]


def deskew_angle(angle: Column) -> Column:
    """Rotation for a measured angle; 0 where it is too small or too large."""
    a = F.when(angle < -45, -(90 + angle)).otherwise(-angle)
    return F.when((F.abs(a) < 0.1) | (F.abs(a) > 10), F.lit(0.0)).otherwise(a)
