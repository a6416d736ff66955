"""Queries of the core, by name; each takes (spark, sf_dir) and reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliora.functions import text as X
from foliora.operators import document as D
from foliora.operators import matching as M
from foliora.operators.imaging import display_order
from foliora.operators.units import p1_found
from foliora.plans import pipeline as P
from foliora.sources import files as S
from foliora.sources.tables import once, table

SUFFIXES = [".pdf", ".JPG", ".jpeg", ".png", ".tiff", ".tif", ".bmp", ".webp", ".docx", ""]
PIECES = ["base-reader", "arabic-reader"]


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions once each, text never null."""
    r = table(spark, d, "regions").select("region_key", "doc_id", "page", "region_id", "region_type", "bbox", "script", "confidence", F.coalesce("text", F.lit("")).alias("text"))
    return once(r, "region_key").withColumn("script", F.lower(F.trim("script")))


def results(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results").select("result_id", "doc_id", "source_file", "pages_processed", "full_text_arabic", "full_text_english", "full_text_combined", "regions_flagged_for_review", "metadata")
    return once(r, "result_id")


def _files(spark, d):
    names = F.array(*[F.lit(s) for s in SUFFIXES])
    suffix = F.element_at(names, (F.col("result_id") % 10 + 1).cast("int"))
    return results(spark, d).select("result_id", F.concat(F.lit("/in/"), F.regexp_replace("source_file", r"\.pdf$", ""), suffix).alias("path"))


def scan_dispatch(spark, d):
    return _files(spark, d).select("result_id", X.suffix_of(F.col("path")).alias("suffix"), S.file_kind(F.col("path")).alias("kind"))


def batch_scan(spark, d):
    return _files(spark, d).withColumn("suffix", X.suffix_of(F.col("path"))).filter(F.col("suffix").isin(S.BATCH)).select("result_id", "suffix")


def output_name(spark, d):
    stem = X.stem_of(F.col("path"))
    return _files(spark, d).select("result_id", stem.alias("stem"), F.concat(stem, F.lit("_ocr.json")).alias("json_name"), F.concat(stem, F.lit("_ocr.md")).alias("markdown_name"))


def script_hint(spark, d):
    return results(spark, d).select("result_id", X.script_hint(X.stem_of(F.col("source_file"))).alias("script"))


def page_enumerate(spark, d):
    pages = regions(spark, d).select("doc_id", "page").distinct()
    return pages.select("doc_id", "page", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")).alias("page_num"))


def _boxes(spark, d):
    return regions(spark, d).select("region_key", F.col("bbox.w").alias("w"), F.col("bbox.h").alias("h"), F.when(F.col("script").isin("arabic", "latin", "mixed"), F.col("script")).alias("script"))


def _layout(mode):
    def query(spark, d):
        return _boxes(spark, d).select("region_key", F.explode(D.layout(F.col("w"), F.col("h"), F.col("script"), mode)).alias("r")).select("region_key", "r.*")

    return query


layout_heuristic, layout_full_page = _layout("heuristic"), _layout("full")


def _routed(spark, d):
    return regions(spark, d).withColumn("route", D.route(F.col("script"), F.col("region_key") % 13 != 0))


def route_regions(spark, d):
    guarded = F.when((F.col("route") == "skipped") & (F.col("script") != "mixed"), 0.0).when(F.col("route").isin("skipped", "none"), 1.0).otherwise(F.col("confidence"))
    return _routed(spark, d).select("region_key", "route", guarded.alias("confidence"))


def route_counts(spark, d):
    return _routed(spark, d).groupBy("route").agg(F.count("*").alias("n"))


def confidence(spark, d):
    return regions(spark, d).select("region_key", X.confidence_of(F.col("text")).alias("confidence"))


def _answers(spark, d):
    r = results(spark, d)
    return r.select("result_id", F.col("full_text_english").alias("en"), F.col("full_text_arabic").alias("ar"))


def ocr_replay(spark, d):
    a = _answers(spark, d)
    rows = a.select("result_id", F.explode(F.array(F.struct(F.lit("en").alias("lang"), F.col("en").alias("text")), F.struct(F.lit("ar").alias("lang"), F.col("ar").alias("text")))).alias("r")).select("result_id", "r.*")
    text = X.strip(F.coalesce("text", F.lit("")))
    none = F.lit(None).cast("string")
    answers = rows.select(F.col("result_id").alias("key"), "lang", F.when(F.col("text").isNotNull(), text).alias("text"), none.alias("model"), none.alias("error"))
    return P.replayed(answers).select(F.col("key").alias("result_id"), "lang", "text", "confidence", "error")


def ocr_fallback(spark, d):
    ar, en = X.strip(F.coalesce("ar", F.lit(""))), X.strip(F.coalesce("en", F.lit("")))
    return _answers(spark, d).select("result_id", F.when(ar != "", ar).otherwise(en).alias("text"), (ar == "").alias("prompt_fallback_used"))


def ocr_merge(spark, d):
    a = _answers(spark, d)
    en, ar = a.select("result_id", "en").filter("en is not null"), a.select("result_id", "ar").filter("ar is not null")
    both = en.join(ar, "result_id", "full_outer")
    m = X.merge_scripts(F.col("en"), X.confidence_of(F.col("en")), F.col("ar"), X.confidence_of(F.col("ar")))
    return both.select("result_id", m.alias("m")).select("result_id", "m.*")


def _text(f, name="text"):
    return lambda spark, d: regions(spark, d).select("region_key", f(F.col("text")).alias(name))


def postprocess_text(spark, d):
    return regions(spark, d).select("region_key", X.clean_region(F.col("text"), F.col("script")).alias("text"))


def extract_strengths(spark, d):
    return regions(spark, d).select("region_key", F.posexplode(X.extract_strengths(F.col("text"))).alias("ord", "s")).select("region_key", "ord", "s.value", "s.unit", "s.raw")


def script_detect(spark, d):
    t = F.col("text")
    return regions(spark, d).select("region_key", X.count_of(t, X.ARABIC_LETTERS).alias("n_arabic"), X.count_of(t, "a-zA-Z").alias("n_latin"), X.script_of(t).alias("script"))


def inn_fallback(spark, d):
    return S.known_names(spark).select("pos", "inn")


def inn_tokens(spark, d):
    return M.document_tokens(regions(spark, d), "region_key").select("region_key", "pos", "input")


def _token_table(spark, d):
    return M.document_tokens(regions(spark, d), "region_key").select("token").distinct()


def inn_match_one(spark, d):
    return M.match_one(table(spark, d, "inn_matches").select("input"), table(spark, d, "inn"), "list")


def inn_match_all(spark, d):
    return M.match_all(regions(spark, d).select("region_key", "text"), table(spark, d, "inn"), "region_key")


def inn_match_substring(spark, d):
    return M.match_substring(_token_table(spark, d), table(spark, d, "inn"))


def qc_flag(spark, d):
    return regions(spark, d).filter("text <> ''").select("region_key", F.coalesce(F.col("confidence") < D.REVIEW, F.lit(False)).alias("needs_review"))


def document_result(spark, d):
    a = D.with_matches(D.assemble(regions(spark, d)), table(spark, d, "inn"))
    flagged = F.array_join(F.transform("flagged", lambda f: f["region_id"].cast("string")), ",")
    return a.select("doc_id", "pages_processed", "full_text_arabic", "full_text_english", "full_text_combined", flagged.alias("regions_flagged"), F.size("strengths").alias("n_strengths"), F.size("inn_matches").alias("n_matches"))


def qc_flagged(spark, d):
    rows = regions(spark, d).filter(f"text <> '' and confidence < {D.REVIEW}").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "region_id"))).alias("f"))
    return rows.select("doc_id", F.array_join(F.transform("f", lambda f: F.concat_ws(":", f["page"], f["region_id"])), ",").alias("flagged"))


def full_results(spark, d) -> DataFrame:
    """Results with their strengths and valid matches as arrays, in the order of their keys."""
    s = once(table(spark, d, "strengths").filter("result_id is not null").select("strength_id", "result_id", "value", "unit", "raw"), "strength_id")
    s = s.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("strength_id", "value", "unit", "raw"))).alias("strengths"))
    m = once(table(spark, d, "inn_matches").filter("result_id is not null and is_valid").select("match_id", "result_id", "input", "matched", "score", "source", "is_valid"), "match_id")
    m = m.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("match_id", "input", "matched", "score", "source", "is_valid"))).alias("inn_matches"))
    df = results(spark, d).join(s, "result_id", "left").join(m, "result_id", "left")
    for c, t in (("strengths", "array<struct<strength_id:bigint,value:string,unit:string,raw:string>>"), ("inn_matches", "array<struct<match_id:bigint,input:string,matched:string,score:double,source:string,is_valid:boolean>>"), ("regions_flagged_for_review", "array<int>")):
        df = df.withColumn(c, F.coalesce(F.col(c), F.expr(f"cast(array() as {t})")))
    return df


def result_projection(spark, d) -> DataFrame:
    return full_results(spark, d).select("result_id", "source_file", "pages_processed", F.size("strengths").alias("n_strengths"), F.size("inn_matches").alias("n_matches"), F.array_join("regions_flagged_for_review", ",").alias("flagged"))


def json_export(spark, d):
    doc = D.export_document(full_results(spark, d))
    g = lambda p: F.get_json_object("document", p)
    return doc.select("result_id", g("$.source_file").alias("source_file"), g("$.drug_info.inn").alias("inn"), g("$.drug_info.strength").alias("strength"), g("$.ocr_metadata.requires_manual_review").alias("requires_manual_review"), g("$.ocr_metadata.dpi").alias("dpi"), g("$.ocr_metadata.timestamp").alias("timestamp"))


def markdown_export(spark, d):
    return D.markdown(full_results(spark, d)).select("result_id", "markdown")


def summary(spark, d):
    return full_results(spark, d).select("result_id", "source_file", "pages_processed", F.size("inn_matches").alias("names_found"), F.size("strengths").alias("strengths_found"), F.size("regions_flagged_for_review").alias("flagged"))


def jobs(spark, d) -> DataFrame:
    return table(spark, d, "jobs").select("seq", "job_id", "source_file", "pages_processed", "status", "loaded_at").drop("loaded_at").distinct()


def job_upsert(spark, d):
    return D.latest_jobs(jobs(spark, d))


def job_get(spark, d):
    one = jobs(spark, d).agg(F.min("job_id").alias("job_id"))
    return D.latest_jobs(jobs(spark, d).join(one, "job_id", "left_semi"))


def job_list(spark, d):
    return D.last_jobs(jobs(spark, d), 20).select("job_id", "source_file", F.col("pages_processed").alias("pages"), "total")


def batch_summary(spark, d):
    return D.latest_jobs(jobs(spark, d)).agg(F.count_if(F.col("pages_processed").isNotNull()).alias("ok"), F.count("*").alias("total"))


def health_check(spark, d):
    """Installed models are the names of the parts; one required name is among them, the other is not."""
    names = table(spark, d, "part").agg(*[F.coalesce(F.bool_or(F.contains("p_name", F.lit(m))), F.lit(False)).alias(m) for m in ("part 1", "no-such-model")])
    return names.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"`{m}`").alias("available")) for m in ("part 1", "no-such-model")])).alias("h")).select("h.*")


def overlay_geometry(spark, d):
    return D.page_boxes(regions(spark, d), 420.0, 595.0).drop("text")


def deskew_angle(spark, d):
    a = D.deskew_angle((F.col("l_quantity") - 25) * 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(a, 4).alias("angle"))


def base64_content(spark, d):
    return regions(spark, d).select("region_key", F.regexp_replace(F.base64(F.encode("text", "utf-8")), "[\r\n]", "").alias("content"))


QUERIES = {
    "p1_found": p1_found, "scan_dispatch": scan_dispatch, "batch_scan": batch_scan, "output_name": output_name, "script_hint": script_hint, "page_enumerate": page_enumerate,
    "layout_heuristic": layout_heuristic, "layout_full_page": layout_full_page, "route_regions": route_regions, "route_counts": route_counts, "confidence": confidence,
    "ocr_replay": ocr_replay, "ocr_fallback": ocr_fallback, "ocr_merge": ocr_merge, "script_detect": script_detect, "has_arabic": _text(X.has_arabic, "has_arabic"),
    "normalize_digits": _text(X.normalize_digits), "normalize_units": _text(X.normalize_units), "normalize_numerals": _text(X.normalize_numerals), "arabic_units": _text(X.arabic_units),
    "bidi_passthrough": _text(display_order), "postprocess_text": postprocess_text, "strict_units": _text(lambda c: X.clean(c, strict_units=True)), "extract_strengths": extract_strengths, "inn_fallback": inn_fallback, "inn_tokens": inn_tokens,
    "inn_match_one": inn_match_one, "inn_match_all": inn_match_all, "inn_match_substring": inn_match_substring, "qc_flag": qc_flag, "qc_flagged": qc_flagged, "document_result": document_result,
    "result_projection": result_projection, "json_export": json_export, "markdown_export": markdown_export, "summary": summary, "job_upsert": job_upsert, "job_get": job_get, "job_list": job_list,
    "batch_summary": batch_summary, "health_check": health_check, "overlay_geometry": overlay_geometry, "deskew_angle": deskew_angle, "base64_content": base64_content,
}
QUERIES |= {"bench_normalize": QUERIES["postprocess_text"], "bench_strengths": extract_strengths, "bench_inn": inn_match_all, "bench_document": document_result}
