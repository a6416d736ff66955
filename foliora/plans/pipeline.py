"""From files to documents: pages, layout, recognition of every region by the models of its script, assembly and exports, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliora.functions.text import confidence_of, merge_scripts, script_hint, stem_of
from foliora.operators import document as D
from foliora.operators.imaging import png
from foliora.session import cut_lineage
from foliora.sources.files import render_pages
from foliora.sources.recognition import recognise

#: Models for Latin and Arabic script at the server, and the second prompt for Arabic.
LATIN_MODEL, ARABIC_MODEL = "glm-ocr", "glm-ocr-arabic"
ARABIC_PROMPT, SECOND_PROMPT = "استخرج كل النص من هذه الصورة.", "Extract all Arabic text from this image."
URL = "http://localhost:11434"


def read_regions(files: DataFrame, url: str = URL, dpi: int = 300, latin: str = LATIN_MODEL, arabic: str = ARABIC_MODEL, parallel: int | None = None) -> DataFrame:
    """doc_id, source_file, page, region_id, script, direction, text, confidence, error for every page of files (path, content, kind).

    The script of a page is hinted by its file's name. A failed page or call gives an error, no text and confidence 0.
    Calls are made once for each region: their answers are checkpointed.
    """
    pages = render_pages(files, dpi).withColumn("doc_id", stem_of(F.col("path")))
    shape = D.layout(F.col("image.w"), F.col("image.h"), script_hint(F.col("doc_id")), "full")
    region = F.explode_outer(F.when(F.col("image").isNotNull(), shape))
    regions = pages.select("doc_id", F.col("path").alias("source_file"), F.col("page_num").alias("page"), "image", F.col("error").alias("page_error"), region.alias("r"))
    regions = regions.select("doc_id", "source_file", "page", "r.region_id", "r.script", "r.direction", "page_error", png(F.col("image")).alias("image"))
    regions = cut_lineage(regions.withColumn("key", F.xxhash64("source_file", "page", "region_id")).withColumn("route", D.route(F.col("script"), F.col("image").isNotNull())))
    asked = regions.select("key", "image", "route")
    en = recognise(asked.filter("route in ('latin', 'both')"), url, latin, parallel=parallel)
    ar = recognise(asked.filter("route in ('arabic', 'both')"), url, arabic, ARABIC_PROMPT, SECOND_PROMPT, timeout=150.0, parallel=parallel)
    answers = [cut_lineage(a.select("key", F.col("text").alias(n), F.col("confidence").alias(f"{n}_conf"), F.col("error").alias(f"{n}_error"))) for a, n in ((en, "en"), (ar, "ar"))]
    both = regions.drop("image").join(answers[0], "key", "left").join(answers[1], "key", "left")
    m = F.when(F.col("route") == "both", merge_scripts(F.col("en"), F.col("en_conf"), F.col("ar"), F.col("ar_conf"))).otherwise(F.struct(F.coalesce("en", "ar", F.lit("")).alias("text"), F.coalesce("en_conf", "ar_conf", F.lit(0.0)).alias("confidence")))
    out = both.withColumn("m", m).withColumn("error", F.coalesce("page_error", F.when(F.col("m.text") == "", F.coalesce("en_error", "ar_error"))))
    return out.select("doc_id", "source_file", F.coalesce("page", F.lit(1)).alias("page"), F.coalesce("region_id", F.lit(1)).alias("region_id"), "script", "direction", "m.text", "m.confidence", "error")


def extract(spark: SparkSession, regions: DataFrame, names: DataFrame, threshold: float = D.REVIEW, bidi: bool = False, ts: Column | None = None) -> DataFrame:
    """Results with strengths, matches, document and markdown for regions (doc_id, page, region_id, script, confidence, text)."""
    res = D.assemble(regions, threshold, bidi).withColumn("regions_flagged_for_review", F.transform("flagged", lambda f: f["region_id"]))
    if "source_file" in regions.columns:
        res = res.join(regions.groupBy("doc_id").agg(F.min("source_file").alias("source_file")), "doc_id")
    else:
        res = res.withColumn("source_file", F.col("doc_id"))
    return D.markdown(D.export_document(D.with_matches(res, names), ts), ts=ts)


def replayed(answers: DataFrame) -> DataFrame:
    """Recorded answers (key, lang, text, model, error) in place of calls: null texts are failures, confidence goes by length."""
    return answers.select("key", "lang", F.coalesce("text", F.lit("")).alias("text"), confidence_of(F.coalesce("text", F.lit(""))).alias("confidence"), "model", F.coalesce("error", F.when(F.col("text").isNull(), "connection_error")).alias("error"))
