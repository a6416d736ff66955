"""File sources: scans of files and of reference lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliora.functions.text import suffix_of

# Suffixes of images, and of the files that a batch takes.
IMAGES = [".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp", ".webp"]
BATCH = [".pdf", ".jpg", ".jpeg", ".png", ".tiff", ".tif"]
# Names known without a list.
KNOWN_NAMES = [
    "paracetamol", "acetaminophen", "ibuprofen", "amoxicillin", "metformin", "atorvastatin", "omeprazole", "amlodipine", "losartan", "metoprolol",
    "simvastatin", "cetirizine", "loratadine", "aspirin", "diclofenac", "pantoprazole", "salbutamol", "albuterol", "dexamethasone", "prednisolone",
    "azithromycin", "ciprofloxacin", "amoxicillin clavulanate", "ceftriaxone", "insulin", "metronidazole", "fluconazole", "clarithromycin", "ranitidine",
    "clopidogrel", "warfarin", "enoxaparin", "furosemide", "spironolactone", "lisinopril", "enalapril", "ramipril", "valsartan", "bisoprolol",
]


def file_kind(path: Column) -> Column:
    s = suffix_of(path)
    return F.when(s == ".pdf", "pdf").when(s.isin(IMAGES), "image").otherwise("unsupported")


def scan_files(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """Files of a folder (not below it): path, modificationTime, length, content, kind, error. strict raises on other kinds."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).withColumn("kind", file_kind(F.col("path")))
    bad = F.col("kind") == "unsupported"
    if strict:
        return df.withColumn("kind", F.when(bad, F.raise_error(F.concat(F.lit("unsupported file: "), F.col("path")))).otherwise(F.col("kind")))
    return df.withColumn("error", F.when(bad, "unsupported file"))


NAMES = "pos int, inn string, source string"


def uploaded(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    """Files handed over in memory (name, bytes), as scan_files gives them; a suffix that is not allowed is refused with ValueError."""
    bad = [name for name, _ in files if not name.lower().endswith(tuple([".pdf", *IMAGES]))]
    if bad:
        raise ValueError(f"unsupported file: {', '.join(bad)}")
    rows = [(name, None, len(content), bytearray(content)) for name, content in files]
    df = spark.createDataFrame(rows, "path string, modificationTime timestamp, length bigint, content binary")
    return df.withColumn("kind", file_kind(F.col("path"))).withColumn("error", F.lit(None).cast("string"))


def names_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """First column, trimmed, in small letters, blanks dropped; no header; one file, read in its order."""
    return _positions(spark.read.csv(path, header=False, multiLine=True, escape='"').select(F.trim(F.lower("_c0")).alias("inn")), path)


def names_from_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "inn"))
    return rows.select(F.col("pos").cast("int").alias("pos"), F.lower("inn").alias("inn"), F.lit(path.rsplit("/", 1)[-1]).alias("source")).filter("trim(inn) != ''")


def names_from_text(spark: SparkSession, path: str) -> DataFrame:
    return _positions(spark.read.text(path).select(F.trim(F.lower("value")).alias("inn")), path)


def _positions(df: DataFrame, path: str) -> DataFrame:
    """Positions in the order of the list: the rows before in earlier partitions (one count for each) and in the row's own."""
    kept = df.filter("inn != ''").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    counts = kept.groupBy("part").count().orderBy("part").collect()
    before, total = {}, 0
    for r in counts:
        before[r["part"]] = total
        total += r["count"]
    if not counts:
        return df.sparkSession.createDataFrame([], NAMES)
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part"))
    place = start + F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1
    return kept.select(place.cast("int").alias("pos"), "inn", F.lit(path.rsplit("/", 1)[-1]).alias("source"))


#: Where a list is looked for if none is named.
DEFAULT_LIST = "data/inn_list/who_inn.csv"


def known_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, "fallback") for k, n in enumerate(KNOWN_NAMES)], NAMES)


def load_names(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The list by its suffix (DEFAULT_LIST where none is named); the known names where it cannot be read."""
    path = path or DEFAULT_LIST
    try:
        read = names_from_csv if path.endswith(".csv") else names_from_json if path.endswith(".json") else names_from_text
        df = read(spark, path)
        df.take(1)
        return df
    except Exception:  # noqa: BLE001 - any unreadable list falls back
        return known_names(spark)


def recorded_answers(df: DataFrame) -> DataFrame:
    """A recognition backend that replays recorded texts: key, lang, text, confidence, model, error."""
    return df.select("key", "lang", F.col("text"), "confidence", "model", "error")


IMAGE = T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("data", T.BinaryType())])
PAGE = T.StructType([T.StructField("path", T.StringType()), T.StructField("page_num", T.IntegerType()), T.StructField("image", IMAGE), T.StructField("error", T.StringType())])


def render_pages(files: DataFrame, dpi: int = 300) -> DataFrame:
    """path, page_num, image (h, w, c, data; colours in the order blue, green, red), error: the pages of PDF files and one page for each image file.

    PDF needs an optional library. Files that cannot be read, and others, give one row with an error.
    """

    def render(batches):
        import pandas as pd

        from foliora.operators.imaging import decode, packed

        for b in batches:
            out = []
            for path, content, kind in zip(b["path"], b["content"], b["kind"]):
                try:
                    if kind == "image":
                        out.append((path, 1, packed(decode(bytes(content))), None))
                    elif kind == "pdf":
                        import fitz

                        with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                            out += [(path, k + 1, packed(decode(page.get_pixmap(dpi=dpi).tobytes("png"))), None) for k, page in enumerate(doc)]
                    else:
                        out.append((path, None, None, "unsupported file"))
                except ImportError:
                    out.append((path, None, None, "no PDF library"))
                except Exception as e:  # noqa: BLE001 - one bad file does not end the job
                    out.append((path, None, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=PAGE.names)

    return files.select("path", "content", "kind").mapInPandas(render, PAGE)
