"""Recognition over HTTP: images to text through a model server, errors as data, one call for each image."""

from __future__ import annotations

import base64
import json
import socket
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANSWER = T.StructType(
    [
        T.StructField("key", T.LongType()), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("model", T.StringType()),
        T.StructField("error", T.StringType()), T.StructField("prompt_fallback_used", T.BooleanType()), T.StructField("raw_response", T.StringType()),
    ]
)
PROMPT = "Extract all text from this image."


def base_url(url: str) -> str:
    return url.rstrip("/")


def estimate(text: str) -> float:
    """Confidence by length alone, as functions.text.confidence_of."""
    n = len(text)
    return 0.0 if n == 0 else 0.4 if n < 10 else 0.92 if n > 50 else 0.75


def ask(url: str, model: str, prompt: str, image: bytes, timeout: float) -> tuple[str, str | None, str | None]:
    """(text, error, raw response); every failure becomes an error."""
    body = {"model": model, "prompt": prompt, "images": [base64.b64encode(image).decode()], "stream": False, "options": {"temperature": 0, "num_predict": 4096}}
    try:
        req = urllib.request.Request(f"{base_url(url)}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(req, timeout=timeout) as r:
            raw = r.read().decode("utf-8", "replace")
        return str(json.loads(raw).get("response") or "").strip(), None, raw
    except (TimeoutError, socket.timeout):
        return "", "timeout", None
    except urllib.error.URLError as e:
        return "", "timeout" if isinstance(e.reason, TimeoutError) else "connection_error", None
    except Exception as e:  # noqa: BLE001
        return "", str(e)[:200], None


def recognise(images: DataFrame, url: str, model: str, prompt: str = PROMPT, second_prompt: str | None = None, timeout: float = 120.0, parallel: int | None = None) -> DataFrame:
    """Answers for images (key, image). A null image gives no text and confidence 0; second_prompt is tried once where the first gives no text.

    parallel bounds how many calls run at a time. A repeated task repeats its calls.
    """
    df = images.select("key", "image")
    if parallel:
        df = df.repartition(parallel)

    def run(batches):
        for b in batches:
            out = []
            for key, image in zip(b["key"], b["image"]):
                if image is None:
                    out.append((key, "", 0.0, model, "no image", False, None))
                    continue
                text, error, raw = ask(url, model, prompt, bytes(image), timeout)
                again = bool(second_prompt) and not text
                if again:
                    text, error, raw = ask(url, model, second_prompt, bytes(image), timeout)
                out.append((key, text, estimate(text), model, error, again, raw))
            yield pd.DataFrame(out, columns=ANSWER.names)

    return df.mapInPandas(run, ANSWER)


def health(spark: SparkSession, url: str, models: list[str], timeout: float = 5.0) -> DataFrame:
    """model, available: whether a listed name contains each model's; False on any error."""
    try:
        with urllib.request.urlopen(f"{base_url(url)}/api/tags", timeout=timeout) as r:
            listed = [m.get("name", "") for m in json.loads(r.read()).get("models", [])]
    except Exception:  # noqa: BLE001
        listed = []
    df = spark.createDataFrame([(m,) for m in models], "model string")
    names = F.array(*[F.lit(n) for n in listed]) if listed else F.expr("cast(array() as array<string>)")
    return df.withColumn("available", F.exists(names, lambda n: F.contains(n, F.col("model"))))


def all_available(status: DataFrame) -> DataFrame:
    """status, code: ok and 200 where every model is available, else degraded and 503."""
    ok = F.coalesce(F.bool_and("available"), F.lit(False))
    return status.agg(F.when(ok, "ok").otherwise("degraded").alias("status"), F.when(ok, 200).otherwise(503).alias("code"))
