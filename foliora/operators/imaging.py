"""Page images: crops, channel order, filters; PDF output; display order of bidirectional text. Optional libraries are reported as errors."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("data", T.BinaryType())])


def as_array(h: int, w: int, c: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape((h, w, c) if c > 1 else (h, w))


def packed(img: np.ndarray) -> dict:
    """An image as a struct of IMAGE."""
    return {"h": img.shape[0], "w": img.shape[1], "c": img.shape[2] if img.ndim == 3 else 1, "data": np.ascontiguousarray(img).tobytes()}


def encode_png(img: np.ndarray) -> bytes:
    """PNG of a grey image or one in the order blue, green, red."""
    x = np.ascontiguousarray(swap_channels(img))
    h, w = x.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), x.reshape(h, -1)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if x.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """A PNG of 8 bits a channel, not interlaced, grey or in colours, in the order blue, green, red; transparency is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no image that can be decoded here")
    at, parts, head = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + n])
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += n + 12
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("a kind of PNG that needs an image library")
    w, h, step = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.int64)
    above = np.zeros(w * step, np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 1:  # sums of every step-th value
            line = np.cumsum(line.reshape(w, step), axis=0).reshape(-1) % 256
        elif kind == 2:
            line = (line + above) % 256
        elif kind in (3, 4):
            for i in range(w * step):
                left, up, corner = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[i] = (line[i] + guess) % 256
        out[y] = above = line
    img = out.astype(np.uint8).reshape(h, w, step)
    return img[..., 0] if step <= 2 else swap_channels(img[..., :3])


def decode(data: bytes) -> np.ndarray:
    """An image file as an array, colours in the order blue, green, red: by OpenCV, where it is missing or fails by Pillow, then as PNG."""
    try:
        import cv2

        img = cv2.imdecode(np.frombuffer(data, np.uint8), cv2.IMREAD_COLOR)
        if img is not None:
            return img
    except ImportError:
        pass
    try:
        import io

        from PIL import Image

        return swap_channels(np.array(Image.open(io.BytesIO(data)).convert("RGB")))
    except ImportError:
        return decode_png(data)


def png(image: Column) -> Column:
    """PNG bytes of an image struct; null for null."""

    @F.pandas_udf(T.BinaryType())
    def run(b: pd.DataFrame) -> pd.Series:
        return pd.Series([None if d is None or pd.isna(h) else encode_png(as_array(int(h), int(w), int(c), bytes(d))) for h, w, c, d in zip(b["h"], b["w"], b["c"], b["data"])])

    return run(image)


def swap_channels(img: np.ndarray) -> np.ndarray:
    """RGB to BGR and back; grey images stay."""
    return img[..., ::-1] if img.ndim == 3 else img


def halves(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mid = img.shape[1] // 2
    return img[:, :mid], img[:, mid:]


def filtered(img: np.ndarray, deskew: bool = True, denoise: bool = True, contrast: bool = True) -> np.ndarray:
    """Deskew, denoise and raise contrast, each on request; needs OpenCV. The constants of the three filters."""
    import cv2

    if deskew:
        ink = np.column_stack(np.where(cv2.bitwise_not(cv2.cvtColor(img, cv2.COLOR_BGR2GRAY)) > 0))
        if len(ink):
            a = cv2.minAreaRect(ink)[-1]
            a = -(90 + a) if a < -45 else -a
            if 0.1 <= abs(a) <= 10:
                h, w = img.shape[:2]
                img = cv2.warpAffine(img, cv2.getRotationMatrix2D((w // 2, h // 2), a, 1.0), (w, h), flags=cv2.INTER_CUBIC, borderMode=cv2.BORDER_REPLICATE)
    if denoise:
        img = cv2.fastNlMeansDenoisingColored(img, None, 10, 10, 7, 21)
    if contrast:
        lab = cv2.cvtColor(img, cv2.COLOR_BGR2LAB)
        lab[..., 0] = cv2.createCLAHE(clipLimit=2.0, tileGridSize=(8, 8)).apply(np.ascontiguousarray(lab[..., 0]))
        img = cv2.cvtColor(lab, cv2.COLOR_LAB2BGR)
    return img


def preprocess(pages: DataFrame, **filters: bool) -> DataFrame:
    """The pages (key, image as struct of h, w, c, data) with filtered images and an error column."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("image", IMAGE), T.StructField("error", T.StringType())])

    def run(batches):
        for b in batches:
            out = []
            for key, im in zip(b["key"], b["image"]):
                if im is None:
                    out.append((key, None, "no image"))
                    continue
                try:
                    x = np.ascontiguousarray(filtered(as_array(im["h"], im["w"], im["c"], bytes(im["data"])), **filters))
                    out.append((key, {"h": x.shape[0], "w": x.shape[1], "c": im["c"], "data": x.tobytes()}, None))
                except ImportError:
                    out.append((key, im, "no image library"))
                except Exception as e:  # noqa: BLE001
                    out.append((key, im, str(e)[:200]))
            yield pd.DataFrame(out, columns=schema.names)

    return pages.select("key", "image").mapInPandas(run, schema)


PDF = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("pdf", T.BinaryType()), T.StructField("error", T.StringType())])


def searchable_pdf(boxes: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, pdf, error: each source PDF with its regions' text laid invisibly over the pages.

    boxes: doc_id, page, x0, y0, x1, y1, text (points, from overlay_box); sources: doc_id, content.
    """

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame([], columns=PDF.names)
        doc_id = right["doc_id"].iloc[0]
        try:
            import fitz

            with fitz.open(stream=bytes(right["content"].iloc[0]), filetype="pdf") as doc:
                for r in left.sort_values(["page", "y0", "x0"]).itertuples():
                    if r.text and 1 <= r.page <= len(doc):
                        doc[r.page - 1].insert_textbox(fitz.Rect(r.x0, r.y0, r.x1, r.y1), r.text, fontsize=6, render_mode=3)
                return pd.DataFrame([(doc_id, doc.tobytes(), None)], columns=PDF.names)
        except ImportError:
            return pd.DataFrame([(doc_id, None, "no PDF library")], columns=PDF.names)
        except Exception as e:  # noqa: BLE001
            return pd.DataFrame([(doc_id, None, str(e)[:200])], columns=PDF.names)

    return boxes.groupBy("doc_id").cogroup(sources.groupBy("doc_id")).applyInPandas(one, PDF)


def merge_images(images: DataFrame) -> DataFrame:
    """doc_id, pdf, error: one PDF of each document's images (doc_id, ord, content), in order."""

    def one(b: pd.DataFrame) -> pd.DataFrame:
        doc_id = b["doc_id"].iloc[0]
        try:
            import fitz

            with fitz.open() as doc:
                for content in b.sort_values("ord")["content"]:
                    with fitz.open(stream=bytes(content)) as im:
                        doc.insert_pdf(fitz.open("pdf", im.convert_to_pdf()))
                return pd.DataFrame([(doc_id, doc.tobytes(), None)], columns=PDF.names)
        except ImportError:
            return pd.DataFrame([(doc_id, None, "no PDF library")], columns=PDF.names)
        except Exception as e:  # noqa: BLE001
            return pd.DataFrame([(doc_id, None, str(e)[:200])], columns=PDF.names)

    return images.groupBy("doc_id").applyInPandas(one, PDF)


def display_order(text: Column, force: bool = False) -> Column:
    """Lines with Arabic letters reshaped and put in visual order; the text itself where the libraries are missing. For display only."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        import re

        arabic = re.compile("[؀-ۿﭐ-﷿ﹰ-﻿]")
        try:
            import arabic_reshaper
            from bidi.algorithm import get_display
        except ImportError:
            return s
        return s.map(lambda t: t if not t or not (force or arabic.search(t)) else "".join(get_display(arabic_reshaper.reshape(x)) if arabic.search(x) else x for x in t.splitlines(keepends=True)))

    return run(text)
