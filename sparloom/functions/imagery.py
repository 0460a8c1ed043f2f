"""Measures of decoded pixels and of image headers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def difference_hash(pixels: Column) -> Column:
    """64 bits of 9 x 8 grey values, row by row: a bit is set where a pixel is brighter than its right neighbour."""
    places = F.sequence(F.lit(0), F.lit(63))
    brighter = lambda k: F.get(pixels, (k / 8).cast("int") * 9 + k % 8) > F.get(pixels, (k / 8).cast("int") * 9 + k % 8 + 1)
    return F.aggregate(places, F.lit(0).cast("long"), lambda h, k: F.shiftleft(h, 1).bitwiseOR(F.when(brighter(k), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def hash_text(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def color_metrics(pixels: Column) -> Column:
    """Struct of an array of (r, g, b) pixels from 0 to 255: mean saturation, colourfulness (mean standard
    deviation of the channels plus the spread of their means) and whether the image is coloured."""
    n = F.size(pixels).cast("double")
    mean = lambda f: F.aggregate(F.transform(pixels, f), F.lit(0.0), lambda s, x: s + x) / n
    value = lambda p: F.greatest(p["r"], p["g"], p["b"])
    saturation = mean(lambda p: F.when(value(p) > 0, (value(p) - F.least(p["r"], p["g"], p["b"])) / value(p)).otherwise(0.0).cast("double"))
    channel = lambda c, k: mean(lambda p: F.pow(p[c].cast("double"), F.lit(k)))
    means = [channel(c, 1) for c in "rgb"]
    spreads = [F.sqrt(F.greatest(F.lit(0.0), channel(c, 2) - m * m)) for c, m in zip("rgb", means, strict=True)]
    colorfulness = (spreads[0] + spreads[1] + spreads[2]) / 3 + (F.greatest(*means) - F.least(*means))
    return F.struct(saturation.alias("sat_mean"), colorfulness.alias("colorfulness"), ((saturation >= 0.08) & (colorfulness >= 18.0)).alias("likely_color"))


def _size(data: bytes) -> tuple[int, int] | None:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind in range(0xC0, 0xD0) and kind not in (0xC4, 0xC8, 0xCC):
            return struct.unpack(">HH", data[at + 5 : at + 9])[::-1]
        at += 2 if kind == 0xFF or 0xD0 <= kind <= 0xD9 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


@F.pandas_udf(StructType().add("width", "integer").add("height", "integer"))
def image_size(content: pd.Series) -> pd.DataFrame:
    """Pixel size from the header of a PNG, GIF or JPEG file; null for anything else."""
    found = [_size(bytes(c)) if c is not None else None for c in content]
    return pd.DataFrame({"width": pd.array([f and f[0] for f in found], "Int32"), "height": pd.array([f and f[1] for f in found], "Int32")})


def data_url(content: Column, path: Column) -> Column:
    """The file as a base64 data URL in one line (Spark's base64 breaks lines after 76 characters), its type by the
    extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    mime = F.when(ext == "png", "image/png").when(ext == "webp", "image/webp").when(ext == "gif", "image/gif").otherwise("image/jpeg")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))
