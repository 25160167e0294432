"""ESRI shapefiles: polygons of a .shp file with the attributes of the .dbf file beside it, read in tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shapes(image: bytes) -> Iterator[list[list[tuple[float, float]]] | None]:
    """The rings of each record of a .shp file; None for a null shape."""
    if struct.unpack_from(">i", image)[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(image):
        size = 2 * struct.unpack_from(">i", image, at + 4)[0]
        kind = struct.unpack_from("<i", image, at + 8)[0]
        if kind == 0:
            yield None
        elif kind in (5, 15, 25):
            parts, points = struct.unpack_from("<2i", image, at + 44)
            begin = [*struct.unpack_from(f"<{parts}i", image, at + 52), points]
            flat = struct.unpack_from(f"<{2 * points}d", image, at + 52 + 4 * parts)
            yield [[(flat[2 * k], flat[2 * k + 1]) for k in range(a, b)] for a, b in zip(begin, begin[1:], strict=False)]
        else:
            raise ValueError(f"shape type {kind} is no polygon")
        at += 8 + size


def attributes(image: bytes, encoding: str) -> Iterator[dict[str, str]]:
    """The records of a .dbf file, as text, deleted ones too (they count as shapes do)."""
    n, head, width = struct.unpack_from("<IHH", image, 4)
    fields, at = [], 32
    while image[at] != 0x0D:
        fields.append((image[at : at + 11].split(b"\0")[0].decode(encoding), image[at + 16]))
        at += 32
    for k in range(n):
        place = head + k * width + 1
        row = {}
        for name, size in fields:
            row[name] = image[place : place + size].decode(encoding).strip()
            place += size
        yield row


def polygons(spark: SparkSession, path: str, names: list[str], encoding: str = "utf-8") -> DataFrame:
    """Of all shapefiles under a path, a row per record: file, the attributes named (null where there is no such field)
    and ``poly``, an array of rings of (x, y). A record without a shape has none."""
    images = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(shp|dbf)$"))
    stem, kind = F.regexp_replace("path", r"\.[^.]*$", ""), F.lower(F.regexp_extract("path", r"([^.]*)$", 1))
    pick = lambda x: F.max(F.when(kind == x, F.col("content")))
    pairs = images.groupBy(stem.alias("file")).agg(pick("shp").alias("shp"), pick("dbf").alias("dbf")).where("shp IS NOT NULL")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file, shp, dbf in zip(f["file"], f["shp"], f["dbf"], strict=True):
                found = list(shapes(shp))
                rows = list(attributes(dbf, encoding)) if dbf is not None else [{}] * len(found)
                poly = [None if p is None else [[{"x": x, "y": y} for x, y in ring] for ring in p] for p in found]
                yield pd.DataFrame({"file": file, **{n: [r.get(n) for r in rows] for n in names}, "poly": poly})

    fields = "".join(f"`{n}` string, " for n in names)
    return pairs.mapInPandas(run, f"file string, {fields}poly array<array<struct<x:double,y:double>>>")
