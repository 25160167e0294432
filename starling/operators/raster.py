"""Stacking of weighted polygons on a raster, and the answer where weights are highest.

Cells are integer columns and rows; a cell belongs to a polygon if its centre is inside or an edge point falls in it.
The stack is the highest weight inside an indicator, the sum over indicators, the cells within a share of the best, and
once more around them on a finer raster. ``covered`` and what follows it do this by joins and aggregates over
(message, cell) rows; ``infer`` and ``results`` stack each key's polygons in one worker, so that no cells are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.storage import stored


def to_grid(lon: Column, lat: Column, scale: float | Column) -> tuple[Column, Column]:
    """(gx, gy) of a point on the world raster: gx counts from -180 eastward, gy from 90 southward."""
    return F.floor((lon + 180) * scale).cast("int"), F.floor((F.lit(90) - lat) * scale).cast("int")


def cell_corner(gx: Column, gy: Column, scale: float | Column) -> tuple[Column, Column]:
    """(lon, lat) of a cell's north-western corner."""
    return gx / scale - 180, F.lit(90) - gy / scale


def focus(area: Column) -> Column:
    """Cells to a degree for an area in square degrees."""
    return F.floor(F.pow(F.ceil(F.lit(64800.0) / area).cast("double"), F.lit(0.4))).cast("int")


def covered(evidence: DataFrame, scale: float | str, bounds: bool = False) -> DataFrame:
    """Rows (key, indicator, weight, gx, gy): the cells of each polygon of evidence (key, indicator, ring, weight).

    scale: cells to a degree, a number or a column. bounds: keep to columns bx0, by0, bx1, by1 of the rows. Many rows
    share a polygon (a country's, a zone's), so each ring is rasterised once for each scale and box, inside the box, then
    joined.
    """
    s = F.col(scale) if isinstance(scale, str) else F.lit(float(scale))
    evidence = evidence.withColumns({"__s": s.cast("double"), "__r": F.xxhash64("ring")})
    column = lambda x: F.floor((x + 180) * F.col("__s")).cast("int")
    row = lambda y: F.floor((F.lit(90) - y) * F.col("__s")).cast("int")
    shape = ["__r", "__s", *(["bx0", "by0", "bx1", "by1"] if bounds else [])]
    e = evidence.groupBy(*shape).agg(F.first("ring").alias("ring"))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    e = e.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})
    most = lambda f, *cs: f(*[F.col(c) for c in cs]) if bounds else F.col(cs[0])
    span = lambda a, b: F.explode(F.when(a <= b, F.sequence(a, b)))
    e = e.withColumn("gx", span(column(most(F.greatest, "x0", "bx0")), column(most(F.least, "x1", "bx1"))))
    e = e.withColumn("gy", span(row(most(F.least, "y1", "by1")), row(most(F.greatest, "y0", "by0"))))
    lon, lat = cell_corner(F.col("gx") + 0.5, F.col("gy") + 0.5, F.col("__s"))
    corner = lambda p: (column(p["x"]) == F.col("gx")) & (row(p["y"]) == F.col("gy"))
    cells = e.where(geo.inside(lon, lat, F.col("ring")) | F.exists("ring", corner)).select(*shape, "gx", "gy")
    return evidence.drop("ring").join(cells, shape).drop("__r", "__s")


def stacked(cells: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(key, gx, gy, weight): the highest weight of each indicator, summed over indicators."""
    keep = keep or []
    best = cells.groupBy("key", *keep, "indicator", "gx", "gy").agg(F.max("weight").alias("weight"))
    return best.groupBy("key", *keep, "gx", "gy").agg(F.sum("weight").alias("weight"))


def top_cells(stack: DataFrame, share: float = 0.75) -> DataFrame:
    """The cells of each key with at least a share of its best weight, with ``best``."""
    best = F.max("weight").over(Window.partitionBy("key"))
    return stack.withColumn("best", best).where(F.col("weight") >= F.col("best") * share - 1e-9)


def bounds_of(cells: DataFrame, scale: float, pad: float = 2.0) -> DataFrame:
    """(key, bx0, by0, bx1, by1, area): the box around each key's cells, padded, inside the world."""
    box = cells.groupBy("key").agg(F.min("gx").alias("a"), F.max("gx").alias("b"), F.min("gy").alias("c"), F.max("gy").alias("d"))
    box = box.select(
        "key", F.greatest(F.lit(-180.0), F.col("a") / scale - 180 - pad).alias("bx0"), F.greatest(F.lit(-90.0), F.lit(90) - (F.col("d") + 1) / scale - pad).alias("by0"),
        F.least(F.lit(180.0), (F.col("b") + 1) / scale - 180 + pad).alias("bx1"), F.least(F.lit(90.0), F.lit(90) - F.col("c") / scale + pad).alias("by1"),
    )
    return box.withColumn("area", (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")))


def mask_of(x: np.ndarray, y: np.ndarray, s: float, box: tuple | None = None) -> tuple[int, int, np.ndarray] | None:
    """(first column, first row, mask by row and column) of a ring's cells as covered() has them, inside a box; None without any."""
    fine = ~(np.isnan(x) | np.isnan(y))
    if not fine.any():
        return None
    x0, x1, y0, y1 = np.nanmin(x), np.nanmax(x), np.nanmin(y), np.nanmax(y)
    if box is not None:
        x0, x1, y0, y1 = max(x0, box[0]), min(x1, box[2]), max(y0, box[1]), min(y1, box[3])
    column, row = lambda v: np.floor((v + 180) * s).astype(np.int64), lambda v: np.floor((90 - v) * s).astype(np.int64)
    ca, cb, ra, rb = int(column(x0)), int(column(x1)), int(row(y1)), int(row(y0))
    if ca > cb or ra > rb:
        return None
    lon, lat = (np.arange(ca, cb + 1) + 0.5) / s - 180, 90 - (np.arange(ra, rb + 1) + 0.5) / s
    ax, ay = np.append(x[1:], x[0]), np.append(y[1:], y[0])
    mask = np.zeros((len(lat), len(lon)), bool)
    with np.errstate(all="ignore"):
        crossed = (y[:, None] > lat) != (ay[:, None] > lat)
        at = (ax - x)[:, None] * (lat - y[:, None]) / (ay - y)[:, None] + x[:, None]
        if crossed.size * len(lon) < 1 << 18:
            mask = np.logical_xor.reduce(crossed[:, :, None] & (lon < at[:, :, None]), axis=0)
        else:
            for k in np.flatnonzero(crossed.any(axis=1)):
                mask ^= crossed[k][:, None] & (lon < at[k][:, None])
    gx, gy = column(x[fine]) - ca, row(y[fine]) - ra
    own = (gx >= 0) & (gx < len(lon)) & (gy >= 0) & (gy < len(lat))
    mask[gy[own], gx[own]] = True
    return ca, ra, mask


def stack_of(rings: list[tuple], s: float, share: float, box: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """(gx, gy, weight, best) of the top cells of one key's rings (indicator, x, y, weight); None where no cell is covered."""
    masks = [(name, weight, m) for name, x, y, weight in rings if (m := mask_of(x, y, s, box)) is not None and m[2].any()]
    if not masks:
        return None
    c0, r0 = min(m[0] for *_, m in masks), min(m[1] for *_, m in masks)
    shape = (max(m[1] + m[2].shape[0] for *_, m in masks) - r0, max(m[0] + m[2].shape[1] for *_, m in masks) - c0)
    total, any_ = np.zeros(shape), np.zeros(shape, bool)
    for name in sorted({m[0] for m in masks}):
        best = np.full(shape, -np.inf)
        for _, weight, (c, r, m) in (m for m in masks if m[0] == name):
            part = best[r - r0 : r - r0 + m.shape[0], c - c0 : c - c0 + m.shape[1]]
            part[m] = np.maximum(part[m], weight)
        seen = best > -np.inf
        total[seen] += best[seen]
        any_ |= seen
    top = float(total[any_].max())
    gy, gx = np.nonzero(any_ & (total >= top * share - 1e-9))
    return (gx + c0).astype(np.int32), (gy + r0).astype(np.int32), total[gy, gx], top


def answer_of(rings: list[tuple], coarse: float, share: float, pad: float = 2.0) -> tuple | None:
    """(scale, gx, gy, weight, best): what covered(), stacked(), top_cells(), bounds_of() and focus() give for one key."""
    if (found := stack_of(rings, coarse, share)) is None:
        return None
    gx, gy = found[:2]
    box = (max(-180.0, int(gx.min()) / coarse - 180 - pad), max(-90.0, 90 - (int(gy.max()) + 1) / coarse - pad), min(180.0, (int(gx.max()) + 1) / coarse - 180 + pad), min(90.0, 90 - int(gy.min()) / coarse + pad))
    scale = math.floor(math.pow(math.ceil(64800.0 / ((box[2] - box[0]) * (box[3] - box[1]))), 0.4))
    if (found := stack_of(rings, float(scale), share, box)) is None:
        return None
    return scale, *found


def contours(gx: np.ndarray, gy: np.ndarray, scale: int, half: float = 0.51) -> list[list[tuple[float, float]]]:
    """The closed outlines, without their last point, of the union of squares around cells, each half a cell and a little wide.

    Squares overlap with those of all eight neighbours, so cells that meet at a corner are one piece; holes have an
    outline of their own. Outer ones run counterclockwise, holes clockwise; only corners are given. Sorted.
    """
    c0, r0 = int(gx.min()) - 1, int(gy.min()) - 1
    full = np.zeros((int(gy.max()) - r0 + 2, int(gx.max()) - c0 + 2), bool)
    full[gy - r0, gx - c0] = True
    right = lambda d: (d[1], -d[0])
    ways: dict[tuple, list] = {}  # sides by their first corner, as steps (row, column) with the cell on the left
    for beyond, (i, j), step in (((-1, 0), (0, 1), (0, -1)), ((0, -1), (0, 0), (1, 0)), ((1, 0), (1, 0), (0, 1)), ((0, 1), (1, 1), (-1, 0))):
        for r, c in zip(*(v.tolist() for v in np.nonzero(full & ~np.roll(full, (-beyond[0], -beyond[1]), (0, 1))))):
            ways.setdefault((r + i, c + j), []).append(step)
    left, out = {(at, step) for at, steps in ways.items() for step in steps}, []
    while left:
        side, ring = left.pop(), []
        first = side
        while True:
            (r, c), step = side
            at = (r + step[0], c + step[1])
            turn = right(step) if right(step) in ways[at] else ways[at][0]  # cells that meet at a corner: over to the other one
            if turn != step:
                dy, dx = (half - 0.5) * (right(step)[0] + right(turn)[0]), (half - 0.5) * (right(step)[1] + right(turn)[1])
                ring.append(((at[1] + c0 + dx) / scale - 180, 90 - (at[0] + r0 + dy) / scale))
            side = (at, turn)
            if side == first:
                break
            left.remove(side)
        k = ring.index(min(ring))
        out.append(ring[k:] + ring[:k])
    return sorted(out)


RING = "array<struct<x:double,y:double>>"
POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
#: What a key's answer comes out as: its cells, figures of them, or these and its outlines.
KINDS = {
    "cells": ("gx array<int>, gy array<int>, weight array<double>", [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())]),
    "figures": ("cells bigint, gx int, gy int", [pa.int64(), pa.int32(), pa.int32()]),
    "contours": (f"cells bigint, poly array<{RING}>", [pa.int64(), pa.list_(POINTS)]),
}


def worked(evidence: DataFrame, coarse: float, share: float, kind: str) -> DataFrame:
    """(key, inds, polys, scale, best, columns of KINDS): the answer of each key with evidence, and what it rests on.

    Keys with the same evidence (people of one zone, country and so on) have the same answer, so only the first of
    them is worked out, and the others are given its. Sameness is of a 64-bit and a 128-bit hash of the sorted evidence.
    """
    evidence = stored(evidence)  # read twice below, and it may be many joins
    facts = F.sort_array(F.collect_list(F.struct("indicator", F.xxhash64("ring").alias("a"), F.hash("ring").alias("b"), "weight")))
    same = evidence.groupBy("key").agg(facts.alias("facts"))
    counts = [F.size(F.array_distinct("facts.indicator")).cast("bigint").alias("inds"), F.size("facts").cast("bigint").alias("polys")]
    same = same.select("key", F.xxhash64("facts").alias("s"), F.md5(F.to_json("facts")).alias("t"), *counts)
    first = same.groupBy("s", "t").agg(F.min("key").alias("first"))
    same = stored(same.join(first, ["s", "t"]).select("key", "first", "inds", "polys"))
    own = evidence.join(same.where("key = first").select("key"), "key", "left_semi")
    own = own.groupBy(F.col("key").alias("first")).agg(F.sort_array(F.collect_list(F.struct("indicator", "weight", "ring"))).alias("e"))
    flat = lambda c: F.flatten(F.transform("e", lambda f: f["ring"][c])).alias(c)
    own = own.select("first", F.col("e.indicator").alias("names"), F.col("e.weight").alias("weights"), F.transform("e", lambda f: F.size(f["ring"])).alias("sizes"), flat("x"), flat("y"))
    columns, types = KINDS[kind]
    schema = pa.schema([("scale", pa.int32()), ("best", pa.float64()), *zip([c.split()[0] for c in columns.split(", ")], types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            firsts, out, held = [], [], 0
            numbers = lambda name: [np.asarray(v.values.to_numpy(zero_copy_only=False), float) for v in b.column(name)]
            names, weights, sizes = (b.column(c).to_pylist() for c in ("names", "weights", "sizes"))
            for k, (x, y) in enumerate(zip(numbers("x"), numbers("y"))):
                ends = np.cumsum([0, *sizes[k]])
                rings = [(n, x[i:j], y[i:j], w) for n, w, i, j in zip(names[k], weights[k], ends, ends[1:]) if j > i and w is not None]
                if (found := answer_of(rings, coarse, share)) is None:
                    continue
                scale, gx, gy, weight, best = found
                firsts.append(k)
                rest = {"cells": lambda: (gx, gy, weight), "figures": lambda: (len(gx), int(gx.min()), int(gy.min())), "contours": lambda: (len(gx), [[{"x": p, "y": q} for p, q in ring] for ring in contours(gx, gy, scale)])}[kind]()  # noqa: B023
                out.append((scale, best, *rest))
                held += len(gx)
                if held > 1 << 18:
                    yield batch(b, firsts, out)
                    firsts, out, held = [], [], 0
            if out:
                yield batch(b, firsts, out)

    def batch(b: pa.RecordBatch, firsts: list[int], out: list[tuple]) -> pa.RecordBatch:
        own = b.column("first").take(pa.array(firsts, pa.int64()))
        return pa.RecordBatch.from_arrays([own, *(pa.array(list(c), f.type) for c, f in zip(zip(*out), schema))], ["first", *schema.names])

    key = own.schema["first"].dataType.simpleString()
    answer = own.mapInArrow(run, f"first {key}, scale int, best double, {columns}")
    return same.join(answer, "first").drop("first")


def infer(evidence: DataFrame, coarse: float = 0.5, share: float = 0.75) -> DataFrame:
    """(key, scale, gx, gy, weight, best): the finest answer cells of each key; keys without evidence have none."""
    found = worked(evidence, coarse, share, "cells")
    return found.select("key", "scale", "best", F.explode(F.arrays_zip("gx", "gy", "weight")).alias("c")).select("key", "scale", "c.gx", "c.gy", "c.weight", "best")


def figures(evidence: DataFrame, coarse: float = 0.5, share: float = 0.75) -> DataFrame:
    """(key, scale, cells, gx, gy, best): how many answer cells each key has, their least column and row."""
    return worked(evidence, coarse, share, "figures").select("key", "scale", "cells", "gx", "gy", "best")


def results(evidence: DataFrame, coarse: float = 0.5, share: float = 0.75) -> DataFrame:
    """(key, poly, weight, inds, polys): the outlines of each key's answer, its threshold, how many indicators and polygons it rests on."""
    return worked(evidence, coarse, share, "contours").select("key", "poly", (F.col("best") * share).alias("weight"), "inds", "polys")


def squares(cells: DataFrame) -> DataFrame:
    """cells with ``ring``: a square around each cell's centre, half a cell and a little wide."""
    lon, lat = cell_corner(F.col("gx") + 0.5, F.col("gy") + 0.5, F.col("scale").cast("double"))
    half = F.lit(0.51) / F.col("scale")
    return cells.withColumn("ring", geo.square(lon - half, lat - half, lon + half, lat + half))
