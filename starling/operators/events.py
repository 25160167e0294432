"""Event detection: clusters in an ordered stream of located messages.

A message first tries to make a cluster with parked messages around it; else it joins the first cluster with a centre
near it; else it is parked. A new cluster merges with all whose centres are near. Clusters expire when the whole
stream has moved on from their latest message.

``Fold`` holds these rules for messages in order. ``detect`` runs it in parallel with the same answer: messages interact
only within a radius, so the connected components of occupied cells (at least a radius wide) are folded apart; and
expiry, the one thing that depends on all messages, only needs the time of the message before, wherever it was.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import RADIUS
from ..sources.storage import stored
from .graph import components
from .spatial import around, cells, population_at


def km(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Great-circle distance of two (lat, lon)."""
    (y1, x1), (y2, x2) = (map(math.radians, p) for p in (a, b))
    s = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(s)))


@dataclass(frozen=True)
class Params:
    """Radius in km, and the longest gaps in seconds between messages of a new cluster and after a cluster's latest."""

    radius: float = 10.0
    timediff: float = 1800.0
    maxage: float = 21600.0
    swap_axes: bool = False

    def near(self, a: tuple[float, float], b: tuple[float, float]) -> bool:
        return (km(a[::-1], b[::-1]) if self.swap_axes else km(a, b)) < self.radius


@dataclass
class Cluster:
    """Messages (id, time, place) and the centres they gathered around; several after merges."""

    first: int
    messages: list[tuple]
    centres: list[tuple[float, float]]
    latest: float


@dataclass
class Tally:
    """Stands for a cluster's messages where only their number and times are asked for."""

    n: int
    start: float
    finish: float

    @classmethod
    def of(cls, messages: list[tuple]) -> Tally:
        return cls(len(messages), min(m[1] for m in messages), max(m[1] for m in messages))

    def append(self, m: tuple) -> None:
        self.n, self.start, self.finish = self.n + 1, min(self.start, m[1]), max(self.finish, m[1])

    def __iadd__(self, other: Tally) -> Tally:
        self.n, self.start, self.finish = self.n + other.n, min(self.start, other.start), max(self.finish, other.finish)
        return self


@dataclass
class Fold:
    """The state of one shard of the stream. Times are seconds, messages come in ascending order."""

    params: Params
    active: list[Cluster] = field(default_factory=list)
    old: list[Cluster] = field(default_factory=list)
    parked: list[tuple] = field(default_factory=list)
    tallied: bool = False
    #: The first cluster near a place, of those asked for since the active clusters last changed.
    known: dict[tuple, Cluster | None] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def expire(self, now: float) -> None:
        gone = [c for c in self.active if now - c.latest > self.params.maxage]
        if gone:
            self.known.clear()
            self.old += gone
            self.active = [c for c in self.active if now - c.latest <= self.params.maxage]

    def process(self, id_: int, time: float, place: tuple[float, float], required: int) -> None:
        p = self.params
        self.parked = [m for m in self.parked if time - m[1] <= p.timediff]
        mates = [m for m in self.parked if abs(time - m[1]) < p.timediff and p.near(place, m[2])]
        own = (id_, time, place)
        if len(mates) + 1 >= required:
            taken = {m[0] for m in mates}
            self.parked = [m for m in self.parked if m[0] not in taken]
            members = sorted([*mates, own], key=lambda m: m[1])
            self.active.append(Cluster(id_, Tally.of(members) if self.tallied else members, [place], time))
            self.merge()
            self.known.clear()
            return
        if place not in self.known:
            if len(self.known) >= 10_000:
                self.known.clear()
            self.known[place] = next((c for c in self.active if any(p.near(place, centre) for centre in c.centres)), None)
        if (c := self.known[place]) is not None:
            c.messages.append(own)
            c.latest = max(c.latest, time)
            return
        self.parked.append(own)

    def merge(self) -> None:
        """Only the newest cluster can have new neighbours; all it touches come together in the earliest of them."""
        new = self.active[-1]
        touched = [c for c in self.active[:-1] if any(self.params.near(a, b) for a in c.centres for b in new.centres)]
        if touched:
            survivor, *others = [*touched, new]
            for c in others:
                survivor.messages += c.messages
                survivor.centres += c.centres
                survivor.latest = max(survivor.latest, c.latest)
            dropped = {id(c) for c in others}
            self.active = [c for c in self.active if id(c) not in dropped]


SCHEMA = "status string, cluster_id bigint, messages array<struct<id:bigint,time:double,lat:double,lon:double>>, centres array<struct<lat:double,lon:double>>, start double, finish double"

#: The same with the number of messages in their place.
TALLIED = SCHEMA.replace("array<struct<id:bigint,time:double,lat:double,lon:double>>", "int")


def rows_of(fold: Fold) -> pd.DataFrame:
    """A fold's clusters, and its parked messages as one row each."""
    message = lambda m: {"id": m[0], "time": m[1], "lat": m[2][0], "lon": m[2][1]}
    out = []
    for status, clusters in (("active", fold.active), ("old", fold.old)):
        for c in clusters:
            t = c.messages if fold.tallied else Tally.of(c.messages)
            out.append((status, c.first, t.n if fold.tallied else [message(m) for m in c.messages], [{"lat": a, "lon": b} for a, b in c.centres], t.start, t.finish))
    out += [("unclustered", m[0], 1 if fold.tallied else [message(m)], [], m[1], m[1]) for m in fold.parked]
    return pd.DataFrame(out, columns=["status", "cluster_id", "messages", "centres", "start", "finish"])


def with_required(rows: DataFrame, popfunc: Callable[[Column, Column], Column] | None = None, raster: DataFrame | None = None, grid: dict | None = None, least: int = 10, middle: int = 30) -> DataFrame:
    """rows (lat, lon) with ``required``, how many messages make an event there.

    Either popfunc(lon, lat), a Column, or a population raster (row, col, value) and its grid: then least is required
    where the fewest people live, middle at the median, and a logarithmic curve between. Rows outside have none.
    """
    if (popfunc is None) == (raster is None):
        raise TypeError("give either popfunc or raster")
    if popfunc is not None:
        return rows.withColumn("required", popfunc(F.col("lon"), F.col("lat")).cast("int"))
    low, mid = raster.where("value <> -9999").agg(F.min("value"), F.median("value")).first()
    found = population_at(rows, raster, grid)
    need = F.when(F.col("value").isNotNull(), geo.required(F.col("value"), *geo.curve(low, mid, least, middle), least))
    return found.withColumn("required", need).drop("row", "col", "value")


def with_previous(rows: DataFrame, block: str = "hour") -> DataFrame:
    """rows (ts, id) with ``prev_ts``, the time of the message before among all; windows hold a block at most."""
    rows = rows.withColumn("__b", F.date_trunc(block, "ts"))
    ends = rows.groupBy("__b").agg(F.max("ts").alias("__last"))
    ends = ends.select("__b", F.lag("__last").over(Window.orderBy("__b")).alias("__before"))
    inside = F.lag("ts").over(Window.partitionBy("__b").orderBy("ts", "id"))
    return rows.withColumn("__in", inside).join(ends, "__b").withColumn("prev_ts", F.coalesce("__in", "__before")).drop("__b", "__in", "__last", "__before")


def shards(rows: DataFrame, radius: float, max_lat: float, swap_axes: bool = False) -> DataFrame:
    """rows with ``shard``: the component of their cell among occupied cells that touch."""
    y, x = cells(F.col("lon"), F.col("lat"), radius, 89.0) if swap_axes else cells(F.col("lat"), F.col("lon"), radius, max_lat)
    name = lambda a, b: a.cast("bigint") * 10_000_000 + b.cast("bigint")
    rows = rows.withColumns({"__y": y, "__x": x}).withColumn("__cell", name(F.col("__y"), F.col("__x")))
    seen = rows.select("__y", "__x", "__cell").distinct()
    near = seen.withColumn("d", F.explode(around("y", "x"))).select(F.col("__cell").alias("a"), name(F.col("__y") + F.col("d.d0"), F.col("__x") + F.col("d.d1")).alias("b"))
    links = near.join(seen.select(F.col("__cell").alias("b")), "b").select("a", "b")
    part = components(links).select(F.col("id").alias("__cell"), F.col("component").alias("shard"))
    return rows.join(part, "__cell", "left").withColumn("shard", F.coalesce("shard", "__cell")).drop("__y", "__x", "__cell")


def detect(rows: DataFrame, params: Params = Params(), max_lat: float = 60.0, tallied: bool = False) -> DataFrame:
    """Of messages (id, ts, lat, lon, required), clusters and unclustered messages as in SCHEMA, with their shard.

    Rows with a null among these are left out. A shard is folded in order by one task: that is the rules' nature. Its rows
    stream past in order, so only open clusters and parked messages are held. tallied: as in TALLIED, with the number of
    messages only; otherwise a cluster's messages are held until it ends, for they are one row.
    """
    rows = rows.select("id", "ts", "lat", "lon", "required").na.drop()
    rows = stored(shards(with_previous(rows), params.radius, max_lat, params.swap_axes))
    end = rows.agg((F.unix_micros(F.max("ts")) / 1e6).alias("end"))
    seconds = lambda c: (F.unix_micros(c) / 1e6).alias(c)
    rows = rows.select("shard", "id", seconds("ts"), seconds("prev_ts"), "lat", "lon", "required").join(F.broadcast(end), F.lit(True))  # one row

    def some(fold: Fold, shard: int) -> pd.DataFrame:
        out = rows_of(fold)
        out.insert(0, "shard", shard)
        return out

    def last(fold: Fold, shard: int, end: float) -> pd.DataFrame:
        fold.expire(end)
        fold.parked = [m for m in fold.parked if end - m[1] <= params.timediff]  # the stream moved on elsewhere
        return some(fold, shard)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = shard = end = None
        for f in frames:
            for r in f.itertuples(index=False):
                if fold is None or r.shard != shard:
                    if fold is not None:
                        yield last(fold, shard, end)
                    fold, shard, end = Fold(params, tallied=tallied), r.shard, r.end
                if r.prev_ts == r.prev_ts:
                    fold.expire(r.prev_ts)
                fold.process(int(r.id), r.ts, (r.lat, r.lon), int(r.required))
            if fold is not None and fold.old:
                yield some(Fold(params, old=fold.old, tallied=tallied), shard)
                fold.old = []
        if fold is not None:
            yield last(fold, shard, end)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "shard").sortWithinPartitions("shard", "ts", "id")
    return rows.mapInPandas(run, f"shard bigint, {TALLIED if tallied else SCHEMA}")


@dataclass(frozen=True)
class EventDetection:
    """Population-aware detection as one operator: where the coordinates are, how many messages make an event, and Params.

    Exactly one of popfunc, a function (lon, lat) -> Column, and popmap, a population raster (row, col, value) with its
    grid. field: an array or struct path that holds (lat, lon); swap_axes where it holds (lon, lat).
    """

    field: str = "geo.coordinates"
    tsfield: str = "ts"
    key: str = "id"
    popfunc: Callable[[Column, Column], Column] | None = None
    popmap: DataFrame | None = None
    grid: dict | None = None
    mincount: int = 10
    mediancount: int = 30
    params: Params = Params()

    def __post_init__(self) -> None:
        if (self.popfunc is None) == (self.popmap is None):
            raise TypeError("give either popfunc or popmap")

    def located(self, rows: DataFrame) -> DataFrame:
        """(id, ts, lat, lon) of messages that have both a place and a time."""
        place = F.col(self.field)
        a, b = (1, 0) if self.params.swap_axes else (0, 1)
        rows = rows.select(F.col(self.key).alias("id"), F.col(self.tsfield).alias("ts"), place[a].cast("double").alias("lat"), place[b].cast("double").alias("lon"))
        return rows.na.drop()

    def messages(self, rows: DataFrame) -> DataFrame:
        """located() with ``required``; rows outside the raster have none and are no part of any event."""
        return with_required(self.located(rows), self.popfunc, self.popmap, self.grid, self.mincount, self.mediancount)

    def run(self, rows: DataFrame, max_lat: float = 60.0, tallied: bool = False) -> DataFrame:
        """Clusters and unclustered messages, as detect() gives them."""
        return detect(self.messages(rows), replace(self.params, swap_axes=False), max_lat, tallied)


def serial(messages: Iterator[tuple], params: Params) -> Fold:
    """All messages (id, time, place, required), in order, in one fold: what detect() must agree with."""
    fold = Fold(params)
    for m in messages:
        fold.process(*m)
        fold.expire(m[1])
    return fold
