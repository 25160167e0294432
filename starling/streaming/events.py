"""Event detection on a stream: a fold per region, kept as state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import SCHEMA, Fold, Params, rows_of


def stream_clusters(stream: DataFrame, params: Params = Params(), region: str = "region") -> DataFrame:
    """Of a stream of messages (region, id, ts, lat, lon, required), after each batch the clusters of its regions.

    Regions must lie more than a radius apart. Messages of a batch are put in order; those older than what a region
    has seen are late and left out, as the rules need ascending time. Expiry follows the region's own clock. State is
    the fold itself; parked messages and expired clusters leave it, so it stays as small as what is active.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, fold = pickle.loads(state.get[0]) if state.exists else (float("-inf"), Fold(params))
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        for r in rows.itertuples(index=False):
            now = r.ts.timestamp()
            if now < clock:
                continue
            fold.process(int(r.id), now, (r.lat, r.lon), int(r.required))
            fold.expire(now)
            clock = now
        out = rows_of(fold)
        fold.old = []
        state.update((pickle.dumps((clock, fold)),))
        out.insert(0, region, key[0])
        yield out

    rows = stream.select(region, "id", "ts", "lat", "lon", "required").na.drop()
    kind = dict(stream.dtypes)[region]
    return rows.groupBy(region).applyInPandasWithState(run, f"{region} {kind}, {SCHEMA}", "state binary", "update", GroupStateTimeout.NoTimeout)
