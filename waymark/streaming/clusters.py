"""Greedy clustering of a stream of records, with clusters kept as state between batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.functions.scalars import SIMILARITY_THRESHOLD
from waymark.operators.clustering import Cluster, _unit

OUT = "region string, record_id long, cluster_id long"


def _pack(clusters: list[Cluster]) -> bytes:
    return pickle.dumps([(c.name, c.n_vehicles, c.n_plates, c.vehicle, c.plate, c.seen) for c in clusters])


def _unpack(data: bytes) -> list[Cluster]:
    out = []
    for name, n, m, vehicle, plate, seen in pickle.loads(data):
        c = Cluster(name)
        c.n_vehicles, c.n_plates, c.vehicle, c.plate, c.seen = n, m, vehicle, plate, seen
        out.append(c)
    return out


def cluster_stream(records: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """OUT for records (region, record_id, time, vehicle_feature, plate_feature, plate_text) as they come.

    Each region's clusters are its state. Within a batch records are taken by
    (time, record_id); each is scored against all clusters of its region, where the
    batch operator looks only at those of its nearest records. A record without a
    vehicle feature is alone. State grows with a region's clusters: use regions.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clusters = _unpack(state.get[0]) if state.exists else []
        batch = pd.concat(list(frames)).sort_values(["time", "record_id"])
        named = []
        for r in batch.itertuples():
            v, p = _unit(r.vehicle_feature), _unit(r.plate_feature)
            text = r.plate_text if isinstance(r.plate_text, str) else None
            scores = [c.score(v, p, text) for c in clusters] if v is not None else []
            best = int(np.argmax(scores)) if scores else -1
            if best < 0 or scores[best] <= threshold:
                chosen = Cluster(int(r.record_id))
                if v is not None:
                    clusters.append(chosen)
            else:
                chosen = clusters[best]
            if v is not None:
                chosen.add(v, p, text)
            named.append(chosen.name)
        state.update((_pack(clusters),))
        yield pd.DataFrame({"region": key[0], "record_id": batch["record_id"].astype("int64"), "cluster_id": named})

    return records.groupBy("region").applyInPandasWithState(update, OUT, "clusters binary", "append", GroupStateTimeout.NoTimeout)
