"""Clustering of records into vehicles."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from waymark.functions.scalars import EDIT_GAIN_BEYOND, EDIT_GAINS, SIMILARITY_THRESHOLD, WEIGHT_PLATE, WEIGHT_VEHICLE
from waymark.operators.knn import candidate_lists

K = 129


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in characters."""
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, q in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
    return row[-1]


class Cluster:
    """Running state of one cluster: normalised mean features and counts of plate texts."""

    __slots__ = ("n_plates", "n_vehicles", "name", "plate", "seen", "vehicle")

    def __init__(self, name: int) -> None:
        self.name, self.n_vehicles, self.n_plates = name, 0, 0
        self.vehicle = self.plate = None
        self.seen: dict[str, int] = {}

    def add(self, vehicle: np.ndarray, plate: np.ndarray | None, text: str | None) -> None:
        """Running means of the normalised features, which are not normalised again."""
        self.n_vehicles += 1
        self.vehicle = vehicle if self.vehicle is None else self.vehicle + (vehicle - self.vehicle) / self.n_vehicles
        if plate is not None:
            self.n_plates += 1
            self.plate = plate if self.plate is None else self.plate + (plate - self.plate) / self.n_plates
            if text is not None:
                self.seen[text] = self.seen.get(text, 0) + 1

    def text(self) -> str | None:
        """The most frequent plate text, of several the one seen first."""
        return max(self.seen, key=self.seen.__getitem__) if self.seen else None

    def score(self, vehicle: np.ndarray, plate: np.ndarray | None, text: str | None) -> float:
        v = float(vehicle @ self.vehicle / np.linalg.norm(self.vehicle))
        if plate is None or self.plate is None:
            return min(1.0, max(0.0, v))
        p = float(plate @ self.plate / np.linalg.norm(self.plate))
        mine = self.text()
        gain = _gain(text, mine)
        return min(1.0, max(0.0, WEIGHT_VEHICLE * v + WEIGHT_PLATE * p + gain))


def _unit(v) -> np.ndarray | None:
    if v is None:
        return None
    v = np.asarray(v, np.float64)
    n = np.linalg.norm(v)
    return v / n if n > 0 else None


class _Clusters:
    """The clusters of one region as growing matrices: unnormalised mean features, their lengths, plate texts."""

    def __init__(self) -> None:
        self.n = 0
        self.count = np.zeros((2, 64), np.int64)
        self.mean: list[np.ndarray | None] = [None, None]
        self.length = np.zeros((2, 64))
        self.texts: list[dict[str, int]] = []

    def found(self) -> int:
        if self.n == self.count.shape[1]:
            self.count, self.length = (np.concatenate([x, np.zeros_like(x)], axis=1) for x in (self.count, self.length))
            self.mean = [None if m is None else np.concatenate([m, np.zeros_like(m)]) for m in self.mean]
        self.n += 1
        self.texts.append({})
        return self.n - 1

    def add(self, c: int, features: tuple[np.ndarray | None, np.ndarray | None], text: str | None) -> None:
        for k, x in enumerate(features):
            if x is None:
                continue
            if self.mean[k] is None:
                self.mean[k] = np.zeros((self.count.shape[1], len(x)))
            self.count[k, c] += 1
            self.mean[k][c] += (x - self.mean[k][c]) / self.count[k, c]
            self.length[k, c] = np.sqrt(self.mean[k][c] @ self.mean[k][c])
        if features[1] is not None and text is not None:
            self.texts[c][text] = self.texts[c].get(text, 0) + 1

    def scores(self, of: np.ndarray, features: tuple[np.ndarray, np.ndarray | None], text: str | None) -> np.ndarray:
        cosine = lambda k, c: self.mean[k][c] @ features[k] / self.length[k, c]
        out = cosine(0, of)
        if features[1] is not None:
            both = np.flatnonzero(self.count[1, of])
            if len(both):
                gains = [_gain(text, max(t, key=t.__getitem__) if t else None) for t in (self.texts[c] for c in of[both])]
                out[both] = WEIGHT_VEHICLE * out[both] + WEIGHT_PLATE * cosine(1, of[both]) + gains
        return np.clip(out, 0, 1)


@functools.lru_cache(maxsize=1 << 16)
def _gain(a: str | None, b: str | None) -> float:
    return 0.0 if a is None or b is None else EDIT_GAINS.get(edit_distance(a, b), EDIT_GAIN_BEYOND)


def assign(ids: np.ndarray, vehicles: list, plates: list, texts: list, near: list[np.ndarray], threshold: float) -> np.ndarray:
    """Greedy assignment in order: for each record the id of that which founded its cluster.

    A record looks at the clusters that its candidates are already in, takes the
    best (of equals the older) if it scores above the threshold, or founds one.
    """
    clusters, names, out = _Clusters(), [], np.empty(len(ids), np.int64)
    # clusters by place of the record; candidates that are not in the region or have no cluster yet are -1
    order = np.argsort(ids, kind="stable")
    of = np.full(len(ids) + 1, -1)
    for i in range(len(ids)):
        v, p = _unit(vehicles[i]), _unit(plates[i])
        out[i] = ids[i]
        if v is None:
            continue
        at = np.minimum(np.searchsorted(ids, near[i], sorter=order), len(ids) - 1)
        mine = np.unique(of[order[at][ids[order[at]] == near[i]]])
        mine = mine[mine >= 0]
        chosen = -1
        if len(mine):
            s = clusters.scores(mine, (v, p), texts[i])
            best = int(s.argmax())
            if s[best] > threshold:
                chosen = int(mine[best])
        if chosen < 0:
            chosen = clusters.found()
            names.append(ids[i])
        clusters.add(chosen, (v, p), texts[i])
        of[i], out[i] = chosen, names[chosen]
    return out


def cluster_records(records: DataFrame, k: int = K, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """``records`` (region, record_id, time, vehicle_feature, plate_feature, plate_text) with ``cluster_id``.

    Assignment depends on the order of a region's records, (time, record_id), and
    on clusters as they grow: it is sequential by definition, one task a region.
    The search for candidates, which is most of the work, is not: it runs in tiles
    of bounded size, those of one region against each other. region is a string.
    A cluster is named by the record that founded it. Records without a vehicle
    feature are alone. For one region of unbounded size use cluster_by_threshold.
    """
    near = candidate_lists(records, k, ("vehicle_feature", "plate_feature"), "record_id", by="region")
    lists = near.select(F.col("g").alias("region"), F.col("id").alias("record_id"), F.col("candidates").alias("_near"))
    given = records.join(lists, ["region", "record_id"], "left").select(*records.columns, "_near")
    schema = StructType([*records.schema]).add("cluster_id", LongType())
    names = records.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("time", "ascending"), ("record_id", "ascending")])
        rows = lambda c: [None if x.values is None else x.values.to_numpy(zero_copy_only=False) for x in table.column(c)]
        none = np.zeros(0, np.int64)
        near = [none if x is None else x for x in rows("_near")]
        found = assign(table.column("record_id").to_numpy(), rows("vehicle_feature"), rows("plate_feature"), table.column("plate_text").to_pylist(), near, threshold)
        return table.select(names).append_column("cluster_id", pa.array(found, pa.int64()))

    return given.groupBy("region").applyInArrow(run, schema)


def cluster_by_threshold(records: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """``(record_id, cluster_id)``: components of the pairs with a vehicle similarity above the threshold.

    Another operator than cluster_records, with other clusters: it does not depend
    on an order, and no task sees more than a tile.
    """
    from waymark.operators.components import connected_components
    from waymark.operators.knn import similar_pairs

    of = connected_components(similar_pairs(records, threshold, id_col="record_id", vec="vehicle_feature", spanning=True), "a", "b")
    return records.select("record_id").join(of.withColumnRenamed("node", "record_id"), "record_id", "left").select("record_id", F.coalesce("component", "record_id").alias("cluster_id"))


def summarize(assigned: DataFrame) -> DataFrame:
    """Clusters of assigned records: ``(region, cluster_id, n, centroid_vehicle, centroid_plate, plate_text, records)``.

    records: the members struct<record_id, vehicle_id, camera_id, time> by time.
    """
    from waymark.operators.aggregates import centroid, majority

    keys = ["region", "cluster_id"]
    v = centroid(assigned, keys, "vehicle_feature").withColumnRenamed("centroid", "centroid_vehicle").drop("n")
    p = centroid(assigned, keys, "plate_feature").withColumnRenamed("centroid", "centroid_plate").drop("n")
    text = majority(assigned.where(F.col("plate_feature").isNotNull()), keys, "plate_text", ["time", "record_id"]).drop("n")
    member = F.struct("time", "record_id", "vehicle_id", "camera_id")
    base = assigned.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(member)).alias("records"))
    return base.join(v, keys, "left").join(p, keys, "left").join(text, keys, "left")
