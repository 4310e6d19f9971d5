"""Record, cluster, camera and trajectory files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.vectors import decode_feature, zero_to_null

DIMENSION = 64
RAW = "record_id string, vehicle_id long, camera_id long, car_feature string, plate_feature string, plate_text string, time long"
CLUSTER = (
    "cluster_id string, centroid_vehicle_feature array<float>, centroid_license_plate_feature array<float>, "
    "centroid_license_plate_text string, node_path array<long>, "
    "records array<struct<record_id:string,vehicle_id:long,camera_id:long,time:long>>"
)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a record file as they are: JSON with the fields of RAW, missing ones null."""
    return spark.read.schema(RAW).json(path)


def decode(raw: DataFrame) -> DataFrame:
    """Records with ``vehicle_feature`` and ``plate_feature`` decoded; zeros mean no feature, and no plate feature means no text."""
    plate = zero_to_null(decode_feature(F.col("plate_feature")))
    out = raw.select("record_id", "vehicle_id", "camera_id", "time", zero_to_null(decode_feature(F.col("car_feature"))).alias("vehicle_feature"), plate.alias("plate_feature"), "plate_text")
    return out.withColumn("plate_text", F.when(F.col("plate_feature").isNotNull(), F.col("plate_text")))


def project(records: DataFrame, feature: str, dimension: int = DIMENSION) -> DataFrame:
    """``records`` with the feature centred and projected on its principal components, fitted on all rows that have it; as it is if fewer than two have."""
    has = records.where(F.col(feature).isNotNull())
    first = has.select(F.size(feature).alias("n")).first()
    rows = has.limit(max(2, dimension)).count()
    if rows < 2:
        return records
    k = min(dimension, first["n"], rows)
    vectors = records.withColumn("_v", F.when(F.col(feature).isNotNull(), array_to_vector(F.col(feature).cast("array<double>"))))
    some = vectors.where("_v IS NOT NULL")
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(some)
    pca = PCA(k=k, inputCol="_c", outputCol="_p").fit(scaler.transform(some))
    done = pca.transform(scaler.transform(some)).withColumn(feature, vector_to_array("_p", "float32")).drop("_v", "_c", "_p")
    return done.unionByName(records.where(F.col(feature).isNull()).withColumn(feature, F.lit(None).cast("array<float>")))


def read_records(spark: SparkSession, path: str, dimension: int | None = DIMENSION) -> DataFrame:
    """Decoded records; dimension: of the projected features, None to leave them."""
    out = decode(read_raw(spark, path))
    return out if dimension is None else project(project(out, "vehicle_feature", dimension), "plate_feature", dimension)


def annotated(records: DataFrame) -> DataFrame:
    """Records whose vehicle is known."""
    return records.where("vehicle_id IS NOT NULL")


def in_regions(records: DataFrame, region_cameras: DataFrame) -> DataFrame:
    """``records`` with ``region``: one row for each region, main or auxiliary, that has the record's camera."""
    return records.join(region_cameras.select("region", "camera_id"), "camera_id")


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """``(camera_id, x, y)`` of a camera file with fields camera_id and position."""
    return spark.read.schema("camera_id long, position array<double>").json(path).select("camera_id", F.col("position")[0].alias("x"), F.col("position")[1].alias("y"))


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """``(vehicle_id, points, start, stop, duration)`` of a trajectory file; points struct<t, x, y> by time."""
    raw = spark.read.schema("vehicle_id long, xyt array<array<double>>").json(path)
    points = F.array_sort(F.transform("xyt", lambda p: F.struct(p[2].alias("t"), p[0].alias("x"), p[1].alias("y"))))
    out = raw.select("vehicle_id", points.alias("points"))
    start, stop = F.col("points")[0]["t"], F.element_at("points", -1)["t"]
    return out.select("vehicle_id", "points", start.alias("start"), stop.alias("stop"), (stop - start).alias("duration"))


def read_nodes_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(node_id, x, y)`` of a CSV file with header NodeID, Longitude, Latitude."""
    return spark.read.schema("NodeID long, Longitude double, Latitude double").csv(path, header=True).select(F.col("NodeID").alias("node_id"), F.col("Longitude").alias("x"), F.col("Latitude").alias("y"))


def read_map_document(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """``(node_id, x, y)`` of a map document: one JSON array of {id, type, xy}; entries of type node, of those in ids (node_id) if given."""
    raw = spark.read.schema("id long, type string, xy array<double>").option("multiLine", True).json(path)
    nodes = raw.where("type = 'node'").select(F.col("id").alias("node_id"), F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))
    return nodes if ids is None else nodes.join(ids.select("node_id").distinct(), "node_id", "left_semi")


def write_clusters(clusters: DataFrame, path: str, one_array: bool = False) -> None:
    """Fields of CLUSTER; no plate: an empty centroid and text. One JSON object a line.

    one_array: a single file that is one JSON array, as other tools read. It is written
    by one task, a row after another, so keep it for results that fit one file.
    """
    plate = F.coalesce("centroid_license_plate_feature", F.array().cast("array<float>"))
    text = F.coalesce("centroid_license_plate_text", F.lit(""))
    shaped = clusters.withColumn("centroid_license_plate_feature", plate).withColumn("centroid_license_plate_text", text)
    shaped = shaped.select([c.split()[0] for c in ("cluster_id", "centroid_vehicle_feature", "centroid_license_plate_feature", "centroid_license_plate_text", "node_path", "records")])
    if not one_array:
        shaped.write.json(path)
        return
    if shaped.isEmpty():
        shaped.sparkSession.sql("SELECT '[]' AS value").write.text(path)
        return
    lines = shaped.select("cluster_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).sortWithinPartitions("cluster_id").select("value")

    def bracket(batches):
        last = None
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        for b in batches:
            for value in b.column(0).to_pylist():
                if last is not None:
                    yield pa.RecordBatch.from_pydict({"value": [last + ","]})
                last = value
        yield pa.RecordBatch.from_pydict({"value": [*([last] if last is not None else []), "]"]})

    lines.mapInArrow(bracket, "value string").write.text(path)


def read_clusters(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """Clusters from JSON lines, or from a file that is one JSON array; empty plate fields are null, an empty path stays empty."""
    raw = spark.read.schema(CLUSTER).option("multiLine", one_array).json(path)
    plate = F.when(F.size("centroid_license_plate_feature") > 0, F.col("centroid_license_plate_feature"))
    return raw.withColumn("centroid_license_plate_feature", plate).withColumn("centroid_license_plate_text", F.nullif("centroid_license_plate_text", F.lit("")))


def fan_out(records: DataFrame, outputs: dict[str, F.Column]) -> None:
    """One JSON-lines file set for each (path, predicate); the scan of a stored table is shared by pushdown, not by a cache."""
    for path, predicate in outputs.items():
        records.where(predicate).write.json(path)
