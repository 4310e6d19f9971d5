"""Scores, identifiers and region names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.vectors import clip, cosine_similarity

# Weights and thresholds of the reconstruction.
WEIGHT_VEHICLE = 0.2
WEIGHT_PLATE = 0.8
SIMILARITY_THRESHOLD = 0.85
MERGING_THRESHOLD = 0.6
MERGE_DECAY = 0.8
#: Gain by edit distance of two plate texts, and of all larger distances.
EDIT_GAINS = {0: 0.2, 1: 0.05, 2: 0.0, 3: -0.05}
EDIT_GAIN_BEYOND = -0.1


def edit_distance_gain(a: Column, b: Column) -> Column:
    """What the edit distance of two plate texts adds to a score; 0 where a text is missing."""
    d = F.levenshtein(a, b)
    gain = F.when(d.isNull(), 0.0)
    for distance, value in EDIT_GAINS.items():
        gain = gain.when(d == distance, value)
    return gain.otherwise(EDIT_GAIN_BEYOND)


def record_cluster_score(vehicle: Column, plate: Column, text: Column, c_vehicle: Column, c_plate: Column, c_text: Column) -> Column:
    """Similarity of a record to a cluster: of vehicle features alone, unless both have a plate."""
    v = cosine_similarity(vehicle, c_vehicle)
    both = WEIGHT_VEHICLE * v + WEIGHT_PLATE * cosine_similarity(plate, c_plate) + edit_distance_gain(text, c_text)
    return F.when(plate.isNotNull() & c_plate.isNotNull(), clip(both)).otherwise(clip(v))


def merge_score(common: Column, apart: Column, decay: float = MERGE_DECAY) -> Column:
    """decay ** apart * logistic(common); null without a common record. Does not overflow."""
    return F.when(common > 0, F.pow(F.lit(decay), apart) / (1 + F.exp(-common.cast("double"))))


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID as 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def region_name(i: Column, j: Column | None = None) -> Column:
    """'i' of a main region, 'i-j' of an auxiliary one."""
    return i.cast("string") if j is None else F.concat_ws("-", i.cast("string"), j.cast("string"))


def region_ends(name: Column) -> Column:
    """The numbers in a region's name: one of a main region, two of an auxiliary one."""
    return F.transform(F.split(name, "-"), lambda x: x.cast("int"))


def null_if_unset(v: Column) -> Column:
    """-1 on the wire means null."""
    return F.nullif(v, F.lit(-1))


def unset_if_null(v: Column) -> Column:
    return F.coalesce(v, F.lit(-1))
