"""Timings and counts of stages, as log lines."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

FORMAT = "%(asctime)s %(levelname)s %(message)s"


def log_to(path: str | None = None) -> logging.Logger:
    """The library's logger, writing to a file, or to standard error."""
    logger = logging.getLogger("waymark")
    handler = logging.FileHandler(path, encoding="utf-8") if path else logging.StreamHandler()
    handler.setFormatter(logging.Formatter(FORMAT))
    logger.handlers = [handler]
    logger.setLevel(logging.INFO)
    return logger


@contextmanager
def stage(name: str, region: str | None = None) -> Iterator[None]:
    """Log how long what is inside took, in milliseconds."""
    began = time.perf_counter()
    try:
        yield
    finally:
        logging.getLogger("waymark").info("%s%s: %.1f ms", f"region {region}: " if region else "", name, 1000 * (time.perf_counter() - began))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df``, whose rows are counted as an action runs over it; the observation has ``rows`` afterwards."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
