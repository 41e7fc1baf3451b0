"""Counts of hashed items over a whole corpus in an array of fixed size."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.session import ship_package

from .common import written
from .workers import runs

SEGMENT_BITS = 15
#: So many tasks' segments are added up in one group at a time.
FAN_IN = 64


def count_slots(texts: DataFrame, bits: int,
                slots: Callable[[list[str | None]], list[np.ndarray]]) -> np.ndarray:
    """How often each of 2^``bits`` slots occurs in all ``texts`` (first
    column); ``slots`` maps texts to slot numbers, the array bounds what is
    held anywhere.

    Each task counts into its own array and hands on its segments that are not
    zero, compressed. Segments are added up FAN_IN at a time, however many
    tasks there are.
    """
    ship_package(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, column in runs(batch.column(0)):
                found = slots(column)
                if found:
                    np.add.at(total, np.concatenate(found), 1)
        rows = [(i, zlib.compress(r.tobytes(), 1))
                for i, r in enumerate(total.reshape(-1, 1 << SEGMENT_BITS)) if r.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())],
            ["seg", "data"])

    parts = written(texts.mapInArrow(count, "seg int, data binary")
                    .withColumn("part", F.spark_partition_id()), "sketch")
    while True:
        tasks = (parts.agg(F.max("part")).first()[0] or 0) + 1
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        parts = parts.groupBy("seg", "part").applyInPandas(_added, "seg int, data binary, part int")
        if tasks <= FAN_IN:
            break
        parts = written(parts, "sketch")
    out = np.zeros(1 << bits, np.int64)
    width = 1 << SEGMENT_BITS
    for r in parts.collect():                      # 2^bits counters at most
        out[r["seg"] * width: (r["seg"] + 1) * width] = _unpacked(r["data"])
    return out


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << SEGMENT_BITS, np.int64)
    for data in pdf["data"]:
        total += _unpacked(data)
    return pd.DataFrame({"seg": pdf["seg"].iloc[:1].to_numpy(),
                         "data": [zlib.compress(total.tobytes(), 1)],
                         "part": pdf["part"].iloc[:1].to_numpy()})
