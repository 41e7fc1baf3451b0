"""Similar items in groups, and items compared to whole groups.

Items are opaque bytes with a ``node`` (binary id). A group's items travel once
for many comparisons, so a hot group costs its size and its comparisons, never
a copy of an item for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.session import ship_package

from .common import among, written

#: A group has so many items at most, and so many bytes (or one item).
GROUP_ITEMS, GROUP_BYTES = 32, 1 << 19
#: So many items at most are compared to one copy of a group.
QUERIES = 256
_SCHEMA = "grp binary, nodes array<binary>, items array<binary>, labels array<binary>"
_KINDS = [pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.binary())]


def grouped(items: DataFrame, order: list[str],
            label: Callable[[list[bytes], list[bytes], list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``grp``, ``nodes``, ``items``, ``labels``: runs of ``node``, ``item``,
    ``label`` in the given order, cut where its first column changes. ``label``
    may make a group's labels anew from its nodes, items and labels."""
    ship_package(items.sparkSession)
    most, room = GROUP_ITEMS, GROUP_BYTES

    def row(nodes, held, labels):
        return nodes[0], nodes, held, label(nodes, held, labels) if label else labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, held, labels, key, size = [], [], [], None, 0
        for batch in _pieces(batches):
            out = []
            for first, node, item, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if nodes and (first != key or len(nodes) == most or size + len(item) > room):
                    out.append(row(nodes, held, labels))
                    nodes, held, labels, size = [], [], [], 0
                nodes.append(node)
                held.append(item)
                labels.append(own)
                key, size = first, size + len(item)
            if out:
                yield _batch(out)
        if nodes:
            yield _batch([row(nodes, held, labels)])

    rows = items.select(F.col(order[0]).alias("key"), "node", "item", "label", *order[1:])
    by = ["key", *order[1:]]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, _SCHEMA)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, as rows may be long and become Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)],
                                      ["grp", "nodes", "items", "labels"])


def members(groups: DataFrame) -> DataFrame:
    """``node``, ``grp``, ``label`` of every item of ``groups``."""
    return groups.select("grp", F.explode(F.arrays_zip("nodes", "labels")).alias("m")).select(
        F.col("m.nodes").alias("node"), "grp", F.col("m.labels").alias("label"))


def compared(candidates: DataFrame, items: DataFrame, groups: DataFrame,
             build: Callable[[list[bytes]], Any], match: Callable[[Any, bytes], np.ndarray]) -> DataFrame:
    """``a``, ``b``: for each candidate (``query``, ``grp``) one link from the
    query to each label of the group that it matches.

    ``build`` makes what ``match`` compares an item with, which tells for each
    item of the group whether it matches. A group is copied once per QUERIES
    candidates, and tasks hold one group at a time.
    """
    ship_package(items.sparkSession)
    found = written(candidates, "grouped-candidates")
    # written, so that their size is known: few groups have many candidates
    hot = written(found.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("copies"))
                  .filter("copies > 1"), "grouped-copies")
    copies = F.coalesce("copies", F.lit(1))
    query = (found.join(hot, "grp", "left")
             .withColumn("copy", F.pmod(F.xxhash64("query"), copies).cast("int"))
             .join(among(items.select(F.col("node").alias("query"), "item"), "query", found), "query")
             .select("grp", "copy", F.lit(1).alias("kind"), F.array("query").alias("nodes"),
                     F.array("item").alias("items"), F.array("query").alias("labels")))
    # a group that no candidate names is passed over
    group = (among(groups, "grp", found).join(hot, "grp", "left")
             .withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
             .select("grp", "copy", F.lit(0).alias("kind"), "nodes", "items", "labels"))
    dealt = (group.unionByName(query).repartition("grp", "copy")
             .sortWithinPartitions("grp", "copy", "kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, parts = None, [], []
        for batch in _pieces(batches):
            a, b = [], []
            for kind, nodes, held, labels in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                if kind == 0:
                    group, names, parts = build(held), nodes, labels
                    continue
                met = np.flatnonzero(match(group, held[0])).tolist()
                one = {parts[i]: names[i] for i in met if names[i] != nodes[0]}
                a += nodes * len(one)
                b += one.values()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")
