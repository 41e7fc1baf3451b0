"""Hard negatives by angular triangle filtering.

Every vector is stored with its norm and its angles to a few reference
directions. The angle between two vectors lies between the difference and the
sum of their angles to any direction, so the stored angles bound the cosine of
a pair, and with the norms its inner product. Only pairs whose bounds reach the
wanted window of scores are scored, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunedata.session import ship_package

from .common import written

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these percentages of the positive.
LOW_PERCENT, HIGH_PERCENT = 50, 95
#: Reference directions, chosen far apart among SAMPLE_ROWS hash-chosen rows.
DIRECTIONS, SAMPLE_ROWS = 16, 2048
#: Anchors are searched in blocks of so many (and so many numbers at most).
BLOCK_ROWS, BLOCK_NUMBERS = 1024, 1 << 21
#: Pairs that are bounded and scored at once.
TILE = 1 << 20
#: Share of the product of the norms by which bounds are widened: more than
#: the rounding of angles and cosines in single precision.
MARGIN = 1e-5
#: Larger components count as this one, so that no score overflows.
LARGEST = 1e100
_MOST = float(2 ** 63 - 1024)


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(
        vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))
        & ~F.isnan(x))


def _rows(batch_column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector in a list column."""
    lengths = np.diff(batch_column.offsets.to_numpy())
    flat = batch_column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    out = []
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out.append((at, flat[starts[at][:, None] + np.arange(n)]))
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, held in the range of a long; the shorter
    vectors end in zeros."""
    n = min(a.shape[1], b.shape[1])
    return np.clip(a[:, :n] @ b[:, :n].T, -_MOST, _MOST)


def _angles(vectors: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    cos = _products(vectors / np.where(norms > 0, norms, 1)[:, None], directions)
    return np.arccos(np.clip(cos, -1, 1)).astype(np.float32)


def reference_directions(vectors: list[np.ndarray], count: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors far apart: the first, then always the one whose largest
    absolute cosine to those chosen is the smallest. Fewer if there are fewer."""
    width = max([len(v) for v in vectors], default=0)
    rows = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        rows[i, :len(v)] = v
    norms = np.sqrt((rows ** 2).sum(axis=1))
    rows = rows[norms > 0] / norms[norms > 0, None]
    chosen, near = [], np.zeros(len(rows))
    for _ in range(min(count, len(rows))):
        i = int(near.argmin())
        chosen.append(rows[i])
        near = np.maximum(near, np.abs(rows @ rows[i]))
        near[i] = np.inf
    return np.array(chosen).reshape(len(chosen), width)


def stored_angles(vectors: DataFrame, *, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id``, ``label``, ``vector`` (whole numbers), ``norm`` and ``angles``
    of every row that takes part, written."""
    ship_package(vectors.sparkSession)
    usable = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).filter(
            F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector")))
    # floor() gives longs, but a double beyond 2^53 is whole already
    whole = usable.withColumn("vector", F.transform("vector", lambda x: F.when(
        F.abs(x) < float(1 << 45), F.floor(x * SCALE).cast("double")).otherwise(
            F.least(F.greatest(x, F.lit(-LARGEST)), F.lit(LARGEST)) * SCALE)))
    sample = (whole.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
              .select("vector").collect())
    directions = reference_directions([np.array(r["vector"], float) for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = np.zeros(batch.num_rows)
            angles = np.zeros((batch.num_rows, len(directions)), np.float32)
            for at, v in _rows(batch.column(2)):
                norms[at] = np.sqrt((v ** 2).sum(axis=1))
                angles[at] = _angles(v, norms[at], directions)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(norms), pa.array(list(angles), pa.list_(pa.float32()))],
                ["id", "label", "vector", "norm", "angles"])

    return written(whole.mapInArrow(
        run, "id long, label long, vector array<double>, norm double, angles array<float>"),
        "hardneg-rows")


# ---- one block of anchors against all rows -----------------------------------

@dataclass
class Block:
    """Anchors; ``low`` and ``high`` (anchors x slots) are the windows of wanted
    scores, ``same`` tells whether partners have the anchor's label, ``take`` is
    how many partners a slot wants."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    angles: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    take: int


def score_bounds(block: Block, at: np.ndarray, norms: np.ndarray, angles: np.ndarray) -> tuple:
    """Lower and upper bounds of the scores of anchors ``at`` and rows."""
    shape = (len(at), len(norms))
    apart, most = np.zeros(shape, np.float32), np.full(shape, np.pi, np.float32)
    for j in range(angles.shape[1]):
        a, v = block.angles[at, j][:, None], angles[None, :, j]
        np.maximum(apart, np.abs(a - v), out=apart)
        total = a + v
        np.minimum(most, np.minimum(total, np.float32(2 * np.pi) - total), out=most)
    size = block.norms[at][:, None] * norms[None, :]
    return (np.minimum(size * (np.cos(most) - MARGIN), _MOST),
            np.maximum(size * (np.cos(apart) + MARGIN), -_MOST))


class Search:
    """The best partners of each slot of a block's anchors among rows seen."""

    def __init__(self, block: Block) -> None:
        self.block = block
        shape = (*block.low.shape, block.take)
        self.scores = np.full(shape, -np.inf)
        self.ids = np.zeros(shape, np.int64)
        self.scored = 0

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray,
            norms: np.ndarray, angles: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        for label in np.unique(self.block.labels):
            anchors = np.flatnonzero(self.block.labels == label)
            rows = order[(labels[order] == label) == self.block.same]
            step = max(1, TILE // max(len(anchors), 1))
            for i in range(0, len(rows), step):
                r = rows[i: i + step]
                self._tile(anchors, ids[r], vectors[r], norms[r], angles[r])

    def _tile(self, anchors, ids, vectors, norms, angles) -> None:
        b = self.block
        low, high = score_bounds(b, anchors, norms, angles)
        floor = np.maximum(b.low[anchors], self.scores[anchors, :, -1])
        reach = ((high >= floor.min(axis=1)[:, None]) & (low <= b.high[anchors].max(axis=1)[:, None])
                 & (b.ids[anchors][:, None] != ids[None, :]))
        self.scored += int(reach.sum())
        used_a, used_r = np.flatnonzero(reach.any(axis=1)), np.flatnonzero(reach.any(axis=0))
        if not len(used_r):
            return
        reach = reach[np.ix_(used_a, used_r)]
        anchors, ids, vectors = anchors[used_a], ids[used_r], vectors[used_r]
        if reach.mean() > 0.05:
            scores = np.where(reach, _products(b.vectors[anchors], vectors), -np.inf)
        else:
            i, j = np.nonzero(reach)
            n = min(b.vectors.shape[1], vectors.shape[1])
            scores = np.full(reach.shape, -np.inf)
            scores[i, j] = np.clip(
                np.einsum("ij,ij->i", b.vectors[anchors[i], :n], vectors[j, :n]), -_MOST, _MOST)
        repeated = len(np.unique(ids)) < len(ids)
        for slot in range(b.low.shape[1]):
            self._merge(anchors, slot, ids, np.where(
                (scores >= b.low[anchors, slot][:, None]) & (scores <= b.high[anchors, slot][:, None]),
                scores, -np.inf), repeated)

    def _merge(self, anchors, slot, ids, scores, repeated) -> None:
        row = np.arange(len(anchors))
        found_s, found_i = [self.scores[anchors, slot]], [self.ids[anchors, slot]]
        for _ in range(self.block.take):
            j = scores.argmax(axis=1)                 # of equal scores the smallest id
            s = scores[row, j].copy()
            found_s.append(s[:, None])
            found_i.append(ids[j][:, None])
            if repeated:
                scores[(scores == s[:, None]) & (ids[None, :] == ids[j][:, None])] = -np.inf
            scores[row, j] = -np.inf
        s, i = np.concatenate(found_s, axis=1), np.concatenate(found_i, axis=1)
        for _ in range(2):                            # equal pairs count once
            order = np.lexsort((i, -s), axis=-1)
            s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            twice = (s[:, 1:] == s[:, :-1]) & (i[:, 1:] == i[:, :-1])
            s[:, 1:][twice] = -np.inf
        self.scores[anchors, slot] = s[:, : self.block.take]
        self.ids[anchors, slot] = i[:, : self.block.take]

    def result(self) -> pa.RecordBatch:
        a, slot, k = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.astype(np.int32)), pa.array(slot.astype(np.int32)),
             pa.array(self.scores[a, slot, k].astype(np.int64)), pa.array(self.ids[a, slot, k])],
            ["anchor", "slot", "score", "id"])


def _search(rows: DataFrame, block: Block) -> DataFrame:
    """``anchor``, ``slot``, ``score``, ``id`` and ``rank``: the ``take`` best
    of each slot over all rows. A task hands on its own best alone."""
    sent = rows.sparkSession.sparkContext.broadcast(block)      # bounded by BLOCK_NUMBERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(sent.value)
        for batch in batches:
            ids, labels, norms = (batch.column(c).to_numpy() for c in ("id", "label", "norm"))
            angles = batch.column("angles").flatten().to_numpy().reshape(batch.num_rows, -1)
            for at, v in _rows(batch.column("vector")):
                search.add(ids[at], labels[at], v, norms[at], angles[at])
        yield search.result()

    found = rows.mapInArrow(run, "anchor int, slot int, score long, id long")
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    # equal (score, id) of different tasks are one partner
    return (found.withColumn("rank", F.dense_rank().over(best)).filter(F.col("rank") <= block.take)
            .dropDuplicates(["anchor", "slot", "rank"]))


def _blocks(anchors: DataFrame) -> Iterator[list]:
    """Anchors in blocks of bounded size, never all at once on the driver."""
    block, numbers = [], 0
    for row in anchors.toLocalIterator():
        size = len(row["vector"]) + len(row["angles"]) + 8
        if block and (len(block) >= BLOCK_ROWS or numbers + size > BLOCK_NUMBERS):
            yield block
            block, numbers = [], 0
        block.append(row)
        numbers += size
    if block:
        yield block


def _block(rows: list, **more) -> Block:
    width = max(len(r["vector"]) for r in rows)
    vectors = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        vectors[i, :len(r["vector"])] = r["vector"]
    return Block(np.array([r["id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64),
                 vectors, np.array([r["norm"] for r in rows]),
                 np.array([r["angles"] for r in rows], np.float32).reshape(len(rows), -1), **more)


def hard_negatives(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", anchor_every: int = ANCHOR_EVERY,
                   positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``: for each row whose id is divisible
    by ``anchor_every`` and each of its first ``positives`` rows of the same
    label, the first ``negatives`` rows of another label whose score is from
    ``low_percent`` to ``high_percent`` of the positive's. A score is the inner
    product of the vectors' components times 256, rounded down; higher scores
    come first, then smaller ids.

    * Rows without an id, label or vector, or with a null or non-finite
      component take no part. A shorter vector is taken to end in zeros; an
      empty one scores 0.
    * Partners are told apart by score and id: repeated rows count once. Rows
      with the anchor's id never are its partners; anchors that share an id but
      not a vector or label are anchors each.
    * A positive score below 0 has no window. Scores are exact while the norms
      multiply to less than 2^53, otherwise rounded like doubles; components
      are held inside LARGEST, scores inside the range of a long.
    * An empty table, or one without anchors, gives no rows. Other columns are
      not read, whatever they are called.
    """
    rows = stored_angles(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col)
    anchors = written(rows.filter(F.col("id") % anchor_every == 0).distinct(), "hardneg-anchors")
    spark, out = vectors.sparkSession, None
    for part in _blocks(anchors):
        any_score = np.full((len(part), 1), np.inf)
        near = _search(rows, _block(part, low=-any_score, high=any_score, same=True, take=positives))
        score = np.full((len(part), positives), np.nan)
        partner = np.zeros((len(part), positives), np.int64)
        for r in near.collect():                    # ``positives`` a row of the block
            score[r["anchor"], r["rank"] - 1], partner[r["anchor"], r["rank"] - 1] = r["score"], r["id"]
        wanted = score >= 0
        low = np.where(wanted, np.ceil(np.where(wanted, score, 0) * low_percent / 100), np.inf)
        high = np.where(wanted, np.floor(np.where(wanted, score, 0) * high_percent / 100), -np.inf)
        found = _search(rows, _block(part, low=low, high=high, same=False, take=negatives))
        slots = spark.createDataFrame(
            [(i, k, part[i]["id"], int(partner[i, k]), int(score[i, k]))
             for i, k in np.argwhere(wanted).tolist()],
            "anchor int, slot int, anchor_id long, positive_id long, positive_score long")
        mined = written(found.join(F.broadcast(slots), ["anchor", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")), "hardneg-mined")
        out = mined if out is None else out.unionByName(mined)
    if out is None:
        out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                        "positive_score long, negative_score long")
    return out


HARD_NEGATIVE_SQL = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM e WHERE vec_id % 50 = 0),
s AS (
    SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same,
           CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score
    FROM a JOIN e ON a.vec_id <> e.vec_id),
p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
    SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
     AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3
"""
