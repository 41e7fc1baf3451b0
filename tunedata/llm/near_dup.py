"""Near-duplicate documents by improved consistent weighted sampling.

A text is the weighted set of its shingles of five words, weighted by TF-IDF.
Improved consistent weighted sampling draws shingles so that two texts draw the
same one with the probability of their weighted Jaccard similarity; equal bands
of draws make candidates, the exact weighted Jaccard similarity decides, and
connected texts form a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix, utf8, windows, word_hashes
from .common import packed, unpacked, written
from .grouped import compared, grouped, members
from .sketch import count_slots
from .workers import add_columns, runs

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 4, 14
DRAWS = ROWS * BANDS
#: Candidates whose share of equal draws is below this are not compared in
#: full: 3.7 standard deviations under SIMILARITY.
LEAST_SHARE = 0.6
#: So many most central texts of a bucket are compared to all others in it
#: first, and then the texts that these do not connect.
PIVOTS = 3
#: Document frequencies are counted in a sketch of 2^SKETCH_BITS counters.
SKETCH_BITS = 21
#: idf = 1 + IDF_SLOPE * log(N / df) / log(N): passages that many documents
#: share weigh less, while 0.8 means nearly what it means for plain shingles.
IDF_SLOPE = 0.25
_TABLE_BITS = 16


def shingles(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text in order of their hash, and their counts."""
    return np.unique(windows(hashes, SHINGLE), return_counts=True)


def _words(texts: list[str | None]) -> list[np.ndarray]:
    """The words of texts in lower case, as hashes."""
    return word_hashes(utf8([t and t.lower() for t in texts]))


def _slot(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Sketch of the document frequencies of the shingles of all ``texts``
    (column ``text``): shingles with one slot share a count."""
    return count_slots(texts.select("text"), SKETCH_BITS, lambda column: [
        _slot(shingles(h)[0]) for h in _words(column) if len(h)])


# ---- weights, draws and similarity -------------------------------------------

@dataclass
class Weights:
    """TF-IDF weights; ``idf`` has one entry per slot of the sketch."""

    idf: np.ndarray

    @classmethod
    def of(cls, frequencies: np.ndarray, n_docs: int) -> Weights:
        top = np.log(max(n_docs, 2))
        return cls((1 + IDF_SLOPE * (top - np.log(np.clip(frequencies, 1, max(n_docs, 2)))) / top)
                   .astype(np.float32))

    def weighted(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, tf = shingles(hashes)
        return s, tf * self.idf[_slot(s)].astype(float)


def _uniform(seed: int) -> np.ndarray:
    i = np.arange(1 << _TABLE_BITS, dtype=np.uint64)
    h = mix(i * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed], np.uint64)))
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


class Sampler:
    """Improved consistent weighted sampling (gamma variates r and c, uniform
    b). The variates of a shingle in one draw come from a table, at a place
    hashed from both; equal places are told apart by the shingle."""

    def __init__(self) -> None:
        r = -np.log(_uniform(1) * _uniform(2))
        ln_c = np.log(-np.log(_uniform(3) * _uniform(4)))
        self.r, self.inverse, self.b = r, 1 / r, _uniform(5)
        self.base = ln_c - r + r * self.b
        seeds = np.arange(1, 2 * DRAWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.factor = mix(seeds[:DRAWS]) | np.uint64(1)
        self.shift = mix(seeds[DRAWS:])

    def draw(self, s: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One 64-bit value for each draw from the weighted set."""
        ln_w = np.log(weight)
        best = np.full(DRAWS, np.inf)
        chosen, level = np.zeros(DRAWS, np.uint64), np.zeros(DRAWS)
        column = np.arange(DRAWS)
        for at in range(0, len(s), 4096):
            h = s[at: at + 4096, None]
            place = ((h * self.factor + self.shift) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            t = np.floor(ln_w[at: at + 4096, None] * self.inverse[place] + self.b[place])
            ln_a = self.base[place] - self.r[place] * t
            row = ln_a.argmin(axis=0)
            value = ln_a[row, column]
            better = value < best
            best = np.where(better, value, best)
            chosen = np.where(better, h[row, 0], chosen)
            level = np.where(better, t[row, column], level)
        return mix(chosen ^ mix(level.astype(np.int64).astype(np.uint64) + self.factor))


def band_keys(draws: np.ndarray) -> np.ndarray:
    """A key for each band: equal for texts with all its draws equal."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + draws[j::ROWS])
    return h.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller over sum of the larger weights of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 0.0


_SAMPLER: list[Sampler] = []


def _signatures(texts: list[str | None], weights: Weights) -> list[tuple]:
    if not _SAMPLER:
        _SAMPLER.append(Sampler())
    seen: dict[str, tuple] = {}
    distinct = list(dict.fromkeys(texts))
    for text, h in zip(distinct, _words(distinct)):
        draws = _SAMPLER[0].draw(*weights.weighted(h))
        seen[text] = (band_keys(draws), (draws >> np.uint64(32)).astype(np.uint32).view(np.int32))
    return [seen[t] for t in texts]


# ---- candidates, links and classes -------------------------------------------

def _alike(x: Column, y: Column) -> Column:
    """Whether two texts have enough equal draws to be compared in full."""
    equal = F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")),
                        F.lit(0), lambda acc, n: acc + n)
    return equal >= int(LEAST_SHARE * DRAWS)


def candidate_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct pairs (a < b) of nodes to compare first, from ``node``,
    ``bands``, ``draws``; the rows (``key``, ``node``) that are left, and all
    nodes that share a bucket.

    In each bucket (band key) with several texts the PIVOTS most central ones
    are paired with all others: linear in the bucket, and complete up to
    PIVOTS + 1 texts. Central is a text that meets many others over all its
    bands: in a group of edited copies that is the text they were made from.
    What is left are the texts of larger buckets but their pivots;
    ``remaining_links`` has the links among them.
    """
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
                     .filter("n > 1"), "neardup-buckets")
    live = written(rows.join(shared, "key"), "neardup-live")
    central = written(live.groupBy("node").agg(F.sum("n").alias("central")), "neardup-central")
    left = written(live.select("key", "node").join(central, "node"), "neardup-ranked")
    pairs = None
    for k in range(PIVOTS):
        pivot = written(left.groupBy("key").agg(F.max(F.struct("central", "node")).alias("p"),
                                                F.count(F.lit(1)).alias("n"))
                        .filter("n > 1").select("key", F.col("p.node").alias("pivot")),
                        "neardup-pivots")
        left = written(left.join(pivot, "key").filter(F.col("node") != F.col("pivot")),
                       "neardup-left")
        found = left.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        pairs = found if pairs is None else pairs.unionByName(found)
        left = left.drop("pivot")
    pairs = pairs.distinct()
    draws = nodes.select("node", "draws")
    both = (pairs.join(draws.select(F.col("node").alias("a"), F.col("draws").alias("da")), "a")
            .join(draws.select(F.col("node").alias("b"), F.col("draws").alias("db")), "b"))
    return (both.filter(_alike(F.col("da"), F.col("db"))).select("a", "b"),
            left.select("key", "node"), central.select("node"))


class WeightedGroup:
    """Weighted sets of a group: the weight of each shingle of their union in
    each of them."""

    def __init__(self, items: list[bytes]) -> None:
        sets = [_unpack(i) for i in items]
        self.union, at = np.unique(np.concatenate([t for t, _ in sets]), return_inverse=True)
        self.weights = np.zeros((len(sets), len(self.union)))
        self.weights[np.repeat(np.arange(len(sets)), [len(t) for t, _ in sets]), at] = np.concatenate(
            [w for _, w in sets])
        self.totals = np.array([w.sum() for _, w in sets])

    def similar(self, item: bytes) -> np.ndarray:
        """Which sets reach SIMILARITY to the set ``item``."""
        tokens, weights = _unpack(item)
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        hit = self.union[at] == tokens
        low = np.minimum(self.weights[:, at[hit]], weights[hit]).sum(axis=1)
        return low / (weights.sum() + self.totals - low) >= SIMILARITY


def _unpack(item: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(item) // 2
    return np.frombuffer(item[:half], np.uint64), np.frombuffer(item[half:], float)


def _weighted_sets(texts: list[str | None], weights: Weights) -> list[tuple]:
    out = []
    for h in _words(texts):
        s, w = weights.weighted(h)
        out.append((s.tobytes() + w.tobytes(), s.view(np.int64), w, float(w.sum())))
    return out


def remaining_links(left: DataFrame, label: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """Links (``a``, ``b``) between the rows ``left`` in a bucket that the links
    found so far (``node``, ``label``) do not connect; one from a text to each
    label that it links with in a group.

    Connected texts are one class already, so only pairs across classes can
    change one, and one text of such a pair is outside the bucket's largest
    class. Those texts are compared to the texts of the bucket in groups, never
    pair by pair. Most need not be: what no other open text shares cannot be
    common, so two texts with the weights W and the shared part S of them reach
    SIMILARITY only if each W is at most the other's *reach*,
    S + S / SIMILARITY - W.
    """
    own = written(left.join(label, "node", "left").select(
        "key", "node", F.coalesce("label", "node").alias("label")), "neardup-open")
    largest = written(own.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
                      .groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"),
                                          F.count(F.lit(1)).alias("classes"))
                      .filter("classes > 1").select("key", F.col("m.label").alias("largest")),
                      "neardup-largest")
    rows = written(own.join(largest, "key"), "neardup-apart")
    nodes = rows.groupBy("node").agg(F.min("key").alias("first"), F.any_value("label").alias("label"))
    sets = written(add_columns(
        texts.join(nodes.select("node"), "node"), "text", ["node"],
        "item binary, tokens array<long>, weights array<double>, total double",
        lambda column: _weighted_sets(column, weights.value)), "neardup-open-sets")
    shingle = sets.select("node", F.explode(F.arrays_zip("tokens", "weights")).alias("s")).select(
        "node", F.col("s.tokens").alias("token"), F.col("s.weights").alias("weight"))
    common = shingle.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token")
    shared = shingle.join(common.hint("shuffle_hash"), "token", "left_semi").groupBy("node").agg(
        F.sum("weight").alias("shared"))
    slack = 1 + 1e-9
    reach = (F.col("shared") * (1 + 1 / SIMILARITY) - F.col("total")) * slack
    live = written(sets.join(shared, "node").filter(F.col("shared") * slack >= SIMILARITY * F.col("total"))
                   .join(nodes, "node").select("node", "item", "label", "first", "total",
                                               reach.alias("reach")), "neardup-reach")
    groups = written(grouped(live, ["first", "reach", "node"]), "neardup-groups")
    bounds = (rows.join(live.select("node", "total", "reach"), "node")
              .join(members(groups).select("node", "grp"), "node"))
    bounds = written(bounds, "neardup-bounds")
    group = bounds.groupBy("key", F.col("grp").alias("to")).agg(
        F.min("total").alias("lightest"), F.max("reach").alias("farthest"),
        F.min("label").alias("low"), F.max("label").alias("high"))
    apart = (F.col("label") != F.col("low")) | (F.col("label") != F.col("high"))
    candidates = (bounds.filter("label != largest").join(group, "key")
                  .filter(apart & (F.col("lightest") <= F.col("reach")) & (F.col("total") <= F.col("farthest")))
                  .select(F.col("node").alias("query"), F.col("to").alias("grp")).distinct())
    return compared(candidates, live, groups, WeightedGroup, lambda g, item: g.similar(item))


def verified_links(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """The pairs whose exact weighted Jaccard similarity reaches SIMILARITY;
    ``texts`` has ``node`` and ``text``, each node once."""
    joined = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
              .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            keep = []
            for part, tb in runs(batch["tb"]):
                ta = batch["ta"].slice(part.start, len(tb)).to_pylist()
                ha, hb = _words(ta), _words(tb)
                keep += [weighted_jaccard(w.weighted(x), w.weighted(y)) >= SIMILARITY
                         for x, y in zip(ha, hb)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "ta", "tb").mapInArrow(compare, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node connected to it) for all nodes of
    ``links``; labels spread over links and jump to their label's label until
    none changes."""
    both = written(links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neardup-links")
    label = written(both.groupBy(F.col("a").alias("node"))
                    .agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "neardup-labels")
    while True:
        far = both.join(label, both["b"] == label["node"]).groupBy("a").agg(
            F.min("label").alias("m"))
        near = label.join(far, label["node"] == far["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        near = written(near, "neardup-labels")
        over = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = written(near.join(over, "label", "left").select(
            "node", "old", F.least("label", "next").alias("label")), "neardup-labels")
        changed = jumped.filter("label != old").limit(1).count()
        label = jumped.select("node", "label")
        if not changed:
            return label


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``node`` (digest of the text, null for a text without a word)
    and ``text`` of every row: exact copies share a node."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.when(
        text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text))).alias("node"), text.alias("text"))


def duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``node``, ``class_id`` (the smallest id of the class) and ``first`` (the
    (id, node) that stands for the class) for each distinct text with a word."""
    spark: SparkSession = docs.sparkSession
    rows = _nodes(docs, id_col, text_col)
    worded = rows.filter(F.col("node").isNotNull())
    frequencies = document_frequencies(worded)
    own = written(worded.groupBy("node").agg(F.min("_id").alias("_id"),
                                             F.count(F.lit(1)).alias("n")), "neardup-own")
    n_docs = own.agg(F.sum("n")).first()[0] or 0
    weights = spark.sparkContext.broadcast(Weights.of(frequencies, n_docs))   # fixed size
    signed = add_columns(worded, "text", ["node"], "bands array<long>, draws array<int>",
                         lambda texts: _signatures(texts, weights.value))
    nodes = written(signed.dropDuplicates(["node"]), "neardup-draws")
    first_pairs, left, shared = candidate_pairs(nodes)
    pairs = written(first_pairs, "neardup-pairs")
    # copies are dropped before the shuffle; the join keeps its form (and the
    # texts their one shuffle) however few texts are wanted
    texts = written(worded.select("node", "text").dropDuplicates(["node"])
                    .join(shared.hint("shuffle_hash"), "node", "left_semi"), "neardup-texts")
    links = written(verified_links(pairs, texts, weights), "neardup-verified")
    label = components(links)
    more_links = written(remaining_links(left, label, texts, weights), "neardup-verified")
    if more_links.limit(1).count():
        label = components(links.unionByName(more_links))
    grouped = own.join(label, "node", "left").select(
        "node", "_id", F.coalesce("label", "node").alias("label"))
    first = grouped.groupBy("label").agg(F.min(F.struct("_id", "node")).alias("first"),
                                         F.min("_id").alias("class_id"))
    return written(grouped.join(first, "label").select("node", "class_id", "first"),
                   "neardup-classes")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``class_id`` (the smallest id of its
    class of near copies) and ``is_first``: whether it has that id.

    * Words are compared as written but for white space and case; fewer than
      five words make one shingle. Null texts and texts without a word are
      classes of their own, with their own id.
    * Exact copies and repeated rows share a class without being compared.
      Long texts are read whole. A null id never is the smallest unless all
      ids of the class are null. An empty table gives no rows; other columns
      are not read, whatever they are called.
    """
    classes = duplicate_classes(docs, id_col=id_col, text_col=text_col)
    rows = _nodes(docs, id_col, text_col).select("_id", "node")
    class_id = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("class_id"))
    return rows.join(classes.drop("first"), "node", "left").select(
        F.col("_id").alias(id_col), class_id.alias("class_id"),
        F.col("_id").eqNullSafe(class_id).alias("is_first"))


def first_of_each_class(docs: DataFrame, *, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class of near copies: that with the
    smallest id (then digest). Rows without a word all stay."""
    classes = duplicate_classes(docs, id_col=id_col, text_col=text_col)
    stay = classes.select(F.col("first._id").alias("_fid"),
                          F.col("first.node").alias("_fnode")).distinct()
    text = F.col(f"`{text_col}`")
    keyed = docs.select(packed(docs).alias("row"), F.col(f"`{id_col}`").alias("id"), F.when(
        text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text))).alias("node"))
    worded = keyed.filter(F.col("node").isNotNull())
    kept = (worded.join(stay, (F.col("node") == F.col("_fnode")) & F.col("id").eqNullSafe(F.col("_fid")),
                        "left_semi").dropDuplicates(["node"]))
    return kept.unionByName(keyed.filter(F.col("node").isNull())).select(*unpacked("row", docs.columns))
