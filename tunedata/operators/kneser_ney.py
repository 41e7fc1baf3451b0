"""Perplexity under an interpolated Kneser-Ney trigram model.

    P(w | u v) = max(c(u v w) - D3, 0) / c(u v .) + D3 * types(u v) / c(u v .) * P(w | v)
    P(w | v)   = max(N(. v w) - D2, 0) / N(. v .) + D2 * types(v) / N(. v .) * P(w)
    P(w)       = max(N(. w) - D1, 0) / N(. .)     + D1 * V / N(. .) / (V + 1)

``N`` counts the different words that come before (continuation counts), each
discount is n1 / (n1 + 2 n2) of its order's counts of counts, and the last term
shares what is left out evenly over the V words and one unknown word. So the
probabilities of every context, seen or not, sum to 1.

Words are 64-bit hashes (of ten million different words two share one with a
probability of 3e-6), the common ones short numbers. Trigrams are shuffled and
written once, counted and packed, by their middle word: all counts of a trigram,
its context, its last two words and its middle word are then in one bucket. A
middle word that would fill a bucket is spread by the word before it; only the
counts of its last two words are added up by another shuffle. Scores are worked
out for each different trigram, in the buckets and by left joins that hold no
hot key (``lookup.hot_lookup``), and then brought to the texts' trigrams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunedata.functions.text import tokens
from tunedata.operators.lookup import hot_lookup
from tunedata.operators.metrics import START
from tunedata.session import materialize, ship_package

#: The discount of an order of which no count is 1 (n1 / (n1 + 2 n2) is 0 or
#: undefined): without one, unseen words would have no probability.
PLAIN_DISCOUNT = 0.5

#: Words with this share of all tokens get short numbers, the most common ones
#: NUMBERS of them; the others keep their hash, which only takes more bytes.
NUMBER_SHARE = 2.5e-7
NUMBERS = 1 << 18
#: Trigrams that a bucket holds on average, counted with repeats.
BUCKET_GRAMS = 500_000
#: A middle word with this share of a bucket is spread over all buckets.
SPREAD_SHARE = 0.25
#: Trigrams that a task counts at once before they are shuffled.
CHUNK_GRAMS = 2_000_000


def text_trigrams(df: DataFrame, key: str, text: str, max_tokens: int | None = None,
                  hashed: bool = False) -> DataFrame:
    """(key, u, v, w, n): every trigram of each text's lower-cased tokens (the
    first two have start marks before them; n = 1). With ``hashed`` words are
    numbers, as ``_hashed`` makes them."""
    words = tokens(F.lower(F.col(text)))
    words = F.slice(words, 1, max_tokens) if max_tokens is not None else words
    words = F.transform(words, lambda w: F.xxhash64(w)) if hashed else words
    t = df.select(F.col(key).alias("key"), words.alias("t"))
    tc, n = F.col("t"), F.size("t")
    mark = F.xxhash64(F.lit(START)) if hashed else F.lit(START)
    start = F.array(mark, mark)
    zipped = F.when(n > 0, F.arrays_zip(
        F.slice(F.concat(start, tc), 1, n).alias("u"), F.slice(F.concat(start, tc), 2, n).alias("v"),
        tc.alias("w")))
    # explode_outer + null filter: a plain explode makes Catalyst infer a filter
    # on the array and push it, with the tokenizer, below this project
    g = t.select("key", F.explode_outer(zipped).alias("g")).where(F.col("g").isNotNull())
    return g.select(F.col("key").alias(key), "g.u", "g.v", "g.w", F.lit(1).cast("long").alias("n"))


def _hashed(grams: DataFrame) -> DataFrame:
    """The words of trigrams as 64-bit hashes (numbers are taken for such)."""
    return grams.withColumns({c: F.xxhash64(c) for c in "uvw" if dict(grams.dtypes)[c] == "string"})


@dataclass(frozen=True)
class Numbering:
    """The common words' hashes in rising order and their numbers by falling
    count; the numbers under ``spread`` are spread over all ``buckets``."""

    hashes: np.ndarray
    numbers: np.ndarray
    spread: int
    buckets: int

    def of(self, words: np.ndarray) -> np.ndarray:
        """The number of each word; others keep their hash."""
        if not len(self.hashes):
            return words
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.numbers[at], words)

    def wide(self, v: np.ndarray) -> np.ndarray:
        return (v >= 0) & (v < self.spread)

    def bucket(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        x = _mixed(v)
        x = np.where(self.wide(v), _mixed(x ^ _mixed(u)), x)
        return (x % np.uint64(self.buckets)).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rows by ``columns`` and where in it new ones begin."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, np.flatnonzero(new)


def _ids(*columns: np.ndarray) -> np.ndarray:
    """A number from 0 for each row, the same for rows with the same values."""
    order, starts = _runs(*columns)
    first = np.zeros(len(order), np.int64)
    first[starts[1:]] = 1
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(first)
    return ids


def _counted(grams: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows v, u, w, n with the n of like ones added up, in order of ``by`` and
    the words, and the place each was taken from."""
    if not grams.shape[1]:
        return grams, np.zeros(0, np.int64)
    order, starts = _runs(*by, *grams[:3])
    n = np.add.reduceat(grams[3][order], starts)
    return np.vstack([grams[:3, order[starts]], n[None]]), order[starts]


def _packed(grams: np.ndarray) -> bytes:
    rows = grams.copy()
    rows[0, 1:] -= grams[0, :-1]                             # v rises: mostly 0
    rows[1, 1:] -= np.where(rows[0, 1:] == 0, grams[1, :-1], 0)          # u rises for each v
    return zlib.compress(np.ascontiguousarray(rows).view(np.uint8).reshape(4, -1, 8).transpose(0, 2, 1).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, 8, -1).transpose(0, 2, 1)
    rows = rows.copy(order="C").view(np.int64)[:, :, 0]
    new = np.ones(rows.shape[1], bool)
    new[1:] = rows[0, 1:] != 0
    starts = np.flatnonzero(new)
    sums = np.cumsum(rows[1])
    rows[1] = sums - np.repeat(sums[starts] - rows[1, starts], np.diff(np.r_[starts, rows.shape[1]]))
    rows[0] = np.cumsum(rows[0])
    return rows


def _all(column: pa.ChunkedArray) -> np.ndarray:
    """Rows v, u, w, n of packed trigrams."""
    return np.concatenate([np.zeros((4, 0), np.int64), *(_unpacked(b) for b in column.to_pylist())], axis=1)


@dataclass(frozen=True)
class KneserNey:
    """Written tables of the model, of words by ``numbering``: ``c3`` (bucket,
    grams: packed v, u, w, count), of the spread middle words ``c2`` (v, w, c) and
    ``b2`` (v, total, types), ``c1`` (w, c), and the scalars: discounts,
    continuation total and number of words."""

    c3: DataFrame
    c2: DataFrame
    b2: DataFrame
    c1: DataFrame
    numbering: Numbering
    discount: tuple[float, float, float]
    total: int
    words: int


def _number(grams: DataFrame) -> Numbering:
    counts = materialize(grams.groupBy("v").agg(F.sum("n").alias("n")), "kn-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = counts.where((F.col("n") > 1) & (F.col("n") >= NUMBER_SHARE * total))
    common = common.select("v", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "v")) - 1).alias("i"))
    head = sorted((r.v, r.i, r.n) for r in common.where(F.col("i") < NUMBERS).collect())
    hashes, numbers, n = np.array(head, np.int64).reshape(-1, 3).T.copy()
    buckets = 1 + total // BUCKET_GRAMS
    return Numbering(hashes, numbers, int((n * buckets > SPREAD_SHARE * total).sum()), buckets)


def _shares(grams: DataFrame, numbering: Numbering) -> DataFrame:
    """(bucket, grams) of pieces of ``grams``, each counted and packed."""
    chunk = CHUNK_GRAMS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def parts() -> pa.RecordBatch:
            u, v, w, n = np.concatenate(held, axis=1)
            u, v, w = numbering.of(u), numbering.of(v), numbering.of(w)
            bucket = numbering.bucket(u, v)
            g, at = _counted(np.vstack([v, u, w, n]), bucket)
            ids, starts = np.unique(bucket[at], return_index=True)
            data = [_packed(g[:, a:b]) for a, b in zip(starts, [*starts[1:], g.shape[1]], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(data, pa.binary())], ["bucket", "grams"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.vstack([batch.column(c).to_numpy() for c in "uvwn"]))
            size += batch.num_rows
            if size >= chunk:
                yield parts()
                held, size = [], 0
        if held:
            yield parts()

    return grams.select("u", "v", "w", "n").mapInArrow(work, "bucket long, grams binary")


def _buckets(shares: DataFrame, numbering: Numbering) -> DataFrame:
    """A row for each bucket: its different ``grams``, packed; the last two words
    v, w of those whose middle word is spread, with how many different words are
    before them in this bucket; for each last word of the others how many different
    words are before it (lw, lc); how many counts are 1 or 2, of its trigrams
    and of its last two words that are in no other bucket."""
    def work(table: pa.Table) -> pa.Table:
        g, _ = _counted(_all(table.column("grams")))
        order, starts = _runs(g[0], g[2])
        v, w = g[0][order[starts]], g[2][order[starts]]
        c = np.diff([*starts, g.shape[1]])
        wide = numbering.wide(v)
        lw, lc = np.unique(w[~wide], return_counts=True)
        lists = [v[wide], w[wide], c[wide], lw, lc]
        seen = [(x == k).sum() for x in (g[3], c[~wide]) for k in (1, 2)]
        return pa.table([table.column("bucket")[:1], pa.array([_packed(g)], pa.binary()),
                         *(pa.array([x], pa.list_(pa.int64())) for x in lists),
                         *(pa.array([x], pa.int64()) for x in seen)],
                        names=["bucket", "grams", "v", "w", "c", "lw", "lc", "ones3", "twos3", "ones2", "twos2"])

    return shares.groupBy("bucket").applyInArrow(
        work, "bucket long, grams binary, v array<long>, w array<long>, c array<long>, lw array<long>,"
        " lc array<long>, ones3 long, twos3 long, ones2 long, twos2 long")


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones else PLAIN_DISCOUNT


def _ones_twos(counts: DataFrame) -> tuple[int, int]:
    return tuple(counts.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first())


def _listed(table: DataFrame, *columns: str) -> DataFrame:
    return table.select(F.explode(F.arrays_zip(*columns)).alias("x")).select("x.*")


def train(grams: DataFrame) -> KneserNey:
    """A model of all ``grams`` (u, v, w, n; see ``text_trigrams``)."""
    ship_package(grams.sparkSession)
    grams = _hashed(grams)
    numbering = _number(grams)
    parts = materialize(_buckets(_shares(grams, numbering), numbering), "kn-buckets")
    c2 = materialize(_listed(parts, "v", "w", "c").groupBy("v", "w").agg(F.sum("c").alias("c")), "kn-c2")
    b2 = materialize(c2.groupBy("v").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types")), "kn-b2")
    last = _listed(parts, "lw", "lc").toDF("w", "c").unionByName(c2.select("w", F.lit(1).cast("long").alias("c")))
    c1 = materialize(last.groupBy("w").agg(F.sum("c").alias("c")), "kn-c1")
    size = c1.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("words")).first()
    seen = parts.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("ones3", "twos3", "ones2", "twos2")]).first()
    ones, twos = _ones_twos(c2)
    return KneserNey(parts.select("bucket", "grams"), c2, b2, c1, numbering,
                     (_discount(*_ones_twos(c1)), _discount(seen[2] + ones, seen[3] + twos), _discount(*seen[:2])),
                     size["total"], size["words"])


def _level(count: Column, total: Column, types: Column, discount: float, lower: Column) -> Column:
    """One order: the lower order's probability where the context is unknown."""
    seen = F.greatest(F.coalesce(count, F.lit(0)) - F.lit(discount), F.lit(0.0)) / total
    return F.when(total.isNull(), lower).otherwise(seen + F.lit(discount) * types / total * lower)


def _numbered(rows: DataFrame, model: KneserNey, into: str) -> DataFrame:
    """``rows`` with u, v, w, which are hashes, as the model's numbers in the columns ``into``."""
    numbering, names = model.numbering, rows.drop(*into.split()).columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*own, *(pa.array(numbering.of(batch.column(c).to_numpy())) for c in "uvw")], [*names, *into.split()])

    schema = rows.select(*names).schema
    for c in into.split():
        schema = schema.add(c, "long")
    return rows.mapInArrow(work, schema)


def _looked_up(asked: DataFrame, model: KneserNey) -> DataFrame:
    """``asked`` (u, v, w, texts) with the counts that the model's buckets have:
    n3, t3, k3 of the trigram and its context, n2, t2, k2 of the last two words
    and the middle word (null where that is spread); t3 and t2 are null where
    they would be 0."""
    numbering, spark = model.numbering, asked.sparkSession
    # more is asked than the buckets hold: each is asked by parts
    parts = 1 + asked.count() // (numbering.buckets * BUCKET_GRAMS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, w = (batch.column(c).to_numpy() for c in "uvw")
            part = (_mixed(_mixed(u) ^ w.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(numbering.bucket(u, v)), pa.array(part)],
                ["u", "v", "w", "texts", "bucket", "part"])

    def look(rows: pa.Table, held: pa.Table) -> pa.Table:
        u, v, w = (rows.column(c).to_numpy() for c in "uvw")
        g = _all(held.column("grams"))
        g = g[:, np.isin(g[0], v)]
        m = g.shape[1]
        gv, gu, gw = (np.concatenate([a, b]) for a, b in zip(g[:3], (v, u, w), strict=True))

        def sums(ids: np.ndarray, amounts: np.ndarray | None = None) -> np.ndarray:
            found = np.bincount(ids[:m], amounts, minlength=ids.max(initial=0) + 1)
            return found[ids[m:]].astype(np.int64)

        context, pair, middle = _ids(gv, gu), _ids(gv, gw), _ids(gv)
        firsts = np.unique(pair[:m], return_index=True)[1]              # a row for each v, w that is held
        types = np.bincount(middle[firsts], minlength=middle.max(initial=0) + 1)[middle[m:]]
        n3, t3, k3 = sums(_ids(gv, gu, gw), g[3]), sums(context, g[3]), sums(context)
        n2, t2 = sums(pair), sums(middle)
        wide = numbering.wide(v)
        return pa.table({
            **{c: rows.column(c) for c in ("u", "v", "w", "texts")},
            "n3": n3, "t3": pa.array(t3, mask=t3 == 0), "k3": k3, "n2": pa.array(n2, mask=wide),
            "t2": pa.array(t2, mask=wide | (t2 == 0)), "k2": pa.array(types.astype(np.int64), mask=wide)})

    placed = asked.select("u", "v", "w", "texts").mapInArrow(
        place, "u long, v long, w long, texts long, bucket long, part long")
    held = model.c3.crossJoin(F.broadcast(spark.range(parts).toDF("part")))
    return placed.groupBy("bucket", "part").cogroup(held.groupBy("bucket", "part")).applyInArrow(
        look, "u long, v long, w long, texts long, n3 long, t3 long, k3 long, n2 long, t2 long, k2 long")


def _scored(asked: DataFrame, model: KneserNey) -> DataFrame:
    """``u``, ``v``, ``w``, ``texts``, ``p`` of the different trigrams ``asked``, of the model's numbers."""
    if model.words == 0:
        return asked.select("u", "v", "w", "texts", F.lit(1.0).alias("p"))
    d1, d2, d3 = model.discount
    numbering = model.numbering
    r = materialize(_looked_up(asked, model), "kn-looked-up")
    c1, short = model.c1.withColumnRenamed("c", "n1"), F.col("w").between(0, len(numbering.hashes) - 1)
    r = (r.where(short).join(F.broadcast(c1.where(short)), "w", "left")       # bounded by NUMBERS
         .unionByName(hot_lookup(r.where(~short), c1, ["w"], "n1", ["n1"])))
    wide = F.col("v").between(0, numbering.spread - 1)
    spread = hot_lookup(r.where(wide).drop("n2", "t2", "k2"), model.c2.withColumnRenamed("c", "n2"), ["v", "w"], "n2",
                        ["n2"])
    b2 = F.broadcast(model.b2.withColumnsRenamed({"total": "t2", "types": "k2"}))       # few words are spread
    r = r.where(~wide).unionByName(spread.join(b2, "v", "left"))
    p1 = (F.greatest(F.coalesce(F.col("n1"), F.lit(0)) - F.lit(d1), F.lit(0.0)) / F.lit(float(model.total))
          + F.lit(d1 * model.words / model.total / (model.words + 1)))
    r = r.withColumn("p1", p1).withColumn("p2", _level(F.col("n2"), F.col("t2"), F.col("k2"), d2, F.col("p1")))
    return r.select("u", "v", "w", "texts",
                    _level(F.col("n3"), F.col("t3"), F.col("k3"), d3, F.col("p2")).alias("p"))


def probabilities(grams: DataFrame, model: KneserNey) -> DataFrame:
    """``u``, ``v``, ``w``, ``p`` of the different trigrams ``grams``."""
    ship_package(grams.sparkSession)
    grams = grams.select(*[F.col(c).alias(f"own_{c}") for c in "uvw"], "u", "v", "w")
    grams = _numbered(_hashed(grams), model, "iu iv iw").drop("u", "v", "w")
    asked = grams.select(*[F.col(f"i{c}").alias(c) for c in "uvw"], F.lit(1).cast("long").alias("texts"))
    p = _scored(asked, model).select(*[F.col(c).alias(f"i{c}") for c in "uvw"], "p")
    return grams.join(p, ["iu", "iv", "iw"]).select(*[F.col(f"own_{c}").alias(c) for c in "uvw"], "p")


def perplexity_kn(df: DataFrame, key: str, text: str, model: KneserNey | None = None,
                  max_tokens: int | None = None, out: str = "perplexity") -> DataFrame:
    """(key, out): ``exp(mean -ln P(w | u v))`` over the tokens of ``text``, by
    ``model`` or one trained on the scored column itself. A null text, or one
    without tokens, has a null value; ``key`` tells the rows apart."""
    ship_package(df.sparkSession)
    grams = text_trigrams(df, key, text, max_tokens, hashed=True)
    if model is None:
        grams = materialize(grams, "kn-texts")
        model = train(grams)
    grams = materialize(_numbered(grams, model, "u v w"), "kn-grams")
    asked = materialize(grams.groupBy("u", "v", "w").agg(F.count(F.lit(1)).alias("texts")), "kn-asked")
    p = materialize(_scored(asked, model), "kn-probabilities")
    scored = hot_lookup(grams, p, ["u", "v", "w"], "texts", ["p"])
    per = scored.groupBy(key).agg(F.exp(F.sum(-F.ln("p") * F.col("n")) / F.sum("n")).alias(out))
    return df.select(key).join(per, key, "left")
