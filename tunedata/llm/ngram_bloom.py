"""LM scoring with a log-frequency Bloom filter.

The counts of words and word pairs are quantised on a log scale, and an n-gram
of level j is put into one Bloom filter j times, as (n-gram, 1) to (n-gram, j).
Workers get the filter by broadcast and find a count by repeated membership
probes; interpolated shares of pair and word give the probability of each
token.

An n-gram is held if it makes up HELD_SHARE of the training tokens. No more
than 1 / HELD_SHARE n-grams of an order can, whatever the size of the corpus,
which bounds the filter. The exact counts of all rarer words and pairs, which
grow with the corpus, are looked up by shuffles: texts are dealt into chunks, a
chunk asks for each of its different rare n-grams once, asks are grouped by
ranges of the hash and answered with the sums of their training occurrences.
Beside it the exact add-one unigram score of every text is computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.session import ship_package

from .arrays import mix, utf8, word_hashes
from .common import written
from .sketch import count_slots
from .workers import add_columns, runs

#: Share of the training tokens from which on a word or pair is held.
HELD_SHARE = 1e-6
#: Base of the count levels: a count is known within half a level.
LEVEL_BASE = 2.0 ** 0.5
MAX_LEVEL = 96
#: No order has more than about 3 / HELD_SHARE items (n-grams by levels), so
#: words and pairs take up to 6e6 * 16 bits = 12 MB.
BITS_PER_ITEM = 16
HASHES = 8
#: Pairs are first counted in a sketch of 2^SKETCH_BITS slots: a pair in a slot
#: under the limit cannot reach it.
SKETCH_BITS = 20
#: A chunk holds about so many bytes of texts (or one text), a range of hashes
#: the asks of about so many.
CHUNK_BYTES = 8 << 20
RANGE_BYTES = 16 << 20
#: A rare text's ratios of pair and word are kept on a log scale of base
#: 2^(1 / RATIO_STEPS) until the pairs' weight is known.
RATIO_STEPS = 256
_END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def token_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """The tokens of each text as 64-bit hashes: words with A-Z in lower case,
    then the end token. (Two of a thousand million words share a hash with a
    probability of 3 %.)"""
    return [np.append(h, _END) for h in word_hashes([t.translate(_LOWER) for t in utf8(texts)])]


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of (token before, token); before the first stands a start sign."""
    return _pair(_before(h), h)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _PAIR + second)


def _before(h: np.ndarray) -> np.ndarray:
    return np.concatenate(([_START], h[:-1]))


# ---- the filter ---------------------------------------------------------------

def level_of(count: np.ndarray | float, least: float) -> np.ndarray:
    """1 for ``least``, and one more for each factor LEVEL_BASE."""
    steps = np.log(np.maximum(count, least) / least) / np.log(LEVEL_BASE)
    return np.minimum(1 + np.floor(steps + 1e-9), MAX_LEVEL).astype(np.int64)


def count_of(level: np.ndarray, least: float) -> np.ndarray:
    """The middle (on the log scale) of a level's counts; 0 for level 0."""
    return np.where(level > 0, least * LEVEL_BASE ** (level - 0.5), 0.0)


class LogBloom:
    """A Bloom filter of (n-gram, level) items."""

    def __init__(self, n_items: int):
        self.size = max(64, int(n_items) * BITS_PER_ITEM)
        self.bits = np.zeros(self.size // 8 + 1, np.uint8)

    def _places(self, h: np.ndarray, level: int) -> Iterator[np.ndarray]:
        x = mix(h + np.uint64(level * 0x9E3779B97F4A7C15 % 2 ** 64))
        step = mix(x) | np.uint64(1)
        for _ in range(HASHES):
            yield x % np.uint64(self.size)
            x = x + step

    def add(self, h: np.ndarray, levels: np.ndarray) -> None:
        for j in range(1, int(levels.max(initial=0)) + 1):
            for p in self._places(h[levels >= j], j):
                np.bitwise_or.at(self.bits, p >> np.uint64(3),
                                 np.left_shift(1, (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Probe level after level until the first miss."""
        out = np.zeros(len(h), np.int64)
        at = np.arange(len(h))
        for j in range(1, MAX_LEVEL + 1):
            at = at[self.has(h[at], j)]
            if len(at) == 0:
                break
            out[at] = j
        return out

    def has(self, h: np.ndarray, level: int) -> np.ndarray:
        """Membership of (n-gram, level); an item is dropped at its first miss."""
        found = np.zeros(len(h), bool)
        at = np.arange(len(h))
        x = mix(h + np.uint64(level * 0x9E3779B97F4A7C15 % 2 ** 64))
        step = mix(x) | np.uint64(1)
        for _ in range(HASHES):
            p = x % np.uint64(self.size)
            hit = (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            at, x, step = at[hit], x[hit], step[hit]
            x = x + step
        found[at] = True
        return found


@dataclass
class BloomModel:
    """The filter with what turns counts into probabilities, and the exact
    counts of the held words (sorted by hash)."""

    bloom: LogBloom
    n_tokens: int
    types: int
    least: float
    wins: float            # training tokens that a held pair foretells better than the word
    head: np.ndarray
    head_counts: np.ndarray

    @property
    def rarer(self) -> bool:
        """Whether there can be n-grams that are not held."""
        return self.least > 1

    def weight(self, wins: float) -> float:
        """The pairs' weight, from the training tokens that their pair foretells better."""
        return float(min(wins / max(self.n_tokens, 1), 0.9))

    def counts(self, h: np.ndarray) -> np.ndarray:
        """The exact counts of held words; 0 for others."""
        if len(self.head) == 0:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, self.head_counts[at], 0)


# ---- counting -----------------------------------------------------------------

def pair_slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def rare_grams(model: BloomModel, h: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens' words and which pairs are not held."""
    distinct, at = np.unique(pairs, return_inverse=True)
    return model.counts(h) == 0, ~model.bloom.has(distinct, 1)[at]


def _candidates(head: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """First and second token of the pairs of held words; a pair that is held
    has no rarer words. (The start sign stands as often as the end token.)"""
    tokens = token_hashes(texts)
    h, first = np.concatenate(tokens), np.concatenate([_before(t) for t in tokens])
    held = head[np.minimum(np.searchsorted(head, h), len(head) - 1)] == h if len(head) else np.zeros(len(h), bool)
    ends = np.cumsum([len(t) for t in tokens]) - 1
    keep = held & _shifted(held, np.concatenate(([0], ends[:-1] + 1)), held[ends])
    return first[keep], h[keep]


def _held_pairs(train: DataFrame, least: float, head: np.ndarray) -> pd.DataFrame:
    """``h``, ``first`` and ``second`` (hashes of its tokens) and exact count
    ``n`` of each pair with ``least`` or more occurrences; ``head``: the held words."""
    context = train.sparkSession.sparkContext
    words = context.broadcast(head)                               # 1 / HELD_SHARE hashes at most
    counted = count_slots(train, SKETCH_BITS, lambda column: [
        pair_slot(_pair(*_candidates(words.value, column)))])
    heavy = np.packbits(counted >= least)
    shared = context.broadcast(heavy)                             # 2^SKETCH_BITS bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for _, column in runs(batch.column(0)):
                first, second = _candidates(words.value, column)
                h = _pair(first, second)
                keep = np.flatnonzero(bits[pair_slot(h)])
                _, at, n = np.unique(h[keep], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[keep[at]].view(np.int64)), pa.array(second[keep[at]].view(np.int64)),
                     pa.array(n.astype(np.int64))], ["first", "second", "n"])

    # at most 1 / HELD_SHARE rows of three numbers
    held = (train.mapInArrow(count, "first long, second long, n long").groupBy("first", "second")
            .agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toPandas())
    first, second = (held[c].to_numpy(np.int64).view(np.uint64) for c in ("first", "second"))
    return held.assign(h=_pair(first, second).view(np.int64))


def word_counts(train: DataFrame) -> DataFrame:
    """``h``, ``c``: exact counts of all training tokens by their hash."""
    ship_package(train.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, column in runs(batch.column(0)):
                h, n = np.unique(np.concatenate(token_hashes(column)), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return train.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


def train_bloom(train: DataFrame, counts: DataFrame) -> BloomModel:
    """The model from training texts (column ``text``) and their exact word
    counts; only held n-grams, of which there is a bounded number, reach the
    driver."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_tokens, types = int(total["n"] or 0), int(total["v"])
    least = float(max(1, np.ceil(HELD_SHARE * n_tokens)))
    # at most 1 / HELD_SHARE rows of two numbers each
    head = counts.filter(F.col("c") >= least).toPandas()
    head_h, head_n = _sorted(head, "h", "c")
    held = _held_pairs(train, least, head_h)
    pair_h, pair_n = _sorted(held, "h", "n")
    # the start sign stands before a text as often as the end token after it
    ends = head_n[head_h == _END]
    words = (np.append(head_h, np.full(len(ends), _START)), np.append(head_n, ends))
    items = [(h, level_of(n, least)) for h, n in (words, (pair_h, pair_n))]
    bloom = LogBloom(sum(int(x.sum()) for _, x in items))
    for h, levels in items:
        bloom.add(h, levels)
    return BloomModel(bloom, n_tokens, types, least, _held_wins(held, words, n_tokens), head_h, head_n)


def _wins(n: np.ndarray, before: np.ndarray, word: np.ndarray, n_tokens: int) -> np.ndarray:
    """Deleted interpolation: the pairs of ``n`` occurrences that, with one
    left out, foretell their token better than its word does."""
    by_pair = np.divide(n - 1, before - 1, out=np.zeros(len(n)), where=before > 1)
    return by_pair > np.maximum(word - 1, 0) / max(n_tokens - 1, 1)


def _held_wins(held: pd.DataFrame, words: tuple[np.ndarray, np.ndarray], n_tokens: int) -> float:
    """The training tokens whose pair is held and wins; the words of a held pair are held."""
    order = np.argsort(words[0])
    known, counts = words[0][order], words[1][order]

    def count(column: str) -> np.ndarray:
        h = held[column].to_numpy(np.int64).view(np.uint64)
        if len(known) == 0:
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, counts[at], 0)

    n, before, word = held["n"].to_numpy(float), count("first"), count("second")
    return float(n[_wins(n, before, word, n_tokens)].sum())


def _sorted(pdf: pd.DataFrame, h: str, n: str) -> tuple[np.ndarray, np.ndarray]:
    keys = pdf[h].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], pdf[n].to_numpy(np.int64)[order]


# ---- exact counts of the rarer n-grams -------------------------------------------

def _packed(h: np.ndarray) -> tuple[int, bytes]:
    """A first hash and the steps to the next ones of a sorted array, in as few bytes as the largest needs."""
    steps = np.diff(h)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return int(h[:1].view(np.int64)[0]), steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(first: int, steps: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    if size > 1:
        out[1:, : len(steps) // (size - 1)] = np.frombuffer(steps, np.uint8).reshape(size - 1, -1)
    out = out.view("<u8").reshape(-1)
    out[0] = np.int64(first).view(np.uint64)
    return np.cumsum(out, dtype=np.uint64)


def _small(n: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return n.astype(np.min_scalar_type(int(n.max(initial=0)))).tobytes()


def _counts(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // size}").astype(np.int64)


def _rare_of(model: BloomModel, part: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's tokens, which words and pairs are rare, and the hashes of these."""
    tokens = token_hashes(part.column("text").to_pylist())
    h, pairs = np.concatenate(tokens), np.concatenate([pair_hashes(t) for t in tokens])
    words, keep = rare_grams(model, h, pairs)
    return tokens, words, keep, np.concatenate((h[words], pairs[keep]))


def rare_counts(chunks: DataFrame, model, ranges: int) -> DataFrame:
    """``chunk``, ``range``, ``n``: the exact training counts of the different
    rare n-grams of each chunk, in the order of their hashes. An n-gram held by
    no training text counts 0."""

    def ask(part: pa.Table) -> pa.Table:
        tokens, words, keep, grams = _rare_of(model.value, part)
        learned = np.repeat(~np.array(part.column("_held").to_pylist(), bool), [len(t) for t in tokens])
        grams, at = np.unique(grams, return_inverse=True)
        n = np.bincount(at, np.concatenate((learned[words], learned[keep])), len(grams)).astype(np.int64)
        where = ((grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        found, starts = np.unique(where, return_index=True)
        pieces = [(*_packed(g), len(g), _small(c)) for g, c in
                  zip(np.split(grams, starts[1:]), np.split(n, starts[1:]), strict=True) if len(g)]
        columns = [list(x) for x in zip(*pieces, strict=True)] or [[], [], [], []]
        return pa.table([pa.array([part.column("_chunk")[0].as_py()] * len(pieces), pa.int64()),
                         pa.array(found, pa.int64()), pa.array(columns[0], pa.int64()),
                         pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64()),
                         pa.array(columns[3], pa.binary())],
                        ["chunk", "range", "first", "steps", "size", "n"])

    def answer(asks: pa.Table) -> pa.Table:
        sizes = asks.column("size").to_pylist()
        grams = np.concatenate([_unpacked(*x) for x in zip(
            asks.column("first").to_pylist(), asks.column("steps").to_pylist(), sizes, strict=True)])
        n = np.concatenate([_counts(*x) for x in zip(asks.column("n").to_pylist(), sizes, strict=True)])
        distinct, at = np.unique(grams, return_inverse=True)
        total = np.bincount(at, n, len(distinct)).astype(np.int64)[at]
        told = [_small(x) for x in np.split(total, np.cumsum(sizes)[:-1])]
        return pa.table([asks.column("chunk"), asks.column("range"), asks.column("size"),
                         pa.array(told, pa.binary())], ["chunk", "range", "size", "n"])

    return (chunks.groupBy("_chunk").applyInArrow(
                ask, "chunk long, range long, first long, steps binary, size long, n binary")
            .groupBy("range").applyInArrow(answer, "chunk long, range long, size long, n binary"))


# ---- scoring ------------------------------------------------------------------

@dataclass
class _Tokens:
    """Of the tokens of some texts: exact counts of the words, their
    probabilities, whether the word before is known, the pair's share of it,
    and (of rare pairs) whether the pair foretells the token better."""

    starts: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray
    p_word: np.ndarray
    known: np.ndarray
    share: np.ndarray
    wins: np.ndarray

    def summed(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)


def _tokens(model: BloomModel, tokens: list[np.ndarray], words: np.ndarray | None = None,
            keep: np.ndarray | None = None, exact: np.ndarray | None = None) -> _Tokens:
    """``exact``: the counts of the rare ``words`` and of the rare pairs (``keep``); without these all are held."""
    h = np.concatenate(tokens)
    sizes = np.array([len(t) for t in tokens])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    distinct, at = np.unique(h, return_inverse=True)
    count = model.counts(h)
    word = count_of(model.bloom.levels(distinct), model.least)[at]     # held counts are quantised
    pairs, at = np.unique(np.concatenate([pair_hashes(t) for t in tokens]), return_inverse=True)
    pair = count_of(model.bloom.levels(pairs), model.least)[at]
    wins = np.zeros(len(h), bool)
    if exact is not None:
        n_words = int(words.sum())
        count[words], word[words], pair[keep] = exact[:n_words], exact[:n_words], exact[n_words:]
    # the start sign stands before a text as often as the end token after it
    ends = starts + sizes - 1
    before = _shifted(word, starts, word[ends])
    if exact is not None:
        wins[keep] = _wins(pair[keep], _shifted(count, starts, count[ends])[keep], count[keep], model.n_tokens)
    share = np.divide(pair, np.maximum(before, pair), out=np.zeros(len(h)), where=before > 0)
    return _Tokens(starts, sizes, count, (word + 1) / (model.n_tokens + model.types + 1.0), before > 0, share, wins)


def _shifted(values: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value of the token before; ``first`` before the first of each text."""
    out = np.concatenate((values[:1], values[:-1]))
    out[starts] = first
    return out


def _score(model: BloomModel, texts: list[str | None]) -> list[tuple]:
    """n_tokens, n_known, the base sum and the score of texts whose n-grams are all held."""
    t = _tokens(model, token_hashes(texts))
    weight = np.where(t.known, model.weight(model.wins), 0.0)
    score = t.summed(np.log10(weight * t.share + (1 - weight) * t.p_word))
    known, base = t.summed((t.counts > 0).astype(np.int64)), t.summed(np.log10(t.counts + 1.0))
    return list(zip(t.sizes.tolist(), known.tolist(), base.tolist(), score.tolist(), strict=True))


def _measured(model: BloomModel, part: pa.Table, told: pa.Table) -> list[pa.Array]:
    """Of each text of a chunk, with the answers to its asks: n_tokens, n_known,
    the base sum, the sum of the words' log10, the tokens whose word before is
    known, the training tokens that their rare pair foretells better, and the
    ratios of pair and word as steps and their numbers."""
    tokens, words, keep, grams = _rare_of(model, part)
    order = np.argsort(told.column("range").to_numpy())
    n, size = told.column("n").to_pylist(), told.column("size").to_pylist()
    counts = np.concatenate([np.empty(0, np.int64), *[_counts(n[i], size[i]) for i in order]])
    distinct, at = np.unique(grams, return_inverse=True)
    if len(distinct) != len(counts):
        raise ValueError("the answers do not belong to these texts")
    t = _tokens(model, tokens, words, keep, counts[at])
    learned = ~np.array(part.column("_held").to_pylist(), bool)
    has = np.flatnonzero(t.share > 0)
    step = np.rint(np.log2(t.share[has] / t.p_word[has]) * RATIO_STEPS).astype(np.int64)
    row = np.repeat(np.arange(len(tokens)), t.sizes)[has]
    both, times = np.unique((row << 32) + step + (1 << 31), return_counts=True)
    offsets = pa.array(np.searchsorted(both, np.arange(len(tokens) + 1) << 32).astype(np.int32))
    steps = pa.array(((both & 0xFFFFFFFF) - (1 << 31)).astype(np.int32))
    return [pa.array(t.sizes.astype(np.int64)), pa.array(t.summed((t.counts > 0).astype(np.int64))),
            pa.array(t.summed(np.log10(t.counts + 1.0))), pa.array(t.summed(np.log10(t.p_word))),
            pa.array(t.summed(t.known.astype(np.int64))),
            pa.array(np.where(learned, t.summed(t.wins.astype(np.int64)), 0)),
            pa.ListArray.from_arrays(offsets, steps),
            pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]


_MEASURED = ("n_tokens long, n_known long, _sum double, _words double, _before long, _wins long, "
             "_steps array<int>, _times array<int>")


def _with_rare(rows: DataFrame, fitted: BloomModel, model) -> DataFrame:
    """``_id``, ``_held``, ``n_tokens``, ``n_known``, ``_sum`` and ``score``,
    with the exact counts of the n-grams that are not held."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # whole rows that repeat come into one chunk, others are spread by their texts
    chunks = rows.withColumn("_chunk", F.pmod(F.xxhash64("_id", "text"), F.lit(size // CHUNK_BYTES + 1)))
    told = rare_counts(chunks, model, size // RANGE_BYTES + 1)
    keys = rows.select("_id", "_held").schema
    schema = keys
    for f in rows.sparkSession.createDataFrame([], _MEASURED).schema:
        schema = schema.add(f)
    names = [f.name for f in schema]

    def measure(part: pa.Table, answers: pa.Table) -> pa.Table:
        own = [part.column("_id"), part.column("_held")]
        if part.num_rows == 0:
            raise ValueError("answers without texts")
        return pa.table([*own, *_measured(model.value, part, answers)], names)

    # the chunks' shuffle is one for asks and texts
    measured = written(chunks.groupBy("_chunk").cogroup(told.groupBy("chunk")).applyInArrow(measure, schema),
                       "lm-measured")
    wins = measured.agg(F.sum("_wins")).first()[0] or 0
    weight = fitted.weight(fitted.wins + wins)
    rest, odds = float(np.log10(1 - weight)), weight / (1 - weight)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, times = batch.column("_steps"), batch.column("_times").flatten().to_numpy()
            gain = times * np.log10(1 + odds * 2.0 ** (steps.flatten().to_numpy() / RATIO_STEPS))
            total = np.concatenate(([0.0], np.cumsum(gain)))
            ends = np.cumsum(steps.value_lengths().to_numpy())
            gained = total[ends] - total[np.concatenate(([0], ends[:-1]))]
            score = batch.column("_words").to_numpy() + batch.column("_before").to_numpy() * rest + gained
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(5)], pa.array(score)], [*batch.schema.names[:5], "score"])

    out = measured.select("_id", "_held", "n_tokens", "n_known", "_sum").schema.add("score", "double")
    return measured.mapInArrow(finish, out)


def lm_scores(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``held_out``, ``n_tokens``, ``n_known``
    (tokens that occur in training), ``train_tokens``, ``base_score`` (exact
    add-one unigram log10) and ``score`` (log10 probability by the filter and
    the exact counts of what it does not hold).

    * Learned from the rows where ``held_out`` is false (or null). A null text
      is an empty one: only its end token is scored. Without training rows
      every token has probability 1.
    * Long texts are read whole; repeated rows each get a row and each count in
      training; an empty table gives no rows; other columns are not read,
      whatever they are called.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(held_out, F.lit(False)).alias("_held"),
                       F.col(text_col).alias("text"))
    train = rows.filter(~F.col("_held")).select("text")
    counts = written(word_counts(train), "lm-counts")
    fitted = train_bloom(train, counts)
    model = rows.sparkSession.sparkContext.broadcast(fitted)
    if fitted.rarer:
        scored = _with_rare(rows, fitted, model)
    else:
        scored = add_columns(rows, "text", ["_id", "_held"], "n_tokens long, n_known long, _sum double, score double",
                             lambda texts: _score(model.value, texts))
    everything = F.lit(float(fitted.n_tokens + fitted.types + 1))
    return scored.select(
        F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "n_tokens", "n_known",
        F.lit(fitted.n_tokens).cast("long").alias("train_tokens"),
        (F.col("_sum") - F.col("n_tokens") * F.log10(everything)).alias("base_score"), "score")
