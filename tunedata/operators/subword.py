"""Subword tokens of a public byte-pair vocabulary, with offsets and masks.

The vocabulary is a file of ranks (base64 of the bytes, blank, rank); nothing
is trained. A text is cut into pieces by a pattern, in the JVM; each piece
starts as its bytes, and the neighbours with the lowest rank merge until none
has one. Every byte has a rank, so there is no unknown token and the tokens'
bytes put together are the text.

Encoding is narrow: one Arrow pass beside the vocabulary, which is broadcast
(its size is checked). No occurrence is shuffled, so no word is a hot key; a
worker merges a piece once and keeps it in a cache of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tunedata.functions import templates as T
from tunedata.functions.text import col_
from tunedata.session import ship_package

#: The rank file of the registered queries; any path that Spark reads will do.
RANKS_PATH = "file:///opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary is sent to every task: so many pieces and bytes at most.
MOST_PIECES, MOST_BYTES = 1 << 20, 1 << 25
#: Pieces that a worker keeps, none longer than CACHED_CHARS.
CACHED_PIECES, CACHED_CHARS = 1 << 17, 64

# FIXED VALUES: the pattern published with the vocabulary. White space is
# written out because engines differ in what they call white space.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PIECE_PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
                 rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def pieces(c: Column | str) -> Column:
    """The pieces of a text (array<string>): together they are the text."""
    return F.regexp_extract_all(col_(c), F.lit(PIECE_PATTERN), 0)


def read_ranks(spark: SparkSession, path: str = RANKS_PATH) -> DataFrame:
    """``piece`` (binary) and ``id`` of a rank file."""
    part = F.split("value", " ")
    return (spark.read.text(path).filter("value <> ''")
            .select(F.unbase64(part[0]).alias("piece"), part[1].cast("int").alias("id")))


def load_ranks(ranks: DataFrame) -> dict[bytes, int]:
    """A vocabulary as it is broadcast; an error if it is too large for that,
    lacks a byte or gives a piece or an id twice."""
    size = ranks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("piece")).alias("b")).first()
    if size["n"] > MOST_PIECES or (size["b"] or 0) > MOST_BYTES:
        raise ValueError(f"a vocabulary of {size['n']} pieces is too large to broadcast")
    out = {bytes(r["piece"]): r["id"] for r in ranks.collect()}
    if len(out) != size["n"] or len(set(out.values())) != len(out):
        raise ValueError("the vocabulary gives a piece or an id twice")
    if any(bytes([b]) not in out for b in range(256)):
        raise ValueError("the vocabulary lacks a byte")
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece: of all neighbours whose bytes have a rank those
    with the lowest (then leftmost) merge first. Every merge costs the
    logarithm of the length, so a piece of a million bytes is no matter."""
    part = [piece[i:i + 1] for i in range(len(piece))]
    after = list(range(1, len(part) + 1))
    before = list(range(-1, len(part) - 1))
    waiting: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if 0 <= i and after[i] < len(part):
            both = part[i] + part[after[i]]
            if both in ranks:
                heapq.heappush(waiting, (ranks[both], i, both))

    for i in range(len(part) - 1):
        offer(i)
    while waiting:
        _, i, both = heapq.heappop(waiting)
        j = after[i]
        # an entry is stale once either side has merged with another
        if not part[i] or j >= len(part) or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, b""
        after[i] = after[j]
        if after[i] < len(part):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [p for p in part if p]


def spans(text: str, tokens: list[bytes]) -> list[tuple[int, int]]:
    """The code points (from, to) of each token; a token that is part of a
    character covers it whole."""
    if text.isascii():
        ends, at = [], 0
        for t in tokens:
            ends.append((at, at + len(t)))
            at += len(t)
        return ends
    char = [i for i, c in enumerate(text) for _ in c.encode("utf-8", "surrogatepass")]
    out, at = [], 0
    for t in tokens:
        out.append((char[at], char[at + len(t) - 1] + 1))
        at += len(t)
    return out


class Encoder:
    """Tokens of pieces, kept for the next time."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.kept: dict[str, tuple[list[int], list[tuple[int, int]]]] = {}

    def piece(self, piece: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = self.kept.get(piece)
        if found is None:
            tokens = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
            found = [self.ranks[t] for t in tokens], spans(piece, tokens)
            if len(piece) <= CACHED_CHARS:
                if len(self.kept) >= CACHED_PIECES:
                    self.kept.clear()
                self.kept[piece] = found
        return found

    def texts(self, parts: pa.Array, limit: int | None) -> list[pa.Array]:
        """Ids, starts and ends of the tokens of texts given as their pieces.

        A different piece is looked up once for all texts; its occurrences are
        filled in from there."""
        sizes = _sizes(parts)
        coded = parts.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        different = coded.dictionary.to_pylist()
        found = [self.piece(p) for p in different]
        n = np.array([len(ids) for ids, _ in found], np.int64)
        ids = np.array([x for own, _ in found for x in own], np.int32)
        cover = np.array([x for _, own in found for x in own], np.int64).reshape(-1, 2)
        chars = np.array([len(p) for p in different], np.int64)[which]
        count = n[which]                                     # tokens of each piece
        token = np.arange(count.sum()) + np.repeat((np.cumsum(n) - n)[which] - np.cumsum(count) + count, count)
        row = np.repeat(np.arange(len(sizes)), sizes)
        before = _bounds(chars)[_bounds(sizes)[:-1]]         # code points of the texts before
        at = np.repeat(_bounds(chars)[:-1] - before[row], count)
        bounds = _bounds(count)[_bounds(sizes)]
        out = [ids[token], cover[token, 0] + at, cover[token, 1] + at]
        if limit is not None:
            of = np.diff(bounds)
            keep = np.arange(len(token)) - np.repeat(bounds[:-1], of) < limit
            out, bounds = [x[keep] for x in out], _bounds(np.minimum(of, limit))
        return [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int32)))
                for x in out]


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def encode(df: DataFrame, text: Column, ranks: dict[bytes, int], keep: list[str],
           max_length: int | None = None) -> DataFrame:
    """``keep`` columns and ``input_ids``, ``starts``, ``ends`` (the code points
    of ``text`` that each token covers): the first ``max_length`` tokens, or
    all. A null or empty text has none."""
    spark = df.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(ranks)               # bounded by load_ranks
    part = pieces(text)
    # every piece is a token at least, so the rest is never read
    part = F.slice(part, 1, max_length) if max_length is not None else part
    source = df.select(*keep, part.alias("_pieces"))
    schema = source.drop("_pieces").schema
    for name in ("input_ids", "starts", "ends"):
        schema = schema.add(name, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):           # texts may be long
                some = batch.slice(i, 64)
                added = encoder.texts(some.column(some.num_columns - 1), max_length)
                yield pa.RecordBatch.from_arrays(some.columns[:-1] + added, [f.name for f in schema])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "input_ids", out: str = "text") -> DataFrame:
    """``df`` with the text of ``ids``; bytes that are no UTF-8 (of a cut text)
    become the replacement character, a null array a null text."""
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})
    keep = [c for c in df.columns if c != out]
    schema = df.select(*keep).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(sent.value), np.int64)
        tokens = pa.array([sent.value[i] for i in known.tolist()], pa.large_binary())
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                texts = _joined(some.column(some.schema.get_field_index(ids)), known, tokens)
                yield pa.RecordBatch.from_arrays(some.columns + [pa.array(texts, pa.string())],
                                                 [f.name for f in schema])

    return df.select(*keep).mapInArrow(run, schema)


def _joined(rows: pa.Array, known: np.ndarray, tokens: pa.Array) -> list[str | None]:
    """The texts of rows of ids: the bytes of all their tokens in one piece, cut."""
    flat = rows.flatten()
    wanted = flat.to_numpy(zero_copy_only=False)
    at = np.searchsorted(known, wanted)
    if flat.null_count or not np.array_equal(known[np.minimum(at, len(known) - 1)], wanted):
        raise KeyError("an id is not in the vocabulary")
    taken = tokens.take(pa.array(at, pa.int64()))
    ends = _bounds(pc.binary_length(taken).to_numpy(zero_copy_only=False))[_bounds(_sizes(rows))]
    data = taken.buffers()[2]
    data = data.to_pybytes() if data is not None else b""
    return [data[a:b].decode("utf-8", "replace") if there else None
            for a, b, there in zip(ends[:-1], ends[1:], rows.is_valid().to_pylist())]


def token_uses(encoded: DataFrame, ranks: DataFrame, key: str, ids: str = "input_ids") -> DataFrame:
    """``id``, ``piece``, ``uses`` and ``rows_with`` of every vocabulary entry,
    unused ones included. Counted per row first, so a common token is one row
    a text."""
    per = encoded.select(key, F.explode(ids).alias("id")).groupBy(key, "id").agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy("id").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("rows_with"))
    return ranks.join(counts, "id", "left").select(
        "id", F.hex("piece").alias("piece"), F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("rows_with", F.lit(0)).alias("rows_with"))


def answer_labels(records: DataFrame, ranks: dict[bytes, int], key: str = "record_id",
                  problem: str = "problem", answer: str = "answer", max_length: int = 2048) -> DataFrame:
    """T5 by offsets: ``problem`` and ``answer`` are encoded as one text, and a
    token is a label if it covers a code point of the answer, also if it
    begins in the problem. Adds ``attention_mask`` and ``straddles`` (tokens
    across the border: 0 or 1)."""
    border = F.length(F.coalesce(F.col(problem), F.lit(""))).cast("int")
    text = F.concat(F.coalesce(F.col(problem), F.lit("")), F.coalesce(F.col(answer), F.lit("")))
    rows = records.select(key, text.alias("_text"), border.alias("_border"))
    enc = encode(rows, F.col("_text"), ranks, [key, "_border"], max_length)
    kept = F.transform("input_ids", lambda x, i: F.when(F.get("ends", i) > F.col("_border"), x)
                       .otherwise(F.lit(T.IGNORE_INDEX)))
    across = F.size(F.filter(F.arrays_zip("starts", "ends"), lambda s: (s["starts"] < F.col("_border"))
                             & (s["ends"] > F.col("_border"))))
    return enc.select(key, "input_ids", kept.alias("labels"),
                      F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"),
                      across.alias("straddles"))
