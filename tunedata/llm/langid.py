"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its character 1- to 4-grams (inside
words, hashed into a fixed number of rows); a linear layer and softmax over it
give the languages. Embeddings and layer are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows; a temperature and a
rejection threshold are then fitted on a part of the sample kept out of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.session import ship_package

from .arrays import mix
from .common import written
from .workers import add_columns

BITS = 18
DIM = 16
#: Bound of the sample: rows taken per language in the mean (hash-chosen).
ROWS_PER_LANG = 300
#: A language needs this many labelled rows in the sample to be learned.
MIN_ROWS = 3
EPOCHS = 8
CHUNK = 1 << 17
_SPACE = np.uint32(32)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def subwords(text: str) -> Iterator[np.ndarray]:
    """Rows of the embedding table hit by the subwords of a text, chunk by
    chunk; all characters but letters count as blanks, runs of them as one.
    Chunks overlap by the three characters that a 4-gram may reach back."""
    text = text.lower()
    for at in range(0, max(len(text), 1), CHUNK):
        a = np.frombuffer(text[max(at - 3, 0): at + CHUNK].encode("utf-32-le", "surrogatepass"),
                          np.uint32)
        a = np.where(_letters()[np.minimum(a, 0x10FFFF)], a, _SPACE)
        a = np.concatenate(([_SPACE], a, [_SPACE]))
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != _SPACE) | (a[:-1] != _SPACE)
        a = a[keep].astype(np.uint64)
        blank = a == 32
        out = []
        for n in (1, 2, 3, 4):
            if len(a) < n:
                break
            end = len(a) - n + 1
            h = np.full(end, n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + a[j: end + j]
            inner = np.zeros(end, bool)
            for j in range(1, n - 1):
                inner |= blank[j: end + j]
            if n <= 2:
                inner |= blank[:end] & blank[n - 1: end + n - 1]
            out.append(h[~inner])
        yield (mix(np.concatenate(out)) >> np.uint64(64 - BITS)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in set(text))


@dataclass
class LangModel:
    """``table``: embeddings times the linear layer, one row per hash bucket,
    and whether training saw the bucket."""

    langs: list[str]
    table: np.ndarray
    seen: np.ndarray
    temperature: float
    threshold: float
    least_seen: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        total, n, seen = np.zeros(len(self.langs)), 0, 0
        for rows in subwords(text):
            total += self.table[rows].sum(axis=0, dtype=float)
            seen += int(self.seen[rows].sum())
            n += len(rows)
        p = softmax(total / max(n, 1) / self.temperature)
        best = int(p.argmax())
        strange = p[best] < self.threshold or seen < self.least_seen * n
        return self.langs[best], float(p[best]), bool(strange)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each sampled text as sparse counts (bytes): entire, and up to three of its lines
    (spread evenly) as texts of their own, so that short texts are learned."""
    for pdf in batches:
        out = []
        for lang, order, text in zip(pdf["lang"], pdf["order"], pdf["text"]):
            lines = [x for x in text.split("\n") if has_letter(x)]
            picks = [lines[i * len(lines) // 3] for i in range(3)] if len(lines) > 3 else lines
            for part, piece in enumerate([text, *picks]):
                n = np.zeros(1 << BITS, np.int64)
                for rows in subwords(piece):
                    np.add.at(n, rows, 1)
                at = np.flatnonzero(n)
                out.append((lang, order, part, at.astype("<u4").tobytes(),
                            np.minimum(n[at], 2 ** 31).astype("<u4").tobytes()))
        yield pd.DataFrame(out, columns=["lang", "order", "part", "at", "n"])


def _descend(examples: list, n_langs: int, epochs: int) -> np.ndarray:
    """Plain stochastic gradient descent, one example a step."""
    rng = np.random.default_rng(7)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    lin = np.zeros((DIM, n_langs), np.float32)
    steps, done = max(epochs * len(examples), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            y, at, share = examples[i]
            rate = 0.5 * (1 - done / steps)
            done += 1
            x = share @ emb[at]
            g = softmax(x @ lin)
            g[y] -= 1
            back = lin @ g
            lin -= rate * np.outer(x, g)
            # an embedding moves by its share of the text, times a fixed gain
            # that makes up for the average over many subwords
            emb[at] -= rate * 20 * np.outer(share, back)
    return emb @ lin


def train_langid(docs: DataFrame, allowed: Column, *, lang_col: str = "lang",
                 text_col: str = "text", id_col: str = "doc_id",
                 rows_per_lang: int = ROWS_PER_LANG) -> LangModel:
    """Fit on at most about ``rows_per_lang`` rows of each language among the
    rows with ``allowed``, a non-null language and a letter in the text.

    Rows are chosen by a hash of id and text, at a rate that follows the number
    of rows of their language, so rare languages weigh as much as common ones.
    With no such row the model knows no language and calls all texts ``und``.
    """
    rows = docs.filter(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # written first, so that its size is known when the join is planned
    rates = written(rows.groupBy(F.col(lang_col).alias("lang"))
                    .agg(F.count(F.lit(1)).alias("n_rows")), "langid-rates")
    order = F.xxhash64(F.lit("langid"), F.col(id_col), F.col(text_col))
    picked = (rows.select(F.col(lang_col).alias("lang"), order.alias("order"),
                          F.col(text_col).alias("text"))
              .join(rates, "lang")
              .filter(F.pmod("order", F.lit(1 << 30)) / F.lit(float(1 << 30))
                      < F.lit(float(rows_per_lang)) / F.col("n_rows"))
              .filter(F.col("text").rlike(r"\p{L}")).select("lang", "order", "text"))
    ship_package(docs.sparkSession)
    got = picked.mapInPandas(
        _examples, "lang string, order long, part int, at binary, n binary").toPandas()
    return fit(got)


def fit(got: pd.DataFrame) -> LangModel:
    got = got.sort_values(["order", "part", "lang"], kind="stable")
    n_rows = got[got["part"] == 0].groupby("lang").size()
    langs = sorted(n_rows[n_rows >= MIN_ROWS].index)
    if not langs:
        langs = sorted(n_rows.index)
    index = {x: i for i, x in enumerate(langs)}
    train, kept = [], []
    for lang, order, part, at, n in got.itertuples(index=False):
        if lang in index and len(at):
            at, n = np.frombuffer(at, "<u4"), np.frombuffer(n, "<u4")
            (kept if order % 5 == 0 else train).append(
                (index[lang], at, (n / n.sum()).astype(np.float32), part == 0))
    if not langs:
        return LangModel([], np.zeros((1 << BITS, 0)), np.zeros(1 << BITS, bool), 1.0, 0.0, 0.0)
    table = _descend([x[:3] for x in train or kept], len(langs), EPOCHS)
    held = kept or train
    seen = np.zeros(1 << BITS, bool)
    for _, at, _, _ in train or kept:
        seen[at] = True
    table[~seen] = 0                     # what nothing was learned of says nothing
    logits = np.array([share @ table[at] for _, at, share, _ in held]).reshape(-1, len(langs))
    gold = np.array([y for y, *_ in held], int)
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(gold)), gold] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
    p = softmax(logits / temperature)
    right = p[(p.argmax(axis=1) == gold) & np.array([x[3] for x in held])].max(axis=1, initial=0)
    # rejected is what is less sure than nearly all rightly named texts, but
    # nothing surer than half way from chance to even odds (texts in several
    # languages stay); and what has fewer subwords
    # seen in training than half way from chance to nearly all labelled texts
    floor = float(np.quantile(right, 0.002)) if len(right) else 0.0
    shares = [share[seen[at]].sum() for _, at, share, entire in held if entire]
    least_seen = (float(seen.mean()) + float(np.quantile(shares, 0.002))) / 2 if shares else 0.0
    return LangModel(langs, table, seen, temperature,
                     min(max(floor, 1.2 / len(langs)), (1 / len(langs) + 0.5) / 2), least_seen)


def predict_languages(docs: DataFrame, model: LangModel, *, text_col: str = "text",
                      keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The ``keep`` columns (``doc_id`` by default), then ``lang_pred``,
    ``score`` and ``rejected``, each name after ``prefix``, for each row.

    * A null text, or one without a letter, is ``und`` with score 0, rejected.
    * ``rejected``: the calibrated probability, or the share of subwords that
      training has seen, is under its fitted threshold.
    * Long texts are read whole, in chunks. Repeated rows each get a row; ties
      go to the language that sorts first; an empty table gives no rows.
      Columns outside ``keep`` are not read, whatever they are called.
    """
    # a table of 2^BITS rows by languages, whatever the size of the corpus
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(
        docs, text_col, ["doc_id"] if keep is None else keep,
        f"`{prefix}lang_pred` string, `{prefix}score` double, `{prefix}rejected` boolean",
        lambda texts: [shared.value.predict(t) for t in texts])
