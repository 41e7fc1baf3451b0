"""Toxicity: gradient-boosted trees over dense features, with isotonic
calibration.

The features are densities of a fixed and a learned lexicon (words and word
beginnings), second-person words near lexicon hits, capitals, punctuation and
obfuscation rates. The lexicon is learned on one half of the sampled labelled
rows, the trees on the other, so that the trees see lexicon hits as they will
be on new texts. Trees and calibration are plain numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .workers import add_columns

#: Bound of the sample of labelled rows (hash-chosen, all labels alike).
SAMPLE_ROWS = 12_000
#: A word or beginning enters the learned lexicon with this log-odds and this
#: share of the toxic rows (and MIN_TOXIC of them).
MIN_LOG_ODDS = 2.0
MIN_SHARE = 0.004
MIN_TOXIC = 3
STEM = range(4, 9)
NEAR = 5

# Common insults.
INSULTS = frozenset("""
    arse arsehole ass asshole bastard bitch bollocks clown coward crap creep cretin cunt damn
    degenerate dick dickhead dimwit disgusting douche dumb dumbass filth filthy fool freak fuck
    fucker fucking garbage halfwit idiot idiotic idiots imbecile jackass jerk liar loser losers
    lunatic maggot moron moronic morons motherfucker nitwit parasite pathetic pervert pig prick
    psycho punk retard scum scumbag shit shithead shitty sleazy slob slut sucker stupid swine
    thug trash trashy twat ugly vermin whore worthless wanker weasel wimp wretch
""".split())
# Words of the second person.
SECOND_PERSON = frozenset("""
    you your yours yourself yourselves ur u du dich dir dein deine deinen deiner deines ihr euch
    euer eure tu te toi ton ta tes vous votre vos tú ti tuyo tus usted ustedes vosotros vos
""".split())

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SIGN_BEFORE_LETTER = re.compile(r"[\d@$!|*+]+(?=[^\W\d_])")
_SIGN_IN_WORD = re.compile(r"[.\-_]+(?=[^\W\d_])|[\d@$!|*+]+(?![^\W_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
# Signs that stand for letters.
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
                        "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"})
FEATURES = ["n_words", "insult_density", "insults", "learned_density", "learned", "strongest",
            "stem_density", "stems", "near_second_person", "second_person", "capitals",
            "capital_words", "exclamations", "questions", "repeated_marks", "masked", "spaced",
            "stretched", "unmasked"]


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def _plain(token: str) -> str:
    return re.sub(r"[\W\d_]+", "", token.lower().translate(_SIGNS))


def _masked(text: str) -> list[str]:
    """Tokens of up to 24 characters with a sign or digit before a letter, at
    the front or after a letter."""
    out, last = [], -1
    for m in _SIGN_BEFORE_LETTER.finditer(text):
        a = m.start()
        if a < last or (a and not (text[a - 1].isspace() or text[a - 1].isalpha())):
            continue
        first, last = a, m.end()
        while first and not text[first - 1].isspace() and a - first < 24:
            first -= 1
        while last < len(text) and not text[last].isspace() and last - first <= 24:
            last += 1
        if 3 <= last - first <= 24:
            out.append(text[first:last])
    return out


def _joined(text: str, masked: list[str], lexicon: Lexicon) -> list[str]:
    """Tokens of up to 24 characters, besides those ``masked``, with a sign or
    digit at the end of a word or a dot, hyphen or underscore between letters,
    put together; only insults and learned words, as those signs are mostly
    punctuation."""
    out, last, seen = [], -1, set(masked)
    for m in _SIGN_IN_WORD.finditer(text):
        a = m.start()
        if a < last or not a or not text[a - 1].isalpha():
            continue
        first, last = a, m.end()
        while first and not text[first - 1].isspace() and a - first < 24:
            first -= 1
        while last < len(text) and not text[last].isspace() and last - first <= 24:
            last += 1
        token = text[first:last]
        if not 3 <= last - first <= 24 or token in seen:
            continue
        # the last marks of a token may be letters, or end a sentence
        for t in (token, token.rstrip("!*+|.,;:?\"')]")):
            p = _plain(t)
            if p in INSULTS or p in lexicon.words:
                if any(c in "$@|!*+.-_" or c.isdigit() for c in t):
                    out.append(p)
                break
    return out


def _stretched(text: str) -> list[str]:
    """Words with a letter three times or more in a row, without the repeats."""
    out, last = [], -1
    for m in _STRETCHED.finditer(text):
        a, b = m.span()
        if a < last:
            continue
        while a and text[a - 1].isalpha():
            a -= 1
        while b < len(text) and text[b].isalpha():
            b += 1
        last = b
        out.append(_STRETCHED.sub(r"\1", text[a:b]))
    return out


def _spaced(words: list[str], singles: list[int]) -> list[str]:
    """Runs of three or more one-letter words, each run put together."""
    out, run = [], 0
    for k in range(len(singles)):
        if k + 1 == len(singles) or singles[k + 1] != singles[k] + 1:
            if k - run >= 2:
                out.append("".join(words[i] for i in singles[run: k + 1]))
            run = k + 1
    return out


#: What is known of a word, kept for the words met last: (learned weight,
#: stem weight, insult, second person, one letter), or None for a word without
#: any of it.
_KNOWN: dict[str, tuple | None] = {}
_KEPT_WORDS = 400_000
_USED: list[Lexicon] = []


def _use(lexicon: Lexicon) -> None:
    """What is known of words holds for one lexicon."""
    if not _USED or _USED[0] != lexicon:
        _USED[:] = [lexicon]
        _KNOWN.clear()


def _look_up(w: str, lexicon: Lexicon) -> tuple | None:
    stem = 0.0
    if lexicon.stems and len(w) > STEM[0]:
        stem = max((lexicon.stems.get(w[:k], 0.0) for k in STEM if k < len(w)), default=0.0)
    found = (lexicon.words.get(w, 0.0), stem, w in INSULTS, w in SECOND_PERSON, len(w) == 1)
    if len(_KNOWN) >= _KEPT_WORDS:
        _KNOWN.clear()
    _KNOWN[w] = found = found if any(found) else None
    return found


def _upper(text: str) -> int:
    low = text.lower()
    if low == text:
        return 0
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (text, low))
    # the lower case of a few letters has another length
    return int((a != b).sum()) if len(a) == len(b) else sum(map(str.isupper, text))


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of an entire text; all 0 for a null or empty one."""
    text = text or ""
    found = _WORD.findall(text)
    words = " ".join(found).lower().split(" ") if found else []
    n = max(len(words), 1)
    learned: list[float] = []
    stems: list[float] = []
    hits: list[int] = []
    you: list[int] = []
    singles: list[int] = []
    insults = 0
    for i, w in enumerate(words):
        known = _KNOWN[w] if w in _KNOWN else _look_up(w, lexicon)
        if known is None:
            continue
        weight, stem, insult, second, single = known
        if weight:
            learned.append(weight)
        if stem:
            stems.append(stem)
        if weight or insult:
            hits.append(i)
        insults += insult
        if second:
            you.append(i)
        if single:
            singles.append(i)
    near = _near(hits, you)
    masked = _masked(text)
    joined = _joined(text, masked, lexicon)
    spaced = _spaced(words, singles)
    plain = [_plain(t) for t in masked] + joined + spaced
    long = _stretched(text.lower())
    unmasked = sum(p in INSULTS or p in lexicon.words for p in plain + long)
    letters = sum(map(len, found))
    return [
        float(np.log1p(len(words))), insults / n, float(insults), sum(learned) / n,
        float(len(learned)), max([*learned, *stems], default=0.0), sum(stems) / n,
        float(len(stems)), near / n, len(you) / n, _upper(text) / max(letters, 1),
        sum(map(str.isupper, found)) / n, text.count("!") / n, text.count("?") / n,
        (text.count("!!") + text.count("??")) / n, (len(masked) + len(joined)) / n, len(spaced) / n,
        len(long) / n, float(unmasked)]


def _near(hits: list[int], you: list[int]) -> int:
    """How many hits have a word of the second person within NEAR words."""
    if not hits or not you:
        return 0
    at, marks = np.asarray(hits), np.asarray(you)
    left = np.searchsorted(marks, at - NEAR)
    return int((left < np.searchsorted(marks, at + NEAR, side="right")).sum())


@dataclass
class Trees:
    """Boosted trees of depth 3 on binned features, logistic loss."""

    edges: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        bins = _bins(x, self.edges)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[np.arange(len(x)), feature[node]] > cut[node])
            out += value[node - (2 ** DEPTH - 1)]
        return out


DEPTH = 3
ROUNDS = 60
RATE = 0.15
LEAST = 1.0


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower")) for c in x.T]
    edges = [np.unique(np.concatenate((e, [c.min()]))) for e, c in zip(edges, x.T)]
    bins = _bins(x, edges)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    model, margin = Trees(edges, base, []), np.full(len(y), base)
    width = max(len(e) for e in edges) + 1
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(2 ** DEPTH - 1, int), np.full(2 ** DEPTH - 1, width)
        node = np.zeros(len(y), int)
        for level in range(DEPTH):
            for k in range(2 ** level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                if len(rows) > 1:
                    feature[k], cut[k] = _split(bins[rows], grad[rows], hess[rows], width)
            node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2 ** DEPTH - 1)
        g, h = np.bincount(leaf, grad, 2 ** DEPTH), np.bincount(leaf, hess, 2 ** DEPTH)
        value = RATE * g / (h + LEAST)
        margin = margin + value[leaf]
        model.trees.append((feature, cut, value))
    return model


def _split(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, width: int) -> tuple[int, int]:
    best = (1e-9, 0, width)
    for j in range(bins.shape[1]):
        g = np.cumsum(np.bincount(bins[:, j], grad, width))
        h = np.cumsum(np.bincount(bins[:, j], hess, width))
        gain = (g[:-1] ** 2 / (h[:-1] + LEAST) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + LEAST)
                - g[-1] ** 2 / (h[-1] + LEAST))
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, k)
    return best[1], best[2]


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the non-decreasing rates at them."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []       # sum, weight, lowest and highest margin
    for m, v in zip(margin[order], y[order]):
        blocks.append([float(v), 1.0, float(m), float(m)])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]
                                   or blocks[-2][3] == blocks[-1][2]):
            s, w, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = high
    xs = np.array([b[i] for b in blocks for i in (2, 3)])
    return xs, np.repeat([b[0] / b[1] for b in blocks], 2)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees | None
    margins: np.ndarray
    rates: np.ndarray

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        _use(self.lexicon)
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, len(FEATURES))
        if self.trees is None:
            return np.zeros(len(x))
        margin = self.trees.margin(x)
        # the calibrated rate; margins order texts inside one of its steps
        return 0.99 * np.interp(margin, self.margins, self.rates) + 0.01 / (1 + np.exp(-margin))


def _terms(text: Column) -> Column:
    """The distinct words of a text, and the beginnings of 4 to 8 letters of
    longer ones, marked by a trailing '*'."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)))
    stems = F.flatten(F.transform(words, lambda w: F.transform(
        F.filter(F.array(*[F.lit(k) for k in STEM]), lambda k: k < F.length(w)),
        lambda k: F.concat(F.substring(w, F.lit(1), k), F.lit("*")))))
    return F.array_distinct(F.concat(words, stems))


def _lexicon(rows: DataFrame) -> Lexicon:
    """Terms with their log-odds between toxic and other rows of the sample."""
    sizes = rows.agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).first()
    toxic, clean = sizes["t"] or 0, sizes["c"] or 0
    if not toxic or not clean:
        return Lexicon()
    seen = (rows.select("y", F.explode(_terms(F.col("text"))).alias("term")).groupBy("term")
            .agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")))
    odds = (F.log((F.col("t") + 0.5) / F.lit(toxic + 1.0))
            - F.log((F.col("c") + 0.5) / F.lit(clean + 1.0)))
    got = (seen.filter(F.col("t") >= max(MIN_TOXIC, MIN_SHARE * toxic))
           .select("term", odds.alias("odds")).filter(F.col("odds") >= MIN_LOG_ODDS).collect())
    # the bound: terms in at least MIN_SHARE of at most SAMPLE_ROWS texts
    return Lexicon({r["term"]: r["odds"] for r in got if not r["term"].endswith("*")},
                   {r["term"][:-1]: r["odds"] for r in got if r["term"].endswith("*")})


def train_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, *,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on about ``sample_rows`` labelled rows, or all if fewer (``allowed`` is
    a condition on ``id_col`` of ``labels``); a document with several labels counts as
    toxic if one of them says so. Without labels of both kinds the model scores
    0 for every text."""
    usable = labels.filter(allowed & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rate = sample_rows / max(usable.count(), 1)
    order = F.xxhash64(F.lit("toxicity"), F.col(id_col))
    chosen = (usable.filter(F.pmod(order, F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(rate))
              .groupBy(F.col(id_col).alias("_id"), order.alias("order"))
              .agg(F.max((F.col(label_col) > 0).cast("int")).alias("y")))
    # about sample_rows rows of two longs and an int
    texts = docs.select(F.col(id_col).alias("_did"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = written(texts.join(F.broadcast(chosen), F.col("_did") == F.col("_id"))
                   .select("order", "y", "text"), "toxicity-sample")
    part = F.pmod(F.shiftright("order", 32), F.lit(2))
    lexicon = _lexicon(rows.filter(part == 0))
    names = ", ".join(f"f{i} double" for i in range(len(FEATURES)))
    def work(texts: list[str | None]) -> list[tuple]:
        _use(lexicon)
        return [tuple(features(t, lexicon)) for t in texts]

    got = add_columns(rows.filter(part == 1), "text", ["order", "y"], names, work).toPandas()
    return fit(lexicon, got)


def fit(lexicon: Lexicon, got: pd.DataFrame) -> ToxicityModel:
    got = got.sort_values(list(got.columns), kind="stable")
    x = got[[f"f{i}" for i in range(len(FEATURES))]].to_numpy(float)
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        return ToxicityModel(lexicon, None, np.zeros(1), np.zeros(1))
    fold = np.arange(len(y)) % 4           # the rows are in hash order
    margin = np.zeros(len(y))
    for k in range(4):
        inside = fold != k
        margin[~inside] = boost(x[inside], y[inside]).margin(x[~inside])
    return ToxicityModel(lexicon, boost(x, y), *isotonic(margin, y))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id",
                   text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The id, ``score`` (0 to 1) and ``predicted`` (1 if the score reaches
    ``threshold``) of each row.

    * Null and empty texts get the score of a text without any feature. Long
      texts are read whole. Repeated rows each get a row, an empty table gives
      none; columns besides id and text are not read, whatever they are called.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)   # bounded by the sample

    def work(texts: list[str | None]) -> list[tuple]:
        return [(float(s), int(s >= threshold)) for s in shared.value.scores(texts)]

    return add_columns(docs, text_col, [id_col], "score double, predicted int", work)
