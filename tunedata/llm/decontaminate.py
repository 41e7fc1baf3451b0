"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item that occurs in a text with at most ``e`` edits leaves at least
one of its ``e + 1`` pieces untouched. So the pieces of all items are searched
exactly (one Aho-Corasick pass over each text), and around each hit the item is
verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import add_columns

#: Edits allowed per character of an item.
ERROR_RATE = 0.05
#: Items are searched in blocks of about so many characters, one block in each
#: worker's memory (and broadcast) at a time.
BLOCK_CHARS = 4 << 20
_BETWEEN_WORDS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower-case letters and digits; all between them is one blank."""
    return _BETWEEN_WORDS.sub(" ", (text or "").lower()).strip()


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into ``errors + 1`` parts of nearly the
    same length."""
    cuts = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, most: int) -> int:
    """The least edit distance between ``pattern`` and any substring of
    ``text``, or ``most + 1`` if above ``most``."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # a match may begin anywhere: nothing is carried into the first row
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best = score
            if best == 0:
                break
    return min(best, most + 1)


class Searcher:
    """All items of one block, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, budget(t, rate)) for i, t in items if t]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            for offset, piece in pieces(t, e):
                where.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, budget) of the items found in a text."""
        if self.empty or not text:
            return []
        t = normal(text)
        starts: dict[int, set[int]] = {}
        for end, (n, places) in self.automaton.iter(t):
            for k, offset in places:
                starts.setdefault(k, set()).add(end - n + 1 - offset)
        out: dict[int, tuple[int, int]] = {}
        for k, found in starts.items():
            ident, item, errors = self.items[k]
            best = self._verify(t, item, errors, sorted(found))
            if best <= errors:
                out[ident] = min(out.get(ident, (best, errors)), (best, errors))
        return [(i, *out[i]) for i in sorted(out)]

    @staticmethod
    def _verify(text: str, item: str, errors: int, starts: list[int]) -> int:
        """Verify around the presumed starts; near ones share a stretch."""
        best, i = errors + 1, 0
        while i < len(starts):
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= 2 * errors + 1:
                j += 1
            a = max(starts[i] - errors, 0)
            stretch = text[a: starts[j] + len(item) + errors]
            if item in stretch:
                return 0
            best = min(best, myers(item, stretch, errors))
            i = j + 1
        return best


_READY: dict[str, Searcher] = {}


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", rate: float = ERROR_RATE,
                       block_chars: int = BLOCK_CHARS, keep: list[str] | None = None
                       ) -> DataFrame:
    """One row per document row and benchmark item found in it: the ``keep``
    columns (the id by default), ``item_id``, ``distance`` (edits of the best
    place) and ``max_distance`` (``rate`` per character of the item).

    * Texts and items are compared in lower case, with one blank for all white
      space and punctuation between letters and digits. Documents without an item give no row; null and empty texts have none.
    * Null items and items without a letter or digit are never found, a null item id counts as no item.
      Of items that share an id the best match counts.
    * Long texts are searched whole. Repeated rows each give their rows. An
      empty table on either side gives an empty result; other columns are not
      read, whatever they are called.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"),
                             F.col(item_text_col).alias("t")).dropna()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    keep = [id_col] if keep is None else keep
    found = None
    for b in range(blocks):
        # one block of the stated query set, of bounded size, against all rows
        part = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(
            (uuid.uuid4().hex, sorted((r["i"], normal(r["t"])) for r in part), rate))

        def work(texts: list[str | None], shared=shared) -> list[tuple]:
            name, own, share = shared.value
            if name not in _READY:
                _READY.clear()
                _READY[name] = Searcher(own, share)
            return [(_READY[name].matches(t),) for t in texts]

        hits = add_columns(docs, text_col, keep, "_hits array<struct<item_id: long, "
                           "distance: int, max_distance: int>>", work)
        one = hits.select(*[F.col(f"`{c}`") for c in keep], F.explode("_hits").alias("_h")).select(
            *[F.col(f"`{c}`") for c in keep], "_h.*")
        found = one if found is None else found.unionByName(one)
    return found
