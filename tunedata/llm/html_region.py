"""HTML extraction by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score positive and tags
negative, each by the kind of place it stands in; the weights are log-odds
learned from labelled pages (words and tags inside and outside the marked main
element). One linear scan finds the contiguous region with the highest sum, and
the text blocks inside it are the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import add_columns

#: Bound of the sample of labelled pages (hash-chosen).
SAMPLE_PAGES = 2_000

# Names of HTML elements by their part in a page.
RAW = frozenset("script style noscript template textarea svg math iframe object canvas select "
                "option datalist title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""
    address article aside blockquote body center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav
    ol p pre search section summary table tbody td tfoot th thead tr ul
""".split())
CHROME = frozenset("nav aside footer form menu head button dialog search".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert "
                         "alertdialog dialog menu menubar toolbar".split())
# Parts of class and id names of menus, notices, adverts and
# reader comments.
CHROME_NAMES = re.compile(r"""(?x)(?<![a-z0-9])(?:
    ads?|adverts?|advertisement|advertising|advertorial|adbox|adsense|sponsor(?:ed|s)?|promos?|
    promotion|banner|cookies?|consent|gdpr|notices?|notification|alert|newsletter|subscribe|
    subscription|signup|sign-up|login|paywall|sidebar|side-bar|sidenav|rail|widgets?|menu|
    menus|nav|navbar|navigation|breadcrumbs?|crumbs|topbar|masthead|site-header|page-header|
    header|footer|site-footer|colophon|copyright|share|sharing|social|related|recommended|
    recommendations|trending|popular|comments?|commentlist|comment-list|respond|replies|disqus|
    popup|modal|overlay|pagination|pager|skip-link|search|toolbar|tags|tagcloud)(?![a-z0-9])""")
# Parts that leave such a name what it is ('related-posts'); with
# any other part it names something else ('related-work', 'article-header').
CHROME_PARTS = frozenset("""
    a area articles bar blocks block bottom box btn button buttons center code col column container
    content contents footer form global group header holder icon icons id inline inner item items
    js left link links list main media message mobile module news notice outer page pages panel policy
    posts primary region right row secondary section site slot stories strip text title top
    unit user view wrap wrapper
""".split())
_NAME_PART = re.compile(r"[-\d]+")
# 'has-sidebar' and the like say what else is on the page
_SAYS = re.compile(r"(?:has|have|no|with|without)-")

_PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>""",
                    re.S | re.X)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""",
                   re.I)
_BLANKS = re.compile(r"\s+")


@dataclass
class Run:
    """A stretch of text in one place: its block, its decoded words and the
    kind of place; or (``words`` None) a tag of that kind."""

    kind: tuple
    block: int
    text: str
    words: int | None


def _chrome_name(value: str) -> bool:
    """Whether one of the names in a class or id is that of a menu, a notice,
    an advert or the like."""
    for name in value.replace("_", "-").split():
        if CHROME_NAMES.search(name) and not _SAYS.match(name):
            rest = _NAME_PART.split(CHROME_NAMES.sub("", name))
            if all(part in CHROME_PARTS for part in rest if part):
                return True
    return False


def _is_chrome(name: str, attributes: str, inside: int) -> str:
    """'fixed' for an element that is no main text by its kind, role or state,
    'named' for a form or one by its class or id alone, else ''."""
    if name in CHROME or (name == "header" and not inside):
        return "named" if name == "form" else "fixed"
    if name in MAIN or name in ("html", "body"):
        inner = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attributes)}
        return "fixed" if name == "article" and re.search(
            r"(?<![a-z])(comment|advert|promo|ad)", inner.get("class", "")) else ""
    named = ""
    for key, value in _ATTR.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if (key == "hidden" or (key == "aria-hidden" and value == "true")
                or (key == "role" and value in CHROME_ROLES)):
            return "fixed"
        if key in ("class", "id") and name not in HEADINGS and _chrome_name(value):
            named = "named"
    return named


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str, bool]]:
    """(start, end, closing, name, attributes, raw) of tags and comments (name
    ''); the next tag after a raw one is its closing tag, if there is any."""
    at, unclosed = 0, set()
    while True:
        at = page.find("<", at)
        if at < 0:
            return
        m = _PIECE.match(page, at) or _LOOSE.match(page, at)
        if m is None:
            at += 1
            continue
        name = (m[2] or "").lower()
        start, at, close = at, m.end(), None
        raw = name in RAW and not m[1]
        if raw and name not in ("script", "style") and (m[3] or "").rstrip().endswith("/"):
            raw = False
        if raw and name not in unclosed:
            close = re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if close is None:
                unclosed.add(name)
        # what never closes holds nothing, but for code
        raw = raw and (close is not None or name in ("script", "style"))
        yield start, at, bool(m[1]), name, m[3] or "", raw
        if raw:
            at = close.start() if close else len(page)


def runs(page: str) -> tuple[list[Run], bool]:
    """The page as a sequence of words and tags outside menus, notices and the
    like, and whether it marks its main element."""
    marked = any(name in MAIN and not closing for _, _, closing, name, _, _ in _tags(page))
    out: list[Run] = []
    last, block, inside, link, item = 0, 0, 0, 0, "p"
    skipped, depth, raw, named = "", 0, "", False
    opened: set[str] = set()

    def place() -> str:
        return ("in" if inside else "out") if marked else "any"

    def flush(until: int) -> None:
        if not skipped and not raw and until > last:
            text = html.unescape(page[last:until])
            if text:
                n = len(text.split())
                out.append(Run(("word", place(), item, link > 0), block, text, n))

    for start, end, closing, name, attributes, holds in _tags(page):
        flush(start)
        last = end
        if name == "":
            continue
        if raw:
            if closing and name == raw:
                raw = ""
            continue
        if skipped:
            if name == skipped:
                depth += -1 if closing else 1
                if depth == 0:
                    skipped = ""
                    block += 1
                continue
            # an unclosed menu ends where the main element begins, or the page
            # ends; and what only its name calls a menu is none if it holds the
            # page's first main element
            if not (name in MAIN and not closing and (
                    skipped in ("head", "nav", "header")
                    or (named and name not in opened
                        and not _is_chrome(name, attributes, inside)))):
                if not (name in MAIN and closing and inside):
                    continue
            skipped, depth = "", 0
            block += 1
        if name in RAW:
            raw = name if holds else ""
            continue
        chrome = "" if closing or name in VOID else _is_chrome(name, attributes, inside)
        if chrome:
            if not attributes.rstrip().endswith("/"):
                skipped, depth, named = name, 1, chrome == "named"
            out.append(Run(("chrome", place()), block, "", None))
            block += 1
            continue
        if name in MAIN:
            opened.add(name)
            inside = max(inside + (-1 if closing else 1), 0)
        elif name == "a":
            link = max(link + (-1 if closing else 1), 0)
        if name in BLOCKS:
            block += 1
            link = 0
            if closing:
                item = "p" if name in HEADINGS or name in ("li", "p", "td", "th") else item
            elif name in HEADINGS:
                item = "h"
            elif name in ("li", "td", "th", "dt", "dd"):
                item = "li"
            else:
                item = "p"
        elif name == "br":
            out.append(Run(("tag", place(), "br"), block, " ", None))
            continue
        out.append(Run(("tag", place(), "block" if name in BLOCKS else "inline"), block, "", None))
    flush(len(page))
    return out, marked


def counts(page: str) -> tuple[Counter, Counter]:
    """Words and tags by kind, inside and outside the marked main element; each
    is counted by its place, and again as on a page without a mark."""
    inner, outer = Counter(), Counter()
    for r in runs(page)[0]:
        side = inner if r.kind[1] == "in" else outer
        n = 1 if r.words is None else r.words
        side[r.kind] += n
        side[(r.kind[0], "any", *r.kind[2:])] += n
    return inner, outer


@dataclass
class RegionModel:
    weights: dict[tuple, float]

    def weight(self, kind: tuple) -> float:
        w = self.weights.get(kind)
        if kind[0] == "word":
            return w if w is not None else (0.3 if kind[1] != "out" and not kind[-1] else -1.0)
        # tags never speak for a region
        return min(w, 0.0) if w is not None else -0.02

    def extract(self, page: str | None) -> str:
        """The text blocks inside the best region, joined by line breaks."""
        seq, _ = runs(page or "")
        score = np.array([self.weight(r.kind) * (1 if r.words is None else r.words)
                          for r in seq])
        first, end = best_region(score)
        blocks: dict[int, list[str]] = {}
        for r in seq[first:end]:
            if r.text:
                blocks.setdefault(r.block, []).append(r.text)
        texts = (_BLANKS.sub(" ", "".join(b)).strip() for b in blocks.values())
        return "\n".join(t for t in texts if t)


def best_region(score: np.ndarray) -> tuple[int, int]:
    """[first, end) of the contiguous run with the highest positive sum, the
    longest such run; (0, 0) if nothing scores above 0. One pass."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(score):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best > 0):
            best, found = total, (start, i + 1)
    return found


def train_region(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html",
                 sample_pages: int = SAMPLE_PAGES) -> RegionModel:
    """Weights from about ``sample_pages`` pages (or all, if fewer) that mark
    their main element (article or main), chosen by hash. Without any, words weigh 0.3 and tags -0.02."""
    order = F.xxhash64(F.lit("region"), F.col(id_col), F.col(html_col))
    marked = pages.filter(F.col(html_col).rlike(r"(?i)<(article|main)[\s>]"))
    rate = sample_pages / max(marked.count(), 1)
    chosen = (marked.select(order.alias("order"), F.col(html_col).alias("html"))
              .filter(F.pmod("order", F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(rate)))

    def work(texts: list[str | None]) -> list[tuple]:
        out = []
        for t in texts:
            inner, outer = counts(t or "")
            kinds = list({**inner, **outer})
            out.append((["|".join(map(str, k)) for k in kinds], [float(inner[k]) for k in kinds],
                        [float(outer[k]) for k in kinds]))
        return out

    got = add_columns(chosen, "html", [], "k array<string>, i array<double>, o array<double>", work)
    sums = (got.select(F.explode(F.arrays_zip("k", "i", "o")).alias("x")).groupBy("x.k")
            .agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o")).collect())   # a few dozen kinds
    return fit({r["k"]: r["i"] for r in sums}, {r["k"]: r["o"] for r in sums})


def fit(inner: dict[str, float], outer: dict[str, float]) -> RegionModel:
    weights = {}
    for what in ("word", "tag", "chrome"):
        keys = {k for k in {*inner, *outer} if k.startswith(what)}
        totals = [sum(v for k, v in side.items() if k in keys) + 1 for side in (inner, outer)]
        for k in keys:
            odds = (np.log((inner.get(k, 0) + 0.5) / totals[0])
                    - np.log((outer.get(k, 0) + 0.5) / totals[1]))
            weights[_kind(k)] = float(np.clip(odds, -4, 4))
    # a word where main text stands counts for it, whatever the shares of kinds
    for k, w in weights.items():
        if k[0] == "word" and k[1] == "in":
            weights[k] = max(w, 0.3 if not k[-1] else 0.05)
        elif k[0] == "word" and k[1] == "out":
            weights[k] = min(w, -0.3)
        elif k[0] == "word" and k[2] in ("p", "h") and not k[-1]:
            weights[k] = max(w, 0.2)
        elif k[0] == "tag" and k[1] != "out":
            weights[k] = float(np.clip(w, -0.05, -0.02))
        elif k[0] == "chrome" and k[1] != "out":
            weights[k] = float(np.clip(w, -1.0, -0.2))
    return RegionModel(weights)


def _kind(key: str) -> tuple:
    parts = key.split("|")
    return (*parts[:3], parts[3] == "True") if parts[0] == "word" else tuple(parts)


def extract_text(pages: DataFrame, model: RegionModel, *, id_col: str = "page_id",
                 html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (``page_id``, ``url`` by default), ``text`` and
    ``n_chars`` of each page.

    * A null or empty page, or one without words, has text '' and 0 characters.
    * Markup that never closes (also a page cut off anywhere) is read to the
      end. Long pages are read whole, in one linear scan. Repeated rows each
      get a row; ties go to the longest, then the earliest region; an empty
      table gives none. Other columns are not read, whatever they are called.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)   # a few dozen weights

    def work(texts: list[str | None]) -> list[tuple]:
        found = [shared.value.extract(t) for t in texts]
        return [(x, len(x)) for x in found]

    return add_columns(pages, html_col, [id_col, "url"] if keep is None else keep,
                       "text string, n_chars long", work)
