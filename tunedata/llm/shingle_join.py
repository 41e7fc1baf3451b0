"""Jaccard join of shingle sets by a token-group matrix.

A text is the set of its shingles of four words. Similar sets are put into
groups; the matrix tells which shingles occur in any set of a group (the
group's union). The share of a set that lies in a union bounds its similarity
to every set of the group, so only groups whose bound reaches the threshold are
opened, and their sets compared one by one.

The matrix is probed through the rarest shingles of a set only: two sets that
link share one of them (prefix filter), so very common shingles make no
candidates. Candidates that links already connect are left out, which keeps a
large family of copies from being compared pair by pair.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.session import ship_package

from .arrays import windows, word_hashes
from .common import among, written
from .grouped import GROUP_ITEMS, compared, grouped, members
from .near_dup import components
from .sketch import count_slots
from .workers import add_columns

SHINGLE = 4
PERCENT = 85
#: Slots of the count sketch that orders shingles. It decides how many
#: candidates there are, never which links are found.
SKETCH_BITS = 21
#: How often sets that share too few shingles are left out.
ROUNDS = 2


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct shingles of texts as sorted hashes; words are compared
    with A-Z in lower case."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    return [np.unique(windows(h, SHINGLE)) for h in word_hashes(raw)]


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def set_id(tokens: np.ndarray) -> bytes | None:
    return blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def probe_length(n):
    """So many of its rarest shingles find every set that links with one of
    ``n`` shingles and is no longer."""
    return n - (PERCENT * n + 99) // 100 + 1


def index_length(n):
    """So many of its rarest shingles are found by every set that links with
    one of ``n`` shingles and is no shorter: the two share 2 * PERCENT /
    (100 + PERCENT) of the shorter one at least."""
    return n - F.ceil(F.lit(2.0 * PERCENT) * n / (100 + PERCENT) - F.lit(1e-9)).cast("int") + 1


def shared_length(n):
    """So many common shingles (one at least) are asked for before a set is
    compared at all; ``probe`` is longer than ``probe_length`` by as many, so
    that sets which link share them in it (the k-th common shingle of two such
    sets is at most k - 1 places behind the first prefix)."""
    return n // 20


def _signed(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """``id``, ``digest`` of the text, ``n``, ``node`` (the set's id, null if
    empty), ``probe`` (its rarest shingles, rarest first) and ``least`` (its
    smallest hash) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)       # 2^SKETCH_BITS bytes

    def work(texts: list[str | None]) -> list[tuple]:
        seen: dict[str | None, tuple] = {}
        distinct = list(dict.fromkeys(texts))
        for text, s in zip(distinct, shingle_sets(distinct)):
            length = probe_length(len(s)) + max(shared_length(len(s)) - 1, 0)
            order = np.argsort(sent.value[_slots(s)], kind="stable")[:length]
            seen[text] = (len(s), set_id(s), s[order].view(np.int64) if len(s) else [],
                          int(s[0].view(np.int64)) if len(s) else None)
        return [seen[t] for t in texts]

    return add_columns(docs, "text", ["id", "digest"],
                       "n int, node binary, probe array<long>, least long", work)


# ---- groups -------------------------------------------------------------------

class Group:
    """Sets of a group: their union and which of them hold each of its shingles."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        self.union, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.holds = np.zeros((len(sets), len(self.union)), bool)
        self.holds[np.repeat(np.arange(len(sets)), self.sizes), at] = True

    def links(self, tokens: np.ndarray) -> np.ndarray:
        """Which sets of the group link with the set ``tokens``; the group is
        opened only if enough of them lie in its union."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if 100 * len(at) < PERCENT * len(tokens):
            return np.zeros(len(self.sets), bool)
        both = self.holds[:, at].sum(axis=1)
        return 100 * both >= PERCENT * (len(tokens) + self.sizes - both)

    def parts(self, nodes: list[bytes]) -> list[bytes]:
        """For each set the smallest of ``nodes`` that links inside the group
        connect it with."""
        label = list(range(len(self.sets)))
        for i, s in enumerate(self.sets):
            joined = {label[j] for j in np.flatnonzero(self.links(s)).tolist()} | {label[i]}
            if len(joined) > 1:
                label = [min(joined) if x in joined else x for x in label]
        least: dict[int, bytes] = {}
        for x, node in zip(label, nodes):
            least[x] = min(least.get(x, node), node)
        return [least[x] for x in label]


def _tokens(item: bytes) -> np.ndarray:
    return np.frombuffer(item, np.uint64)


def _group(items: list[bytes]) -> Group:
    return Group([_tokens(i) for i in items])


def _labels(nodes: list[bytes], items: list[bytes], _: list) -> list[bytes]:
    return _group(items).parts(nodes) if len(nodes) > 1 else nodes


# ---- candidates and links -------------------------------------------------------

def _close(n: Column, size: Column) -> Column:
    """Whether sets of ``n`` and ``size`` shingles can link."""
    return 100 * F.least(n, size) >= PERCENT * F.greatest(n, size)


def _least(n: Column) -> Column:
    """The fewest shingles of a set that links with one of ``n``."""
    return F.ceil(n * (PERCENT / 100) - 1e-9).cast("int")


def _need(n: Column) -> Column:
    """So many shingles of its ``probe`` a set of ``n`` shares with any that it
    links with: the other may be the shorter one, with a shorter probe."""
    return F.greatest(F.floor(_least(n) / 20).cast("int"), F.lit(1))


def _enough(n: Column, at: Column, size: Column) -> Column:
    """Whether a set of ``n`` shingles whose first common one is numbered
    ``at`` can link with one of ``size`` or more."""
    return (100 + PERCENT) * (n - at) >= PERCENT * (n + size)


def pivot_candidates(rows: DataFrame, member: DataFrame, central: DataFrame) -> DataFrame:
    """``query``, ``grp``: each set with the group of the most central set that
    each of its shingles leads to, for shingles of more sets than a group holds.
    One row a shingle, however common; families that fit a group need none."""
    rows = rows.filter((F.col("at") <= F.col("n") - _least(F.col("n"))) & (F.col("k") > GROUP_ITEMS))
    index = rows.filter(F.col("at") < index_length(F.col("n")))
    pivot = (index.join(central, "node").groupBy("token")
             .agg(F.max(F.struct("central", "node", "n")).alias("p"))
             .select("token", F.col("p.node").alias("pivot"), F.col("p.n").alias("size")))
    met = rows.join(pivot, "token").filter(
        (F.col("node") != F.col("pivot")) & _close(F.col("n"), F.col("size"))
        & _enough(F.col("n"), F.col("at"), F.col("size"))).select("node", "pivot").distinct()
    to = member.select(F.col("node").alias("pivot"), "grp", F.col("label").alias("to"))
    return (met.join(member.select("node", "label"), "node").join(to, "pivot")
            .filter("label != to").select(F.col("node").alias("query"), "grp").distinct())


def open_candidates(rows: DataFrame, member: DataFrame) -> DataFrame:
    """``query``, ``grp``: each set with every group that its rarest shingles
    lead to, unless one label connects the set with the whole group.

    A common shingle mostly leads to sets of one label. Sets of that label are
    joined to the other groups of the shingle alone, so a large family is not
    joined to itself.
    """
    rows = rows.filter(F.col("at") <= F.col("n") - _least(F.col("n")))
    labelled = written(rows.join(member, "node").select("token", "node", "n", "at", "grp", "label"),
                       "shingle-rows")
    index = (labelled.filter(F.col("at") < index_length(F.col("n"))).groupBy("token", "grp")
             .agg(F.min("n").alias("low"), F.max("n").alias("high"),
                  F.min("label").alias("first"), F.max("label").alias("last")))
    index = written(index, "shingle-index")
    main = (index.filter("first = last").groupBy("token", F.col("first").alias("main"))
            .agg(F.count(F.lit(1)).alias("k")).groupBy("token")
            .agg(F.max_by("main", F.struct("k", "main")).alias("main")))
    odd = F.col("main").isNull() | (F.col("first") != F.col("main")) | (F.col("last") != F.col("main"))
    probes = (labelled.join(main, "token", "left")
              .withColumn("odd", F.coalesce(F.col("label") == F.col("main"), F.lit(False))))
    both = (index.join(main, "token", "left")
            .withColumn("odd", F.explode(F.when(odd, F.array(F.lit(True), F.lit(False)))
                                         .otherwise(F.array(F.lit(False)))))
            .select("token", "odd", F.col("grp").alias("to"), "low", "high", "first", "last"))
    n = F.col("n")
    least = F.greatest(F.col("low"), _least(n))
    apart = (F.col("label") != F.col("first")) | (F.col("label") != F.col("last"))
    cond = (apart & (F.col("low") <= n) & (100 * F.col("high") >= PERCENT * n)
            & _enough(n, F.col("at"), least))
    return probes.join(both, ["token", "odd"]).filter(cond).select(
        F.col("node").alias("query"), F.col("to").alias("grp")).distinct()


def opened_links(candidates: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """``a``, ``b``: one link from the query to each connected part of the group
    that it links with."""
    return compared(candidates, sets, groups, _group, lambda g, item: g.links(_tokens(item)))


def _relabelled(member: DataFrame, links: DataFrame) -> DataFrame:
    """``member`` with labels that the ``links`` between nodes connect."""
    name = member.select("node", "label")
    ends = (links.join(name.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
            .join(name.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
            .filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    to = components(ends).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return written(member.join(to, "label", "left").select(
        "node", "grp", F.coalesce("new", "label").alias("label")), "shingle-member")


def _live_rows(nodes: DataFrame) -> DataFrame:
    """``token``, ``node``, ``n``, ``at``, ``k`` for the shingles of ``probe``
    that ``k`` > 1 sets share, of sets that share enough of them to link.

    Sets go that share too few, and then shingles that none but those shared:
    ROUNDS times, as chance leaves fewer and fewer of them.
    """
    rows = nodes.select("no", "n", F.posexplode("probe").alias("at", "token"))
    for _ in range(ROUNDS):
        live = rows.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        shared = written(rows.join(live.hint("shuffle_hash"), "token"), "shingle-shared")
        enough = (shared.groupBy("no").agg(F.count(F.lit(1)).alias("c"), F.any_value("n").alias("n"))
                  .filter(F.col("c") >= _need(F.col("n"))).select("no"))
        kept = written(shared.join(enough, "no"), "shingle-enough")
        rows = kept.drop("k")
    return kept.join(nodes.select("no", "node"), "no").drop("no")


def shingle_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_shingles`` (size of its set) and
    ``component_id`` (the smallest id that links reach, its own included). Two
    sets link if 100 times their intersection reaches PERCENT times their union.

    * Sets are compared by 64-bit hashes of their shingles. Fewer than four
      words make one shingle. Null texts and texts without a word have no
      shingle, link with nothing and are components of their own.
    * Rows with one set, repeated rows among them, are one node and never
      compared. Long texts are read whole. Links are complete at every size of
      a group of copies.
    * A null id is never the smallest, unless all ids of the component are
      null. An empty table gives no rows; other columns are not read, whatever
      they are called.
    """
    ship_package(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"))
    counts = count_slots(rows.select("text"), SKETCH_BITS, lambda column: [
        _slots(s) for s in shingle_sets(column) if len(s)])
    signed = written(_signed(rows, np.log2(np.maximum(counts, 1)).astype(np.uint8)), "shingle-signed")
    # written at once, so the numbers stay the same; they are half a node long
    nodes = written(signed.filter(F.col("node").isNotNull()).drop("id").dropDuplicates(["node"])
                    .withColumn("no", F.monotonically_increasing_id()), "shingle-nodes")
    live = written(_live_rows(nodes), "shingle-live")
    central = written(live.groupBy("node").agg(F.sum("k").alias("central")), "shingle-central")
    wanted = written(nodes.join(central, "node").select("node", "n", "least", "digest"), "shingle-wanted")
    # one text for each set that is compared; the whole set is made again from
    # it, as writing all sets would take more room than the texts
    texts = (among(rows.select("digest", "text"), "digest", wanted)
             .join(wanted.select("digest").hint("shuffle_hash"), "digest", "left_semi")
             .dropDuplicates(["digest"]))
    tokens = add_columns(texts, "text", ["digest"], "item binary",
                         lambda column: [(s.tobytes(),) for s in shingle_sets(column)])
    sets = written(wanted.join(tokens, "digest").drop("digest"), "shingle-sets")
    # similar sets mostly have the same smallest hash
    groups = written(grouped(sets.withColumn("label", F.col("node")), ["least", "n", "node"], _labels),
                     "shingle-groups")
    member = written(members(groups), "shingle-member")
    near = written(opened_links(pivot_candidates(live, member, central), sets, groups), "shingle-links")
    member = _relabelled(member, near)
    rest = written(opened_links(open_candidates(live, member), sets, groups), "shingle-links")
    member = _relabelled(member, rest)
    own = (signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("least_id"))
           .join(member.select("node", "label"), "node", "left")
           .select("node", "least_id", F.coalesce("label", "node").alias("label")))
    own = written(own, "shingle-own")
    component = own.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of = written(own.join(component, "label").select("node", "component_id"), "shingle-components")
    return signed.select("id", "node", "n").join(of, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
