"""Templates learned from prompts: what many of them begin and end with.

A template is a prefix and a suffix around a slot. Which prompts share one is
found by counting hashes of prefixes and suffixes at growing lengths: a prompt
belongs to the longest ones that are common enough. How far a group's prefix
and suffix really reach is the least that any of its texts has in common with
one of them.

Texts are neither shuffled nor written: a prompt takes part by a digest and the
hashes of its beginnings and ends (eight bytes for each length).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.session import materialize

#: Lengths at which prefixes are counted: a shorter one makes no template.
LENGTHS = (*range(16, 64, 8), *range(64, 256, 16), *range(256, 1025, 64))
#: And suffixes, which tell apart templates with one prefix.
TAIL_LENGTHS = (8, 12, *LENGTHS)
#: A prefix or suffix has so many characters at most.
MOST = 4096
#: Texts are compared so far first, and further only where they agree so far.
NEAR = 256
#: A prefix (suffix) is a template's if this share of the different prompts
#: has it.
MIN_SHARE = 0.05
#: A longer prefix belongs to the template if so many of the prompts with the
#: shorter one go on like that, in ways that are common enough themselves.
MIN_COVER = 0.98
#: And each of those ways must be taken by this share of them: a last digit of
#: the slots is no template.
MIN_PART = 0.15


def _ends(prompts: DataFrame, prompt: str) -> DataFrame:
    """``p`` with its first and last characters (``a``, ``z``) and length ``n``;
    columns of their own, so that the lambdas below do not cut them again."""
    own = prompts.where(F.col(prompt).isNotNull()).select(F.col(prompt).alias("p"))
    return own.select("p", F.left("p", F.lit(LENGTHS[-1])).alias("a"),
                      F.right("p", F.lit(TAIL_LENGTHS[-1])).alias("z"), F.length("p").alias("n"))


def _hashes(text: str, cut: Callable[[Column, Column], Column], lengths: Sequence[int]) -> Column:
    """Hashes of a text's beginnings (``cut`` F.left) or ends (F.right) of the
    ``lengths`` that it has; a second look at ``text`` keeps it a column."""
    have = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.col("n"))
    return F.when(F.col(text).isNotNull(), F.transform(have, lambda n: F.xxhash64(n, cut(F.col(text), n))))


def _slots(share: float) -> int:
    """So many slots that one has a hundredth of ``share`` by chance."""
    return max(2048, 1 << int(100 / share).bit_length()) if share > 0 else 1 << 16


def _anchors(rows: DataFrame, column: str, lengths: Sequence[int], least: int, totals: dict, n_slots: int) -> dict:
    """For each ``grp`` the prefixes (n, h) that hold: ``least`` rows have
    them, and with their like they go on from the next shorter one for
    MIN_COVER of its rows. (From the start of the text nothing need go on where
    ``totals`` has no number for the group.)

    A beginning that many slots have in common does not go on for nearly all of
    them, so it is no part of the template. Counted by Spark; the driver reads
    1 / share rows a group and length at most.

    Hashes are first counted by slots, of which there is a fixed number: one in
    a slot under ``least`` cannot reach it, and only the others are shuffled."""
    pairs = F.arrays_zip(F.col(column).alias("h"), F.concat(F.array(F.lit(0).cast("long")), F.slice(
        column, 1, F.greatest(F.size(column) - 1, F.lit(0)))).alias("parent"))
    one = rows.where(F.size(column) > 0).select("grp", F.posexplode(pairs).alias("i", "x")).select(
        "grp", "i", F.col("x.h").alias("h"), F.col("x.parent").alias("parent"),
        F.col("x.h").bitwiseAND(n_slots - 1).alias("slot"))
    full = one.groupBy("grp", "i", "slot").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)
    # 1 / share slots a group and length at most
    full = rows.sparkSession.createDataFrame([(r["grp"], r["i"], r["slot"]) for r in full.collect()],
                                             "grp string, i int, slot long")
    counted = (one.join(F.broadcast(full), ["grp", "i", "slot"], "left_semi").groupBy("grp", "i", "h", "parent")
               .agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least))
    below: dict = {}
    for r in counted.collect():
        below.setdefault((r["grp"], lengths[r["i"]], r["parent"]), []).append((r["h"], r["c"]))
    out: dict = {}
    steps = sorted({n for _, n, _ in below})
    for grp in {g for g, _, _ in below}:
        level = [(0, totals.get(grp))]
        for n in steps:
            going = []
            for parent, total in level:
                found = [(h, c) for h, c in below.get((grp, n, parent), [])
                         if total is None or c >= MIN_PART * total]
                if found and (total is None or sum(c for _, c in found) >= MIN_COVER * total):
                    going += found
                    out.setdefault(grp, []).extend((n, h) for h, _ in found)
            level = going
    return out


def _longest(column: str, lengths: Sequence[int], found: dict) -> Column:
    """The longest of a row's prefixes (hashes at ``lengths``) that is among
    those ``found`` for its ``grp``."""
    out = F.lit(None).cast("struct<n:int,h:bigint>")
    for grp, anchors in found.items():
        at: dict = {}
        for n, h in anchors:
            at.setdefault(n, []).append(h)
        own = [F.when(F.get(column, F.lit(lengths.index(n))).isin(at[n]), F.struct(
            F.lit(n).alias("n"), F.get(column, F.lit(lengths.index(n))).alias("h"))) for n in sorted(at, reverse=True)]
        out = F.when(F.col("grp") == F.lit(grp), F.coalesce(*own)).otherwise(out)
    return out


def _grouped(rows: DataFrame, heads: dict, lengths: Sequence[int]) -> DataFrame:
    """Rows with the longest ``head`` of those found, and their group by it
    (both null where there is none)."""
    own = rows.withColumn("grp", F.lit("")).withColumn("head", _longest("heads", lengths, heads))
    return own.withColumn("grp", F.hex(F.col("head.h")))


def _agree(text: str, other: str, cut: Callable[[Column, Column], Column], most: int) -> Column:
    """How many characters, ``n`` or ``most`` at most, two texts begin (``cut``
    F.left) or end (F.right) with alike, by halving."""
    steps = [1 << i for i in reversed(range((most - 1).bit_length()))] + [1]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda have, s: F.when(
        (have + s <= F.least("n", F.lit(most))) & (cut(F.col(text), have + s) == cut(F.col(other), have + s)),
        have + s).otherwise(have))


def learn_templates(prompts: DataFrame, prompt: str = "prompt",
                    min_share: float = MIN_SHARE) -> DataFrame:
    """``prefix``, ``suffix``, ``prompts`` of the templates that the different
    prompts come from, written.

    Repeated prompts count once, so a hot prompt makes no template. What more
    than MIN_COVER of a template's slots begin or end with counts as part of
    it. Null prompts, and those that share no long enough prefix, take no
    part. ``prompts`` is read three times. (Two different prompts of a thousand
    million share a digest of 128 bits with a probability under 1e-20.)"""
    spark = prompts.sparkSession
    texts = _ends(prompts, prompt)
    digest = [F.xxhash64("p").alias("d1"), F.xxhash64(F.lit(1), F.col("p")).alias("d2")]
    rows = materialize(texts.select(*digest, _hashes("a", F.left, LENGTHS).alias("heads"),
                                    _hashes("z", F.right, TAIL_LENGTHS).alias("tails"))
                       .dropDuplicates(["d1", "d2"]), "anchors-prompts")
    least, n_slots = max(2, int(min_share * rows.count())), _slots(min_share)
    heads = _anchors(rows.withColumn("grp", F.lit("")), "heads", LENGTHS, least, {}, n_slots)
    own = _grouped(rows, heads, LENGTHS).where(F.col("grp").isNotNull())
    totals = {r["grp"]: r["c"] for r in own.groupBy("grp").agg(F.count(F.lit(1)).alias("c")).collect()}
    tails = _anchors(own, "tails", TAIL_LENGTHS, least, totals, n_slots)
    group = (own.withColumn("tail", _longest("tails", TAIL_LENGTHS, tails)).groupBy("head", "tail")
             .agg(F.count(F.lit(1)).alias("prompts"), F.min_by(F.struct("d1", "d2"), "d1").alias("one"))
             .where(F.col("prompts") >= least)).collect()
    schema = "prefix string, suffix string, prompts long"
    if not group:
        return materialize(spark.createDataFrame([], schema), "anchors-templates")
    # one text of each group, and what all others have in common with it
    ones = [r["one"] for r in group]
    sought = F.col("d1").isin([o["d1"] for o in ones]) & F.col("d2").isin([o["d2"] for o in ones])
    seen = {(r["d1"], r["d2"]): r for r in texts.select(*digest, "p").where(sought).groupBy("d1", "d2").agg(
        F.first(F.left("p", F.lit(MOST))).alias("a"), F.first(F.right("p", F.lit(MOST))).alias("z")).collect()}
    example = spark.createDataFrame([(i, r["head"], r["tail"], seen[r["one"]]["a"], seen[r["one"]]["z"])
                                     for i, r in enumerate(group)],
                                    "id int, h struct<n:int,h:bigint>, t struct<n:int,h:bigint>, a1 string, z1 string")
    used = [sorted({n for found in some.values() for n, _ in found}) for some in (heads, tails)]
    again = _grouped(texts.select("p", "n", _hashes("a", F.left, used[0]).alias("heads"),
                                  _hashes("z", F.right, used[1] or TAIL_LENGTHS[:1]).alias("tails")), heads, used[0])
    again = again.withColumn("tail", _longest("tails", used[1], tails))
    # null-safe: a filter for nulls would work out the hashes once more
    met = again.join(F.broadcast(example), F.col("head").eqNullSafe(F.col("h")) & F.col("tail").eqNullSafe(F.col("t")))
    met = met.select("id", "p", "n", "a1", "z1", *[cut(c, F.lit(NEAR)).alias(name) for cut, c, name in (
        (F.left, "p", "pa"), (F.right, "p", "pz"), (F.left, "a1", "near_a"), (F.right, "z1", "near_z"))])
    ends = [F.when(F.col(p) != F.col(near), _agree(p, near, cut, NEAR)).otherwise(_agree("p", far, cut, MOST)).alias(name)
            for cut, p, near, far, name in ((F.left, "pa", "near_a", "a1", "a"), (F.right, "pz", "near_z", "z1", "z"))]
    common = met.select("id", F.least("n", F.lit(MOST)).alias("short"), *ends).groupBy("id").agg(
        *[F.min(c).alias(c) for c in ("short", "a", "z")]).collect()
    out = []
    for r in common:
        text, count = seen[group[r["id"]]["one"]], group[r["id"]]["prompts"]
        # in the shortest prompt prefix and suffix must not overlap
        room = min(r["z"], max(r["short"] - r["a"], 0))
        out.append((text["a"][:r["a"]], text["z"][len(text["z"]) - room:], count))
    return materialize(spark.createDataFrame(out, schema), "anchors-templates")


def slots(prompts: DataFrame, templates: DataFrame, prompt: str = "prompt", out: str = "slot") -> DataFrame:
    """``prompts`` with the text in the slot of the template with the longest
    prefix (then suffix) that fits; null if none does. ``templates`` are as
    many as shares of the prompts, so they are read by the driver."""
    found = sorted(templates.collect(), key=lambda r: (-len(r["prefix"]), -len(r["suffix"]), r["prefix"]))
    text = F.col(prompt)
    cuts = [F.when(text.startswith(F.lit(r["prefix"])) & text.endswith(F.lit(r["suffix"]))
                   & (F.length(text) >= len(r["prefix"]) + len(r["suffix"])),
                   F.substr(text, F.lit(len(r["prefix"]) + 1),
                            F.length(text) - F.lit(len(r["prefix"]) + len(r["suffix"])))) for r in found]
    return prompts.withColumn(out, F.coalesce(*cuts) if cuts else F.lit(None).cast("string"))
