"""Quality rules by distribution divergence.

The histograms of character classes and of common words of a document are
compared to those of its language by the Jensen-Shannon distance (base 2, 0 to
1); the language is the one whose common words are nearest. Short documents get
wider limits, as their histograms scatter. The references are learned from all
documents with a language. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, written

#: A word is common if it makes up this share of the words of its language, so
#: no language has more than 1 / COMMON_SHARE of them.
COMMON_SHARE = 0.004
#: A language is a reference if it has this share of all words, so there are no
#: more than 1 / LANG_SHARE references.
LANG_SHARE = 0.005
#: What separates the words that are compared: white space and punctuation.
SEPARATORS = r"[\x20\x09-\x0D.,;:!?\"'()\[\]{}|*#$%&]+"
BUCKETS = 8192
MIN_WORDS = 50
#: Limits of the distances, and what short documents get on top:
#: SLACK / sqrt(number of words).
MAX_CLASS_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.25
CLASS_SLACK = 0.5
WORD_SLACK = 1.0

#: The character classes in the order in which they are taken out of the text.
CLASSES = [
    ("spaces", SPACE_CLASS), ("lower", "[a-z]+"), ("upper", "[A-Z]+"),
    ("letters", r"\p{L}+"), ("digits", "[0-9]+"), ("points", "[.,;:'\"()-]+"),
    ("marks", "[!?]+"), ("symbols", "[#*$%&|<>]+"),
]


def _class_counts(docs: DataFrame, text: Column) -> DataFrame:
    """``_left`` text and count columns: each class is taken out of what the
    classes before it left, so that each scan is shorter than the last."""
    out = docs.withColumn("_t0", F.coalesce(text, F.lit("")))
    for i, (_, pattern) in enumerate(CLASSES):
        out = out.withColumn(f"_t{i + 1}", F.regexp_replace(f"_t{i}", pattern, ""))
    n = len(CLASSES)
    for i, (name, _) in enumerate(CLASSES):
        out = out.withColumn(f"_n_{name}", (F.length(f"_t{i}") - F.length(f"_t{i + 1}")).cast("long"))
    out = out.withColumn("_n_rest", F.length(f"_t{n}").cast("long"))
    return out.withColumn("_n_all", F.length("_t0").cast("long"))


def _split(trimmed: Column) -> Column:
    """The words of a text without white space at its ends."""
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_CLASS))


def _trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def _compared_words(text: Column) -> Column:
    """Lower-case words between white space and punctuation, and perhaps ''."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def _with_repeats(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words of ``_w`` covered by three-word windows
    that occur twice or more.

    Each step is a column of its own, so that it is worked out once. Only texts
    in which two windows have one hash go on: there windows are sorted as
    numbers made of a hash (high bits) and the place (low bits), and neighbours
    with one hash count if their words are equal.
    """
    w, h, s = F.col("_w"), F.col("_h"), F.col("_s")
    last = F.size(w) - 3
    out = df.withColumn("_h", F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))))
    out = out.withColumn("_twice", F.size(F.array_distinct(h)) < F.size(h))
    out = out.withColumn("_bits", F.length(F.bin(F.size(w).cast("long"))))
    out = out.withColumn("_low", F.expr("shiftleft(1L, _bits) - 1"))
    packed = F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(F.col("_low")))
                         .bitwiseOR(i.cast("long")))
    out = out.withColumn("_s", F.when(F.col("_twice"), F.sort_array(packed)))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.col("_low")).cast("int")

    def same(x: Column, y: Column) -> Column:
        a, b = place(x), place(y)
        return (x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(F.col("_low"))) == 0) & (
            (w[a] == w[b]) & (w[a + 1] == w[b + 1]) & (w[a + 2] == w[b + 2]))

    end = F.size(s) - 1
    spots = F.filter(s, lambda x, i: ((i > 0) & same(x, s[F.greatest(i - 1, F.lit(0))]))
                     | ((i < end) & same(x, s[F.least(i + 1, end)])))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        spots, lambda x: F.array(place(x), place(x) + 1, place(x) + 2)))))
    return out.withColumn("n_repeat_words", F.when(F.col("_twice"), covered).otherwise(F.lit(0))
                          .cast("long")).drop("_h", "_twice", "_bits", "_low", "_s")


def _with_runs(df: DataFrame, sorted_col: str, out: str) -> DataFrame:
    """Add ``out``: array<struct<w, c>>, the distinct values of the sorted
    array ``sorted_col`` with their counts."""
    s = F.col(sorted_col)
    firsts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))),
                      lambda i: (i < F.size(s)) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
    first = F.col("_first")
    return df.withColumn("_first", firsts).withColumn(out, F.transform(
        first, lambda i, k: F.struct(
            F.get(s, i).alias("w"),
            (F.coalesce(F.get(first, k + 1), F.size(s)) - i).cast("int").alias("c")))).drop("_first")


def common_words(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang``, ``word``, ``n`` and ``total``: the common words of the
    languages, with exact counts over all documents.

    Words are first counted by hash bucket, of which there are BUCKETS: a word
    in a bucket under the limit cannot reach it. Only words of the other
    buckets are then counted one by one, so no shuffle holds the vocabulary.
    """
    tokens = docs.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.explode(_compared_words(F.col(text_col))).alias("word")).filter(F.col("word") != "")
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
    buckets = written(tokens.groupBy("lang", bucket.alias("bucket"))
                      .agg(F.count(F.lit(1)).alias("n")), "quality-buckets")
    totals = buckets.groupBy("lang").agg(F.sum("n").alias("total"))
    everything = totals.agg(F.sum("total").alias("_all"))
    totals = written(totals.crossJoin(F.broadcast(everything))
                     .filter(F.col("total") >= LANG_SHARE * F.col("_all")).drop("_all"),
                     "quality-totals")
    heavy = written(buckets.join(totals, "lang").filter(F.col("n") >= COMMON_SHARE * F.col("total"))
                    .select("lang", "bucket"), "quality-heavy")
    counted = (tokens.withColumn("bucket", bucket).join(heavy, ["lang", "bucket"])
               .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    return counted.join(totals, "lang").filter(F.col("n") >= COMMON_SHARE * F.col("total"))


def _distance(pairs: list[tuple[Column, Column]] | None, terms: Column | None = None) -> Column:
    """Jensen-Shannon distance from (p, q) pairs, or from an array of structs
    p, q plus those pairs. Bins of the reference alone need no term: they
    add half their mass, which is part of the 0.5."""
    def term(p: Column, q: Column) -> Column:
        m = p + q
        return F.when(p > 0, 0.5 * p * F.log2(2 * p / m)
                      + F.when(q > 0, 0.5 * q * F.log2(2 * q / m)).otherwise(0.0)
                      - 0.5 * q).otherwise(0.0)

    total = F.lit(0.5)
    if terms is not None:
        total = F.aggregate(terms, total, lambda acc, s: acc + term(s["p"], s["q"]))
    for p, q in pairs or []:
        total = total + term(p, q)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def document_features(docs: DataFrame, vocabulary: list[str], *, keep: list[str],
                      lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """All counts of each row, made in one pass over its text: base columns,
    character classes and its words out of ``vocabulary`` with their counts."""
    text = F.col(text_col)
    out = _class_counts(docs.select(*keep, F.col(lang_col).alias("_lang"), text.alias("_text")),
                        F.col("_text"))
    out = out.withColumn("_w", _split(_trimmed(F.col("_text"))))
    out = _with_repeats(out)
    out = out.withColumn("_filled", F.filter(
        F.split(F.col("_t0"), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    low = F.col("_lw")
    out = out.withColumn("_lw", _compared_words(F.col("_text")))
    # separators come in runs, so only the ends can be empty
    n_low = F.size(low) - (F.element_at(low, 1) == "").cast("int") - (
        (F.size(low) > 1) & (F.element_at(low, -1) == "")).cast("int")
    common = F.filter(low, lambda x: x.isin(vocabulary)) if vocabulary else F.slice(low, 1, 0)
    out = _with_runs(out.withColumn("_sorted", F.sort_array(common)), "_sorted", "_common")
    return out.select(
        *keep, "_lang", F.size("_w").cast("long").alias("n_words"),
        (F.col("_n_all") - F.col("_n_spaces")).alias("word_chars"),
        F.col("_n_symbols").alias("n_symbols"),
        (F.size("_filled") - F.size(F.array_distinct("_filled"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.array(*[F.col(f"_n_{c}") for c, _ in CLASSES], F.col("_n_rest")).alias("_classes"),
        "_n_all", n_low.cast("double").alias("_n_low"), "_common")


def _terms(n: Column, vocab: Column | None, q: Column) -> Column:
    """The words of a row with their share here (p) and in a language (q)."""
    if vocab is None:
        return F.array().cast("array<struct<p:double,q:double>>")
    return F.transform("_common", lambda s: F.struct(
        (s["c"] / n).alias("p"),
        F.element_at(q, F.array_position(vocab, s["w"]).cast("int")).alias("q")))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``kept``, and of the method ``nearest_lang``, ``word_distance``,
    ``class_distance`` (rounded to 4 digits).

    * ``base_failed``: under 50 words, or more than half of them in repeated
      three-word windows. Such documents are not kept; others are kept if both
      distances are within their limits.
    * Null and empty texts have 0 words; they and texts of punctuation alone
      have distances null. Without any
      reference language the distances are null and only the base decides.
    * A null language is no reference but gets a verdict. Ties between
      languages go to the one that sorts first. Long texts are read whole,
      repeated rows each get a row, an empty table gives none; other columns
      are not read, whatever they are called.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_l"),
                         F.col(text_col).alias("_x"))
    # at most 1 / LANG_SHARE languages of at most 1 / COMMON_SHARE words
    rows = (common_words(source, lang_col="_l", text_col="_x")
            .select("lang", "word", (F.col("n") / F.col("total")).alias("q")).collect())
    langs = sorted({r["lang"] for r in rows})
    vocabulary = sorted({r["word"] for r in rows})
    share = {(r["lang"], r["word"]): r["q"] for r in rows}
    feats = written(document_features(source, vocabulary, keep=["_id"], lang_col="_l",
                                      text_col="_x"), "quality-features")
    n_classes = len(CLASSES) + 1
    sums = {r["_lang"]: r for r in feats.filter(F.col("_lang").isin(langs)).groupBy("_lang").agg(
        *[F.sum(F.col("_classes")[i]).alias(f"c{i}") for i in range(n_classes)]).collect()}
    verdicts = []
    n_words, n_low = F.col("n_words").cast("double"), F.col("_n_low")
    vocab = F.array(*[F.lit(v) for v in vocabulary]) if vocabulary else None
    for lang in langs:
        qs = [share.get((lang, v), 0.0) for v in vocabulary]
        q_array = F.array(*[F.lit(q) for q in qs])
        terms = _terms(n_low, vocab, q_array)
        in_common = F.aggregate("_common", F.lit(0), lambda acc, s: acc + s["c"])
        other = ((n_low - in_common) / n_low, F.lit(max(1.0 - sum(qs), 0.0)))
        mass = [int(sums[lang][f"c{i}"]) for i in range(n_classes)]
        classes = [(F.col("_classes")[i] / F.col("_n_all"), F.lit(mass[i] / sum(mass)))
                   for i in range(n_classes)]
        verdicts.append(F.struct(
            _distance([other], terms).alias("w"), F.lit(lang).alias("lang"),
            _distance(classes).alias("c")))
    best = F.array_min(F.array(*verdicts)) if verdicts else F.lit(None).cast(
        "struct<w:double,lang:string,c:double>")
    base_failed = ((F.col("n_words") < MIN_WORDS)
                   | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    judged = feats.withColumn("_best", F.when(n_low > 0, best))
    near = ((F.col("_best.w") <= MAX_WORD_DISTANCE + WORD_SLACK / F.sqrt(n_words))
            & (F.col("_best.c") <= MAX_CLASS_DISTANCE + CLASS_SLACK / F.sqrt(n_words)))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & F.coalesce(near, F.lit(True))).alias("kept"),
        F.col("_best.lang").alias("nearest_lang"), F.round("_best.w", 4).alias("word_distance"),
        F.round("_best.c", 4).alias("class_distance"))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def quality_sql(docs: str = "documents") -> str:
    """The same rows as DuckDB SQL."""
    taken = ""
    for i, (name, pattern) in enumerate(CLASSES):
        taken += (f"c{i + 1} AS (SELECT *, regexp_replace(t{i}, {_quoted(pattern)}, '', 'g') AS t{i + 1} "
                  f"FROM {'d' if i == 0 else f'c{i}'}),\n")
    n = len(CLASSES)
    counts = ", ".join(f"length(t{i}) - length(t{i + 1}) AS k{i}" for i in range(n))
    counts += f", length(t{n}) AS k{n}, length(t0) AS n_all"
    split = "regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+')"
    listed = f"list_filter({split}, lambda x: x <> '')"
    bare = f"list_filter(regexp_split_to_array(lower(t0), {_quoted(SEPARATORS)}), lambda x: x <> '')"
    js = ("CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) "
          "+ CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END - 0.5 * q ELSE 0 END")
    unpivot = " UNION ALL ".join(
        f"SELECT f.doc_id, r.lang, f.k{i} / f.n_all AS p, r.s{i} / r.s AS q FROM feats f, refs r "
        "WHERE f.n_low > 0" for i in range(n + 1))
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t0 FROM {docs}),
{taken}feats AS (SELECT doc_id, lang, len({listed.format('t0')}) AS n_words, len({bare}) AS n_low,
       {counts} FROM c{n}),
tok AS (SELECT doc_id, lang, unnest({bare}) AS word FROM d),
tot AS (SELECT lang, count(*) AS total FROM tok WHERE lang IS NOT NULL GROUP BY lang),
big AS (SELECT * FROM tot WHERE total >= {LANG_SHARE} * (SELECT sum(total) FROM tot)),
common AS (SELECT lang, word, n / total AS q FROM (
             SELECT t.lang, word, count(*) AS n, any_value(total) AS total
             FROM tok t JOIN big b ON t.lang = b.lang GROUP BY t.lang, word)
           WHERE n >= {COMMON_SHARE} * total),
langs AS (SELECT DISTINCT lang FROM common),
vocab AS (SELECT DISTINCT word FROM common),
q AS (SELECT l.lang, v.word, coalesce(c.q, 0) AS q FROM langs l CROSS JOIN vocab v
      LEFT JOIN common c ON c.lang = l.lang AND c.word = v.word),
rest AS (SELECT lang, greatest(1 - sum(q), 0) AS q FROM q GROUP BY lang),
have AS (SELECT doc_id, t.word, count(*) AS c FROM tok t JOIN vocab v ON t.word = v.word GROUP BY 1, 2),
inc AS (SELECT doc_id, sum(c) AS c FROM have GROUP BY 1),
wt AS (
  SELECT h.doc_id, q.lang, h.c / f.n_low AS p, q.q FROM have h JOIN q ON h.word = q.word
    JOIN feats f ON f.doc_id = h.doc_id
  UNION ALL
  SELECT f.doc_id, r.lang, (f.n_low - coalesce(i.c, 0)) / f.n_low AS p, r.q
  FROM feats f CROSS JOIN rest r LEFT JOIN inc i ON i.doc_id = f.doc_id WHERE f.n_low > 0),
wd AS (SELECT doc_id, lang, sqrt(greatest(0.5 + sum({js}), 0)) AS w FROM wt GROUP BY 1, 2),
refs AS (SELECT lang, {', '.join(f'sum(k{i}) AS s{i}' for i in range(n + 1))}, sum(n_all) AS s
         FROM feats WHERE lang IN (SELECT lang FROM langs) GROUP BY lang),
ct AS ({unpivot}),
cd AS (SELECT doc_id, lang, sqrt(greatest(0.5 + sum({js}), 0)) AS c FROM ct GROUP BY 1, 2),
best AS (SELECT doc_id, lang, w, c FROM wd JOIN cd USING (doc_id, lang)
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w, lang) = 1),
line AS (SELECT doc_id, unnest(string_split(t0, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM line
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i
        FROM (SELECT doc_id, {listed.format('t0')} AS w FROM d)),
win AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS k
        FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win WHERE k IS NOT NULL),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
          SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n > 1) GROUP BY doc_id),
judged AS (
  SELECT f.doc_id, f.n_words, f.n_all - f.k0 AS word_chars, f.k{[c for c, _ in CLASSES].index('symbols')} AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         f.n_words < {MIN_WORDS} OR 100 * coalesce(cov.n, 0) > 50 * f.n_words AS base_failed,
         b.lang AS nearest_lang, b.w, b.c
  FROM feats f LEFT JOIN dup ON dup.doc_id = f.doc_id LEFT JOIN cov ON cov.doc_id = f.doc_id
       LEFT JOIN best b ON b.doc_id = f.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(w <= {MAX_WORD_DISTANCE} + {WORD_SLACK} / sqrt(n_words)
         AND c <= {MAX_CLASS_DISTANCE} + {CLASS_SLACK} / sqrt(n_words), true) AS kept,
       nearest_lang, round(w, 4) AS word_distance, round(c, 4) AS class_distance
FROM judged
"""
