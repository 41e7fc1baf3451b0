"""Small tables with everything that real ones have now and then."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE = "the first shared line of a passage\nthe second shared line\nand a third shared one"
LONG = " ".join(f"word{i % 701} the of and" for i in range(60_000))
#: Extra columns, called like columns that operators add or use inside.
EXTRA = ["score", "rejected", "copy", "mix_key", "n_lines", "n_removed", "digest", "node",
         "class_id", "n_words", "kept", "word", "h", "n", "c", "key", "order", "lang_pred",
         "_id", "_th", "_th2", "_spans", "row", "id", "hash", "_mix_key", "_mix_cdf", "_mix_pos", "_mix_id",
         "_mix_parts", "_fid", "_fnode", "_neardup_node", "_leak_text", "_leak_id", "leak_id", "leak_hash",
         "_langid_score", "_langid_rejected", "_worker_text", "first", "label", "grp", "total", "token"]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def rows():
    out = [
        (None, "a text without an id but with a few words", "en", "a"),
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t \n", None, None),
        (4, LONG, "en", "a"), (5, "12 !! 34", None, "b"),
        (6, PASSAGE + "\nmine", "en", "a"), (6, PASSAGE + "\nmine", "en", "a"),
        (6, "same id but another text\n" + PASSAGE, "en", "b"),
        (7, "x\n" + PASSAGE, "en", "a"), (8, "one", "fr", "c"), (9, "Éé ünï \U0001F600 code", "fr", "c"),
        (2 ** 62, "a very large id\rwith \x0b odd\x0c breaks", "en", "a"),
    ]
    return [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in out]


def edge_docs(spark, extra=True):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA]) if extra else df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
