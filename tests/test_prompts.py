"""Golden templates, literal substitution, inverse rendering."""
from pyspark.sql import functions as F

from tunedata.functions import templates as T
from tunedata.functions.text import WHITESPACE
from tunedata.operators import prompts as P


def test_template_shapes():
    for k in T.KINDS:
        for tpl in (T.REWRITE_TEMPLATES[k], T.QUESTION_TEMPLATES[k]):
            assert tpl.startswith("\n") and tpl.endswith("\n")
            assert tpl.count("{question}") == 1
    assert "Output Format:" in T.QUESTION_TEMPLATES["incomplete"]
    assert "Output Format:" not in T.QUESTION_TEMPLATES["ambiguous"]
    assert T.REWRITE_TEMPLATES["ambiguous"].endswith("\n\nAmbiguous Problem:\n")
    assert T.V4_QUESTION_PROMPT.endswith(":\n")


def test_render_is_literal_and_invertible(spark):
    text = "use {question} and %s and $1 and \\ back"
    df = spark.createDataFrame([(1, text, k) for k in T.KINDS], "id INT, text STRING, kind STRING")
    out = P.question_prompt(P.rewrite_prompt(df, out="rw"))
    rows = out.collect()
    for r in rows:
        assert r.rw == T.REWRITE_TEMPLATES[r.kind].replace("{question}", text)
        assert r.prompt == T.QUESTION_TEMPLATES[r.kind].replace("{question}", text)
    back = out.select(P.unrender("prompt", "kind", T.QUESTION_TEMPLATES).alias("t")).collect()
    assert {r.t for r in back} == {text}
    # a prompt without the template's frame is not unrendered
    bad = spark.createDataFrame([("nope", "ambiguous")], "p STRING, kind STRING")
    assert bad.select(P.unrender("p", "kind", T.QUESTION_TEMPLATES)).first()[0] is None


def test_strip_matches_python(spark):
    samples = [" \t q \r\n", " x y　", "a\n\nb", "", "\x1c\x85z "]
    df = spark.createDataFrame([(s,) for s in samples], "text STRING")
    got = [r.text for r in P.strip_text(df).collect()]
    assert got == [s.strip() for s in samples]
    assert set(WHITESPACE) == {c for c in map(chr, range(0x110000)) if c.isspace()}


def test_concat_variants(spark):
    df = spark.createDataFrame([("p", "a", "Original"), ("p", "a", None), ("p", "a", "Ambiguous")],
                               "problem STRING, answer STRING, type STRING")
    rows = df.select(P.concat_v1().alias("v1"), P.concat_v3().alias("v3"),
                     P.concat_v4().alias("v4"), P.concat_profile().alias("pr")).collect()
    assert rows[0].v1 == "pa" and rows[0].v3 == "paOriginal"
    assert rows[0].v4 == f"{T.V4_QUESTION_PROMPT} p{T.V4_ANSWER_PROMPT_ORIGINAL} a"
    assert rows[1].v4 == f"{T.V4_QUESTION_PROMPT} p{T.V4_ANSWER_PROMPT_OTHER} a"   # null -> other
    assert rows[2].pr == "p a"


def test_preference_and_echo(spark):
    df = spark.createDataFrame([("two sum", "def f(): pass", "Original")],
                               "problem STRING, answer STRING, type STRING")
    r = df.select(P.preference_prompt().alias("p"), P.rejection_prompt().alias("r")).first()
    assert r.p == "Problem: two sum\n\nSolution:"
    assert r.r == T.REJECTION_PROMPT_ORIGINAL + "def f(): pass"
    g = spark.createDataFrame([("hello world", "hello  there ")], "generated STRING, prompt STRING")
    # drops len(prompt) characters regardless of content, then strips
    assert g.select(P.strip_prompt_echo()).first()[0] == "hello world"[len("hello  there "):].strip()


def test_merge_tags(spark):
    df = spark.createDataFrame([("q", ["a", "b c"])], "quote STRING, tags ARRAY<STRING>")
    assert df.select(P.merge_tags()).first()[0] == "q ->: " + str(["a", "b c"])


def test_tag_type_missing_vs_null(spark):
    lines = spark.createDataFrame([('{"input":"b"}',), ('{"input":"b","type":null}',),
                                   ('{"input":"b","type":"Original"}',), ("not json",)], "value STRING")
    got = [r[0] for r in lines.select(P.tag_type_lines(lines, "Ambiguous")).collect()]
    assert got == ["Ambiguous", None, "Original", None]


def test_expand_variants(spark):
    df = spark.range(3)
    assert P.expand_variants(df).count() == 9
    assert {r.kind for r in P.expand_variants(df).collect()} == set(T.KINDS)
