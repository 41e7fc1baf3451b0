"""Drifting JSON lines, and templates learned from prompts."""
import json
import random
from collections import Counter

import pytest

from tunedata.operators import anchors as AN
from tunedata.sources import variant as VA


@pytest.fixture()
def lines(spark, tmp_shared):
    def write(rows):
        path = tmp_shared("lines")
        spark.createDataFrame([(r,) for r in rows], "value string").write.text(path)
        return VA.variant_lines(spark, path)
    return write


def test_missing_null_and_other_are_told_apart(lines):
    rows = ['{"problem": "p", "answer": "a", "type": "Original"}', '{"input": "p", "output": null}',
            '{"problem": null, "input": "second", "answer": ["a", 1]}', '{"problem": "", "type": 3.5}',
            "", "   ", '{"problem": "x"', "[1, 2]", '"text"', "null", "12", '{}', '{"Problem": "other key"}',
            '{"problem": {"answer": "deep"}}', '{"problem": "a", "problem": "b"}', '{"answer": "é😀\\n\\u0000"}']
    got = VA.ingest(lines(rows), defaults={"type": "T"}).collect()
    want = Counter()
    for r in (x for x in rows if x.strip()):
        try:
            # a key given twice is an error, as it cannot be told which one counts
            doc = json.loads(r, object_pairs_hook=lambda p: dict(p) if len(dict(p)) == len(p) else 1 / 0)
        except (ValueError, ZeroDivisionError):
            want["corrupt", r, None, None, None, None, None, None] += 1
            continue
        if not isinstance(doc, dict):
            want["not_object", r, None, None, None, None, None, None] += 1
            continue
        out = ["ok", None]
        for keys in VA.FIELDS.values():
            k = next((k for k in keys if k in doc), None)
            v = doc.get(k)
            state = "missing" if k is None else "null" if v is None else "string" if isinstance(v, str) else "other"
            text = v if isinstance(v, str) else None if v is None else json.dumps(v, separators=(",", ":"))
            out += ["T" if keys == ("type",) and k is None else text, state]
        want[tuple(out)] += 1
    assert Counter(map(tuple, got)) == want
    kept = VA.complete(VA.ingest(lines(rows)))
    assert kept.count() == 3


def test_drift_counts_keys_and_kinds(lines):
    rows = ['{"a": 1, "b": "x"}', '{"a": 2.5, "b": null}', '{"a": "1", "c": {"a": 1}}', "{}", "[{\"a\": 1}]", "{"]
    got = {(r.key, r.kind): r["lines"] for r in VA.drift(lines(rows)).collect()}
    assert got == {("a", "BIGINT"): 1, ("a", "DECIMAL"): 1, ("a", "STRING"): 1, ("b", "STRING"): 1,
                   ("b", "NULL"): 1, ("c", "OBJECT"): 1}
    schema = VA.merged_schema(lines(rows)).first().schema
    assert schema.startswith("OBJECT<") and "c: OBJECT<a: BIGINT>" in schema
    assert VA.drift(lines(["{"])).collect() == []


def test_names_with_odd_characters(lines):
    rows = [json.dumps({"my.key": "1", "a b": "2", "x'y": "3"})]
    fields = {"d": ("my.key",), "s": ("a b",), "q": ("x'y",)}
    assert tuple(VA.ingest(lines(rows), fields).select("d", "s", "q").first()) == ("1", "2", "3")


# ---- templates -------------------------------------------------------------------

def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "é", "😀", "7", "(x)"]) + str(rng.randrange(99))
                    for _ in range(n))


def prompts(spark, parts):
    return spark.createDataFrame([(t, i) for i, t in enumerate(parts)], "prompt string, i int")


def test_templates_among_noise_copies_and_families(spark):
    rng = random.Random(1)
    one = ("Rewrite the following text so that it is short:\n", "\nShort text:")
    two = ("Rewrite the following text so that it is short:\n", "\n\nNow answer in one word only, please.")
    three = ("Ask three questions about this problem. Problem: ", "")
    texts = {t: [words(rng, rng.randrange(1, 30)) + rng.choice(".!?a") for _ in range(120)] for t in (one, two, three)}
    family = "This is one document of which there are many near copies that begin and end alike, number "
    texts[one] += [family + str(i) + " and its end is the same." for i in range(90)]       # near copies
    rows = [a + t + b for (a, b), ts in texts.items() for t in ts]
    rows += [rows[5]] * 500 + [words(rng, 20) for _ in range(60)] + [None, "", "short"]
    rng.shuffle(rows)
    df = prompts(spark, rows)
    learned = AN.learn_templates(df)
    got = {(r.prefix, r.suffix): r.prompts for r in learned.collect()}
    assert got == {t: len(set(ts)) for t, ts in texts.items()}
    slot = {r.prompt: r.slot for r in AN.slots(df, learned).collect()}
    for (a, b), ts in texts.items():
        assert all(slot[a + t + b] == t for t in ts)
    assert slot[None] is None and slot[""] is None and slot["short"] is None


def test_a_drifted_template_is_one_of_its_own(spark):
    rng = random.Random(2)
    old, new = "Please solve the problem below, in Python:\n", "Please solve the problem below, in Java or C:\n"
    rows = [old + words(rng, 9) + "\nThank you." for _ in range(200)]
    rows += [new + words(rng, 9) + "\nThank you." for _ in range(100)]
    got = {(r.prefix, r.suffix) for r in AN.learn_templates(prompts(spark, rows)).collect()}
    assert got == {(old, "\nThank you."), (new, "\nThank you.")}


def test_few_or_no_prompts(spark):
    assert AN.learn_templates(prompts(spark, [None, ""])).collect() == []
    assert AN.learn_templates(spark.createDataFrame([], "prompt string")).collect() == []
    none = AN.learn_templates(prompts(spark, ["one text that is long enough", "quite another text, long too"]))
    assert none.collect() == []
    assert AN.slots(prompts(spark, ["a"]), none).first().slot is None
    same = AN.learn_templates(prompts(spark, ["always the same beginning", "always the same beginning of it"]))
    assert [(r.prefix, r.suffix) for r in same.collect()] == [("always the same beginning", "")]
