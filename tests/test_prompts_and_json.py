"""Filled prompts, frames, strict JSON objects, required subsets, summaries."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import nested, prompts
from sparkloom.functions import text as tx
from sparkloom.operators import rows
from sparkloom.sources import io


def test_templates_need_their_values(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(prompts.filled("{a}-{b}-{a}", a="a", b="b")).first()[0] == "x--x"
    assert df.select(prompts.filled("{a} {{", a="a")).first()[0] == "x {{"
    for values in ({}, {"a": "a", "b": "b"}):
        with pytest.raises(ValueError, match="the template has"):
            prompts.filled("{a}", **values)


def python_frames(clues, count, fps):
    spans = [(round(a * fps), round(b * fps)) for a, b in clues]
    total = sum(b - a for a, b in spans)
    if count >= total:
        return [f for a, b in spans for f in range(a, b)]
    out = []
    for a, b in spans:
        k = max(1, int(count * ((b - a) / total)))
        out += [int(a + (b - a) / k / 2 + (b - a) / k * i) for i in range(k)]
    return out


def test_frames_of_clues(spark):
    cases = [([(0.0, 2.0), (5.0, 5.5)], 3, 2.0), ([(0.25, 1.25)], 10, 2.0), ([(1.0, 9.0), (20.0, 30.0), (40.0, 40.4)], 7, 25.0), ([], 4, 2.0), ([(3.0, 3.0), (4.0, 6.0)], 2, 1.0)]
    df = spark.createDataFrame(cases, "clues array<struct<start:double,end:double>>, n int, fps double")
    got = [list(r.f) for r in df.select(prompts.clue_frames(F.col("clues"), F.col("n"), F.col("fps")).alias("f")).collect()]
    assert got == [python_frames(*c) for c in cases]
    said = spark.createDataFrame([([0, 1, 3], 32.0)], "f array<int>, fps double").select(prompts.frame_times(F.col("f"), F.col("fps"))).first()[0]
    assert said.endswith("are:\n\n0.0, 0.0312, 0.0938\n\n")


def test_rounding_by_binary_value(spark):
    values = [2.675, 0.125, 0.375, -1.00005, None, 1e20]
    got = spark.createDataFrame([(values,), (None,)], "v array<double>").select(prompts.rounded_floats(2)("v").alias("r")).collect()
    assert got[0].r == [2.67, 0.12, 0.38, -1.0, None, 1e20] and got[1].r is None


CASES = [('{"a": 1}', True), (' {"a": 1} ', True), ("{}", True), ('{"a": 1}x', False), ('{"a": 1} {"b": 2}', False), ('{"a": 1}, 2', False), ('{"a": 1}]junk', False), ("[1]", False), ("1", False), ("", False), (None, False), ("{'a': 1}", False), ('{"a": {"b": [1, "x, y"]}}', True), ('{"a": 1', False)]


def test_one_json_object_and_nothing_else(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES], "t string")
    assert [r[0] for r in df.select(nested.is_object(F.col("t"))).collect()] == [ok for _, ok in CASES]


def test_lines_with_something_behind_the_object_are_bad(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"x": 1}\n{"x": 2} more\n')
    assert [r.line for r in io.bad_lines(spark, str(p)).collect()] == [2]
    with pytest.raises(Exception, match="bad JSON line"):
        io.read_jsonl(spark, str(p), "x int").collect()


def test_required_subsets_and_summaries(spark):
    known = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    said = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    assert sorted(map(tuple, rows.required_subset(said, known, "k").collect())) == [(1, "a"), (2, "b"), (2, "c")]
    for stray in (7, None):
        with pytest.raises(Exception, match=f"not in the table: {'null' if stray is None else stray}"):
            rows.required_subset(said.union(spark.createDataFrame([(stray, "x")], said.schema)), known, "k").collect()
    with pytest.raises(ValueError, match="more than 5 rows"):
        io.summary_json(spark.range(6), most=5)
    assert io.summary_json(spark.range(0)) == "[]"


def test_marks_of_answers(spark):
    texts = ["yes: it is", "Yes, it is.", "yes-no", "no.", "1,000 (yes)", "." * 40 + "no", "a-b c", "a- b", "3.5 no. "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.yes_no(F.col("t"))).collect()] == ["Unknown", "Yes", "Unknown", "No", "Yes", "Unknown", "Unknown", "Unknown", "No"]
    words = [r[0] for r in df.select(tx.vqa_words(F.col("t"))).collect()]
    assert words[4] == "1000 yes" and words[6] == "b c" and words[7] == "b" and words[8] == "3.5 no"
    one = spark.createDataFrame([("The dogs dont\tsee ten cats!",)], "t string").select(tx.vqa_words(F.col("t"))).first()[0]
    assert one == "dogs don't see 10 cats"
