import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import answers, geometry, nested, similarity, tables, text
from sparkloom.operators import advantage, balance, batch, conversation, curate, losses, metrics, rows
from sparkloom.sources import io


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_grpo_known_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", 1.0), ("b", 3.0)], "uid string, score double")
    out = sorted(values(advantage.grpo(df), "uid", "advantage"))
    assert out[0][1] == pytest.approx(-1.15470, abs=1e-4) and out[1][1] == pytest.approx(0.57735, abs=1e-4)
    assert out[3][1] == pytest.approx(3.0, abs=1e-4)


def test_passk_needs_two(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "uid string, pos int, score double")
    with pytest.raises(Exception, match="two responses"):
        advantage.grpo_passk(df).collect()


def test_registry_refuses_a_second_function():
    with pytest.raises(ValueError):
        advantage.register("grpo")(lambda df: df)


def test_eos_mask(spark):
    df = spark.createDataFrame([([5, 1, 1, 2],), ([3, 4],)], "ids array<int>")
    assert [r[0] for r in df.select(advantage.until_first_eos(F.col("ids"), [1])).collect()] == [[1, 1, 0, 0], [1, 1]]


def test_remax_known_values(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1, 1, 0])], "r array<double>, m array<int>")
    assert df.select(advantage.remax_returns("r", "m")).first()[0] == [3.0, 2.0, 0.0]


def test_kl_controller_agrees_with_the_table_form(spark):
    kls = [0.1, 0.5, 0.2, 0.9]
    df = spark.createDataFrame(list(enumerate(kls)), "step int, kl double")
    got = [r["coefficient"] for r in advantage.kl_coefficients(df, 0.2, 0.3, 10000, 256).orderBy("step").collect()]
    assert got == pytest.approx(advantage.kl_controller(kls, 0.2, 0.3, 10000, 256))


def test_repeat_forms(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos long, v string")
    assert [r.v for r in batch.repeat(df, 2).orderBy("pos").collect()] == list("aabbcc")
    assert [r.v for r in batch.repeat(df, 2, False, total=F.lit(3)).orderBy("pos").collect()] == list("abcabc")
    counted = df.withColumn("n", F.element_at(F.array(F.lit(3), F.lit(1), F.lit(0)), (F.col("pos") + 1).cast("int")))
    assert sorted(r.v for r in batch.repeat_by(counted, F.col("n")).collect()) == list("aaab")


def test_pad_fold_unfold(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(3)], "pos long, v long")
    padded = batch.pad_to_multiple(df, 7, 3)
    assert [r.v for r in padded.orderBy("pos").collect()] == [0, 10, 20, 0, 10, 20, 0]
    assert batch.unpad(padded, 3).count() == 3
    back = batch.unfold(batch.fold(padded.where("pos < 6"), 2, "v"), "v")
    assert sorted(values(back, "pos", "v")) == sorted(values(padded.where("pos < 6"), "pos", "v"))


def test_positional_union_refuses_a_difference(spark):
    a = spark.createDataFrame([(0, 1)], "pos long, v long")
    with pytest.raises(Exception, match="differs"):
        batch.positional_union(a, a.withColumn("v", F.lit(2).cast("long"))).collect()


def test_merge_of_roles(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a "), (1, 2, "assistant", " b"), (1, 3, "user", "")], "conv_id long, turn long, role string, text string")
    out = sorted(values(conversation.merge_same_role(df), "turn", "role", "text"))
    assert out == [(0, "user", "q"), (1, "assistant", "a\nb"), (3, "user", "")]


def test_observation_is_wrapped_once(spark):
    df = spark.createDataFrame([("x",), ("<tool_response>x</tool_response>",)], "t string")
    out = [r[0] for r in df.select(conversation.wrap_observation(F.col("t"))).collect()]
    assert out == ["<tool_response>\nx\n</tool_response>", "<tool_response>x</tool_response>"]


def test_tool_calls(spark):
    t = '<tool_call>{"name": "zoom", "arguments": {}}</tool_call><tool_call>no json</tool_call><tool_call>{"name": "fly", "arguments": 1}</tool_call>'
    df = spark.createDataFrame([(t,)], "t string")
    assert [r["error"] for r in df.select(conversation.tool_calls(F.col("t"), ["zoom"])).first()[0]] == [None, "not_an_object", "unsupported_tool"]


def test_rules_take_the_first_match_and_empty_first(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("ab",), ("b",), ("c",)], "t string")
    out = [r[0] for r in df.select(curate.classify(F.col("t"), [("a", "a"), ("b", "b")])).collect()]
    assert out == ["empty", "empty", "a", "b", "keep"]


def test_group_filters_and_conflicts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 1.0), ("c", 5.0)], "uid string, s double")
    assert {r.uid for r in curate.group_variance_filter(df, "uid", "s").collect()} == {"b", "c"}
    assert {r.uid for r in curate.without_conflicts(df, ["uid"], "s").collect()} == {"a", "c"}


def test_balance_covers_everything():
    lengths = [7, 1, 9, 3, 3, 8, 2, 6]
    for method in (balance.differencing, balance.greedy):
        for equal in (False, True):
            parts = method(lengths, 4, equal)
            assert sorted(i for p in parts for i in p) == list(range(8))
            if equal:
                assert {len(p) for p in parts} == {2}
    sums = [sum(lengths[i] for i in p) for p in balance.differencing(lengths, 4)]
    assert max(sums) - min(sums) <= 2


def _merged(lengths, k):
    """Largest differencing over plain lists, the two foremost states found anew each time."""
    states = [[(n, 1, [(i, n)])] + [(0, 0, [])] * (k - 1) for i, n in enumerate(lengths)]
    while len(states) > 1:
        states = [sorted(s, reverse=True) for s in states]
        states.sort(key=lambda s: (s[0][0] - s[-1][0], s[0]))
        a, b = states.pop(), states.pop()
        states.append([tuple(u + v for u, v in zip(x, y, strict=True)) for x, y in zip(a, b[::-1], strict=True)])
    return sorted(sorted(i for i, _ in s[2]) for s in states[0])


def test_differencing_by_brute_force():
    rng = np.random.RandomState(7)
    for _ in range(60):
        lengths = rng.randint(1, 6, size=rng.randint(3, 14)).tolist()
        for k in (2, 3):
            assert sorted(balance.differencing(lengths, k)) == _merged(lengths, k)


def test_translation_scores():
    assert similarity.bleu_score("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(1.0)
    assert similarity.bleu_score("the cat", "the cat") == 0.0 and similarity.bleu_score(None, "a") == 0.0
    assert similarity.translation_tokens("Hi, it's 3.5-4.") == ["Hi", ",", "it's", "3.5", "-", "4", "."]
    # 3 of 5 words, 1 of 4 pairs, no triple or longer run: half and a quarter of a match.
    want = (3 / 5 * 1 / 4 * 1 / (2 * 3) * 1 / (4 * 2)) ** 0.25
    assert similarity.bleu_score("a b x c y", "a b q c z") == pytest.approx(want)
    assert similarity.gleu_score("a b c", "a b d") == pytest.approx(3 / 6) and similarity.gleu_score("", "") == 0.0


def test_majority_takes_the_first_seen_on_ties(spark):
    df = spark.createDataFrame([("p", 0, "A", 0.9), ("p", 1, "B", 0.8), ("p", 2, "A", 0.7), ("p", 3, "B", 0.1)], "g string, pos int, vote string, v double")
    assert metrics.majority(df, ["g"], "vote", "v", "pos").first()["majority"] == 0.9
    assert metrics.schedule(6) == [2, 4, 6] and metrics.schedule(1) == []


def test_bootstrap_near_the_exact_expectation(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 6)], "g string, v double")
    b = metrics.bootstrap(df, ["g"], "v", 3).first()
    assert b["best_mean"] == pytest.approx(metrics.best_of(df, ["g"], "v", 3).first()["best_of"], abs=0.15)


def test_answers(spark):
    t = "<answer>no</answer> x <ANSWER> Yes </ANSWER>"
    df = spark.createDataFrame([(t, "1,234"), (None, None), ("none", "x")], "t string, n string")
    assert [r[0] for r in df.select(text.last_answer(F.col("t"))).collect()] == ["Yes", None, None]
    assert [r[0] for r in df.select(text.first_answer(F.col("t"))).collect()] == ["no", None, None]
    boxed = spark.createDataFrame([("a \\boxed{x{1}y} b",), ("none",)], "t string")
    assert [r[0] for r in boxed.select(text.last_boxed("t")).collect()] == ["x{1}y", None]


def test_similarities(spark):
    df = spark.createDataFrame([("ca", "abc"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(similarity.damerau("a", "b")).collect()] == pytest.approx([1 - 2 / 3, 1.0])
    cell = "<table><tr><td>{}</td></tr></table>".format
    assert similarity.table_similarity(cell("ab"), cell("ac")) == pytest.approx(1 - 0.5 / 2)
    assert similarity.table_similarity(cell("ab"), cell("xy"), True) == 1.0
    assert similarity.table_similarity(cell("ab"), "<table><tr><td rowspan='2'>ab</td></tr></table>") == 0.5
    assert similarity.table_similarity(cell("a<b>b</b>"), cell("ab")) == pytest.approx(1 - 0.5 / 3)
    assert [similarity.table_similarity(a, b) for a, b in ((None, None), ("", cell("a")), ("<p>x</p>", cell("a")))] == [0.0, 0.0, 0.0]
    assert similarity.assignment([[4, 1, 3], [2, 0, 5], [3, 2, 2]]) == [1, 0, 2]


def test_boxes(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1000.0, 500.0],), ([5.0, 5.0, 5.0, 9.0],)], "box array<double>")
    assert [r[0] for r in df.select(geometry.absolute_box("box", F.lit(200), F.lit(100))).collect()] == [[0.0, 0.0, 200.0, 50.0], None]


def test_pad_and_masks(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [0, 0, 1, 1, 1])], "ids array<int>, m array<int>")
    assert df.select(losses.without_left_padding(F.col("ids"), F.col("m"))).first()[0] == [3, 4, 5]
    assert df.select(losses.padded(F.col("ids"), 3, 0, truncate="middle")).first()[0] == [1, 4, 5]


def test_jsonl_and_tables(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"x": 1}\n\n{"x": 2}\n')
    assert io.read_jsonl(spark, str(good), "x int").count() == 2
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"x": 1}\n[3]\n')
    with pytest.raises(Exception, match="bad JSON"):
        io.read_jsonl(spark, str(bad), "x int").collect()
    df = spark.createDataFrame([(1, 'say "hi"\tnow')], "a int, b string")
    for kind in ("parquet", "csv", "tsv", "jsonl"):
        io.write_table(df, str(tmp_path / f"t.{kind}"), kind)
        assert io.read_table(spark, str(tmp_path / f"t.{kind}")).first()["b"] == 'say "hi"\tnow'
    assert io.flat_metrics(spark.createDataFrame([("k", 1.0, 2.0)], "k string, x double, y double"), ["k"]).count() == 2


def test_stream_runs_until_full(spark, tmp_path, sf):
    from sparkloom.streaming import windows

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    windows.run_until_full(stream, str(tmp_path / "out"), 300, str(tmp_path / "check"), lambda b: b.where("value > 10"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300
    windows.run_until_full(stream, str(tmp_path / "out"), 300, str(tmp_path / "check2"), lambda b: b.where("value > 10"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300


def test_answer_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    lit = F.lit
    for text, right, want in [("<think>a</think><answer>b</answer>", True, 1.0), ("a</think><answer>b</answer>", False, 0.2), ("b", True, 0.8), ("a</think><answer>" + "b" * 300 + "</answer>", True, 0.0), (None, None, 0.0)]:
        assert one(answers.tagged_reward(lit(text).cast("string"), lit(right).cast("boolean")))["score"] == pytest.approx(want)
    call = "<think>a</think><tool_call>q</tool_call><answer>b</answer>"
    assert one(answers.tagged_reward(lit(call), lit(True), ("code", "tool_call"), costly="tool_call"))["score"] == pytest.approx(0.92)
    for text, gold, want in [("Answer: x=\\frac12", "\\frac{1}{2}", 1), ("so\nanswer: 1,234 dollars", "1234", 1), ("Answer: 3\nAnswer: 4", "3", -1), ("4", "4", -1), ("Answer: \\sqrt2", "\\sqrt{2}", 1)]:
        assert one(answers.answer_line_score(lit(text), lit(gold))) == want
    assert [one(answers.letter_behind(lit(x))) for x in ("The answer is B", "\\boxed{(C)}", "The best option is D", "e", "")] == ["B", "(C)", "D", "E", "A"]
    assert one(answers.letter_behind(lit("Best Choice: D"), boxed=False)) == "B"
    assert one(answers.clean_string(lit(" \"Ten\" (about) "))) == "ten" and one(answers.clean_string(lit("$4.5 %"))) == "4.5"
    assert [one(answers.must_match(lit(x))) for x in ("555-1234", "2024-01-02", "a@b.org", "x.py", "ten")] == [True, True, True, True, False]
    assert one(answers.contents(lit("a<t>1</t>\n<t>2\n</t>"), "<t>", "</t>")) == ["1", "2\n"]
    assert one(answers.without_images(lit('["data:image/png;AA", "b"]'))) == '["<image data URL omitted: 17 chars>", "b"]'
    assert one(answers.unpacked(lit("{'response': 'x', 'thinking': 't'}"))).asDict() == {"prediction": "x", "thinking": "t", "raw_response": "", "images": [""]}
    assert one(answers.relative_closeness(lit("9"), lit("10"))) == pytest.approx(0.9) and one(answers.relative_closeness(lit("x"), lit("0"))) == 0.0
    assert one(answers.proximity(lit(48.8566), lit(2.3522), lit(51.5074), lit(-0.1278))) == pytest.approx(0.0323, abs=2e-4)
    df = spark.createDataFrame([("0.12", "12%"), ("12.3456", "12.35"), ("100", "100.9"), ("x", "1"), (None, "1")], "g string, s string")
    assert [r[0] for r in df.select(answers.equal_as_shown()("g", "s")).collect()] == [False, True, False, False, False]
    assert [r[0] for r in df.select(answers.equal_as_shown(True, True)("g", "s")).collect()] == [True, True, True, False, False]
    m = spark.sql("select array(struct('user' as role, 2 as n), struct('assistant' as role, 3 as n), struct('assistant' as role, 1 as n)) as m")
    assert m.select(answers.turn_loss_mask("m", 2)).first()[0] == [0, 0, 0, 0, 1, 0]


def test_metrics_at_k_against_draws(spark):
    """Exact expectations lie within the noise of 1000 draws; all draws of two of three values are listed."""
    df = spark.createDataFrame([("s", "p", float(x)) for x in (1, 2, 4)] + [("s", "q", 5.0)], "s string, p string, v double")
    got = {r["metric"]: r["value"] for r in metrics.validation_at(df, "s", "p", "v").collect()}
    draws = np.array([(a, b) for a in (1, 2, 4) for b in (1, 2, 4)])
    assert set(got) == {"mean@3", "std@3", "mean@1"} | {f"{b}@{k}/{m}" for b in ("best", "worst") for k in (2, 3) for m in ("mean", "std")}
    assert got["best@2/mean"] == pytest.approx(draws.max(axis=1).mean()) and got["best@2/std"] == pytest.approx(draws.max(axis=1).std())
    assert got["worst@2/mean"] == pytest.approx(draws.min(axis=1).mean()) and got["worst@2/std"] == pytest.approx(draws.min(axis=1).std())


def test_token_count(spark):
    from pathlib import Path

    path = Path("/opt/tokenizers/byte_bpe_50k.json")
    if not path.exists():
        pytest.skip("no tokenizer file")
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    assert [r[0] > 0 for r in df.select(rows.token_count(str(path))("t")).collect()] == [True, False, False]


def test_shuffled_rank_is_a_permutation(spark):
    df = spark.range(1000).withColumnRenamed("id", "pos")
    one = [tuple(r) for r in batch.shuffled_rank(df, 1, bits=4).orderBy("rank").select("rank", "pos", "total").collect()]
    assert [r for r, _, _ in one] == list(range(1000)) and {t for _, _, t in one} == {1000}
    assert sorted(p for _, p, _ in one) == list(range(1000)) and [p for _, p, _ in one] != list(range(1000))
    other = batch.shuffled_rank(df, 2, bits=4).orderBy("rank").select("pos").collect()
    assert [p for _, p, _ in one] != [r[0] for r in other]
    assert batch.shuffled_rank(df.limit(0), 1).count() == 0
    assert batch.shuffled_rank(spark.createDataFrame([(None,), (None,), (3,)], "pos long"), 1).select("rank").distinct().count() == 3


def test_multinomial_resample(spark):
    df = spark.createDataFrame([(0, i, float(i == 3)) for i in range(8)] + [(1, i, 1.0) for i in range(500)], "b long, pos long, s double")
    out = batch.multinomial_resample(batch.resample_weights(df, "b", "s"), "b", "weight", 7).toPandas()
    assert out[out.b == 0].pos.tolist() == [3] * 8
    times = out[out.b == 1].pos.value_counts()
    assert times.sum() == 500 and 0.58 < len(times) / 500 < 0.68  # 1 - 1/e of the rows come up
    assert batch.resample_weights(df, "b", "s", "max_random").where("b = 0").agg(F.sum("weight")).first()[0] == pytest.approx(0.4 + 7 * 0.1, abs=1e-6)
    with pytest.raises(ValueError, match="no such weights"):
        batch.resample_weights(df, "b", "s", "best")


def test_nested_json_edges():
    assert nested.objects_in(None) == [] and nested.objects_in('{"a": {"b": 1}} {') == ['{"a": {"b": 1}}']
    assert nested.flat_pairs("no") == [] and nested.flat_pairs('{"menu": [{"name": ["cake"]}, {"name": ["juice"]}]}') == [("menu.name", "cake"), ("menu.name", "juice")]
    assert nested.ordered("no") == "no" and nested.ordered('{"b": 1, "a": 2}') == '{"a": 2, "b": 1}'


def test_path_rules(spark):
    df = spark.createDataFrame([(1, ["/a", "b", "b", ""]), (2, ["c"]), (3, None)], "id long, p array<string>")
    there = spark.createDataFrame([("c",), ("old/b",)], "path string")
    assert sorted(map(tuple, rows.faulty_paths(df, "id", "p", there).collect())) == [(1, "/a", "absolute"), (1, "b", "missing")]
    one = spark.createDataFrame([(1, "b"), (2, "c"), (3, "x")], "id long, p string")
    assert sorted(map(tuple, rows.first_existing(one, "id", "p", ["new", "old"], there).collect())) == [(1, "b", "old/b"), (2, "c", "c"), (3, "x", None)]


def test_table_and_form_rules(spark):
    assert tables.plain_text("Café “x” [1]†.") == 'cafe "x" [1]†' and tables.plain_text("Ten (about)[2]") == "ten" and tables.plain_text('"A"') == "a" and tables.plain_text(None) == ""
    same = [("5|a", "A|5.0", True), ("5", "5|5.0", True), ("5", "5|6", False), ("2024-05-xx", "2024-5-XX", True), ("2024-13-01", "2024-13-01", True), ("2020-xx-xx", "2020", True), ("a\\pb", "a|b", False), (None, "", True), ("nan", "NaN", True)]
    assert [tables.same_denotations(a, b) for a, b, _ in same] == [w for _, _, w in same]
    assert tables.amounts("$1,234") == (1234.0, 1234.0) and tables.amounts("3 million dollars")[0] == 3e6 and tables.amounts("5 %") == (0.05, 5.0) and tables.amounts("none") == ("none", "none")
    assert tables.reindented("if a:\nb\nelse:\nc") == "if a:\n    b\nelse:\n    c" and tables.reindented(None) is None
    assert tables.field_counts('{"a": [1, 1]}', '{"a": [1, 2]}') == [1, 2] and tables.field_counts("no", '{"a": 1}') == [0, 1] and tables.field_counts(None, None) == [0, 0]
    assert spark.createDataFrame([("no", "no")], "s string, g string").transform(lambda d: tables.form_f1(d, "s", "g")).first()[0] == 0.0


def test_mask_first_rank(spark):
    df = spark.createDataFrame([(-5, True), (0, False), (7, None), (8, True), (10**12, False)], "pos long, m boolean")
    for buckets in (1, 3, 4096):
        out = batch.mask_first_rank(df, "m", buckets=buckets)
        assert sorted(map(tuple, out.select("rank", "pos", "total").collect())) == [(0, -5, 5), (1, 8, 5), (2, 0, 5), (3, 7, 5), (4, 10**12, 5)]
    assert batch.mask_first_rank(df.limit(0), "m").count() == 0 and batch.mask_first_rank(df.limit(1), "m").first()["rank"] == 0


def test_accuracy_band_by_number_and_text(spark):
    df = spark.createDataFrame([(u, float((u + i) % 3 > 0), 5) for u in range(20) for i in range(2)], "uid long, score double, length int")
    a = curate.accuracy_band(df, "uid", "score", "length", 0.4, 0.6, 9, 2.0)
    b = curate.accuracy_band(df.withColumn("uid", F.format_string("%03d", "uid")), "uid", "score", "length", 0.4, 0.6, 9, 2.0)
    assert sorted({r["uid"] for r in a.collect()}) == sorted({int(r["uid"]) for r in b.collect()}) and a.count() == b.count() == 20


def test_question_kinds(spark):
    want = {"What colour is it?": "real_world_perception_candidate", "Find x": "math_reasoning", "In summer?": "real_world_perception_candidate", "the sum": "math_reasoning", "Following table: how many?": "chart_or_diagram", "the diagram": "chart_or_diagram", "Run Python": "code_or_symbolic_task", "programmes": "real_world_perception_candidate", "Sudoku": "logic_puzzle", "\n ": "empty_question", None: "empty_question", "\\sqrt 2": "math_reasoning"}
    df = spark.createDataFrame([(k,) for k in want], "q string")
    assert [r[0] for r in df.select(curate.question_kind(F.col("q"))).collect()] == list(want.values())


def test_majority_at_against_single_draws(spark):
    votes, vals = ["A", "B", "A", None, "B"], [0.9, 0.8, 0.7, 0.3, 0.1]
    rows_ = [("p", i, v, x) for i, (v, x) in enumerate(zip(votes, vals, strict=True))] + [("q", 0, "A", 1.0)]
    df = spark.createDataFrame(rows_, "g string, pos int, vote string, v double")
    out = {r["k"]: (r["maj_mean"], r["maj_std"]) for r in metrics.majority_at(df, ["g"], "v", "vote", "pos").collect()}
    assert set(out) == {2, 4, 5}
    best = {r["best_mean"] for r in metrics.bootstrap(df.where("g = 'p'"), ["g"], "v", 4, pos="pos").collect()}
    for k in out:
        np.random.seed(42)
        got, top = [], []
        for _ in range(1000):
            at = np.random.choice(5, size=k, replace=True)
            counts = {}
            for i in at:
                counts.setdefault(votes[i], []).append(vals[i])
            got.append(max(counts.values(), key=len)[0])
            top.append(max(vals[i] for i in at))
        assert out[k] == pytest.approx((np.mean(got), np.std(got)))
        if k == 4:
            assert list(best) == [pytest.approx(np.mean(top))]


def test_weighted_resample_draws_in_proportion(spark):
    from sparkloom.operators import batch

    df = spark.range(400).select(F.col("id").alias("pos"), (F.col("id") % 7).cast("double").alias("w"))
    for draws in (1, 37, 400, 5000):
        got = {r.pos: r["count"] for r in batch.weighted_resample(df, F.col("w"), draws, seed=4).groupBy("pos").count().collect()}
        assert sum(got.values()) == draws
        total = sum(i % 7 for i in range(400))
        for i in range(400):  # systematic draws: the whole parts on either side
            assert abs(got.get(i, 0) - draws * (i % 7) / total) < 1
    plan = batch.weighted_resample(df, F.col("w"), 5, seed=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "_h" in plan and plan.count("Window") <= 3
    assert batch.weighted_resample(df, F.lit(0.0), 5, seed=4).count() == 0
    assert batch.weighted_resample(df.limit(0), F.col("w"), 5, seed=4).count() == 0
    assert batch.weighted_resample(df, F.when(F.col("pos") == 3, 2.0), 5, seed=4).groupBy("pos").count().collect() == [(3, 5)]


def test_ranks_of_texts(spark):
    from sparkloom.operators import batch

    names = [f"prompt-{i * i % 10_007:06d}-é{i}" for i in range(500)] + ["prompt-", "prompt-\u65e5", "prompt-zz"]
    df = spark.createDataFrame([(n, i % 3 == 0) for i, n in enumerate(names)], "uid string, good boolean")
    got = {r.uid: r["rank"] for r in batch.mask_first_rank(df, "good", "uid").collect()}
    want = sorted(enumerate(names), key=lambda x: (x[0] % 3 != 0, x[1].encode()))
    assert got == {n: k for k, (_, n) in enumerate(want)}
    assert batch.mask_first_rank(df.limit(0), "good", "uid").count() == 0
    one = spark.createDataFrame([("a", True)], "uid string, good boolean")
    assert [r["rank"] for r in batch.mask_first_rank(one, "good", "uid").collect()] == [0]
