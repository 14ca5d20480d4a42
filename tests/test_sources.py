import json

import pytest

from sparkloom.functions import text as tx
from sparkloom.operators import balance, rows
from sparkloom.sources import io


def test_jsonl_errors_name_file_and_line(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"x": 1}\n\nnot json\n{"x": 2}\n')
    assert [(r.line, r.text) for r in io.bad_lines(spark, str(p)).collect()] == [(3, "not json")]
    with pytest.raises(Exception, match="a.jsonl: bad JSON line: not json"):
        io.read_jsonl(spark, str(p), "x int").collect()


def test_several_paths_keys_shards_and_pages(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([((i, "a"),)], "row struct<x:int,y:string>").coalesce(1).write.parquet(str(tmp_path / f"train-{i}.parquet"))
    paths = [str(tmp_path / f"train-{i}.parquet") for i in range(3)]
    assert sorted(r.x for r in io.read_table(spark, paths, key="row").collect()) == [0, 1, 2]
    assert sorted(r.row.x for r in io.read_shards(spark, str(tmp_path), 2).collect()) == [0, 1]
    with pytest.raises(ValueError):
        io.read_shards(spark, str(tmp_path), 2, "test-*.parquet")
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "p.md").write_text("# A\n\ntext\n")
    assert [r.text for r in io.read_pages(spark, str(tmp_path / "pages")).collect()] == ["# A\n\ntext\n"]
    with pytest.raises(ValueError):
        io.write_table(spark.range(0), str(tmp_path / "none.parquet"), refuse_empty=True)
    with pytest.raises(KeyError):
        io.lookup(spark.range(3), "id", 7)
    assert io.output_name("d/x.tsv", "pred", "xlsx") == "d/x_pred.xlsx"
    assert json.loads(io.summary_json(spark.range(1))) == [{"id": 0}]


def test_strict_sync_and_union_fail_as_they_should(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    ok = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert sorted((r.k, r.v) for r in rows.strictly_synced(left, ok, "k", ["v"]).collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="several rows for key 2"):
        rows.strictly_synced(left, ok.union(ok.where("k = 2")), "k", ["v"]).collect()
    with pytest.raises(Exception, match="no row for key 2"):
        rows.strictly_synced(left, ok.where("k <> 2"), "k", ["v"]).collect()
    with pytest.raises(Exception, match="maps differ"):
        spark.sql("select map('a', '1') as a, map('a', '2') as b").select(rows.joined_maps("a", "b")).collect()


def test_letters_formats_and_equal_partitions(spark):
    cases = [("B is one two three", None), ("Sorry for the delay, the answer is B", "B"), ("Cannot determine the answer", "Z"), ("I say Z", "Z"), ("A and B", None), ("Failed to obtain answer via API", None), ("", None)]
    got = [r[0] for r in spark.createDataFrame([(c, i) for i, (c, _) in enumerate(cases)], "t string, i int").orderBy("i").select(tx.infer_letter(tx.F.col("t"))).collect()]
    assert got == [x for _, x in cases]
    forms = [("<ANSWER>x</ANSWER>", True), ("<answer>a <b> c</answer>", False), ("<answer>x</answer> y", False), ("<tool_response>1</tool_response><|im_start|>assistant <answer>x</answer>", True), ("<answer>x</answer> <tool_response>1</tool_response>", False)]
    got = [r[0] for r in spark.createDataFrame([(c, i) for i, (c, _) in enumerate(forms)], "t string, i int").orderBy("i").select(tx.strict_format(tx.F.col("t"))).collect()]
    assert got == [x for _, x in forms]
    assert balance.greedy([10, 1, 1, 1, 1, 1], 2, equal=True) == [[0, 3, 5], [1, 2, 4]]


def test_filtered_shards_keep_their_files(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in")).where("id % 2 = 0")
    io.write_filtered_shards(df.select("id", "_metadata"), str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 50 and {r[0] for r in out.select("shard").distinct().collect()} <= {p.name for p in (tmp_path / "in").iterdir()}
    assert "_metadata" not in out.columns


def test_mapped_once_goes_on(spark, tmp_path):
    seen = []

    def double(rows):
        seen.append(rows.count())
        return rows.selectExpr("k", "k * 2 AS v")

    cache = str(tmp_path / "cache")
    assert io.mapped_once(spark.range(5).toDF("k"), "k", cache, double).count() == 5
    out = io.mapped_once(spark.range(3, 9).toDF("k"), "k", cache, double)
    assert seen == [5, 4] and {tuple(r) for r in out.collect()} == {(k, 2 * k) for k in range(3, 9)}


def test_files_are_known_by_their_md5(spark, tmp_path):
    import hashlib

    p = tmp_path / "t.tsv"
    p.write_text("index\tquery\n1\tx\n")
    md5 = hashlib.md5(p.read_bytes()).hexdigest()
    assert io.read_checked(spark, str(p), md5, {"query": "question"}).columns == ["index", "question"]
    with pytest.raises(ValueError, match=f"has MD5 {md5}, not 0"):
        io.read_checked(spark, str(p), "0" * 32)


def test_rows_of_datasets_need_a_truth(spark):
    from sparkloom.operators import datasets

    df = spark.createDataFrame([(1, "q", "no truth")], "index long, question string, answer string")
    with pytest.raises(Exception, match="no number behind #### in: no truth"):
        datasets.dataset_rows(df, "gsm8k", "train").collect()
    with pytest.raises(Exception, match="no box in: no truth"):
        datasets.dataset_rows(df, "math", "train").collect()
    with pytest.raises(ValueError, match="no rows of"):
        datasets.dataset_rows(df, "other", "train")
    with pytest.raises(ValueError, match="no manager"):
        datasets.rewarded(df, df.index, "mask", "other")
    chat = spark.createDataFrame([(1, ["m"], ["t"])], "index long, messages array<string>, tools array<string>")
    assert datasets.chat_rows(chat, "src", "train").first().enable_thinking is False
