"""Files that may be written again, steps that survive restarts, users' own modules."""

import base64
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import extend
from sparkloom.sources import files
from sparkloom.streaming.loader import Loader, step_writer

# ------------------------------------------------------------------------- files


def tree(root):
    out = {}
    for folder, _, names in os.walk(root):
        for n in names:
            with open(os.path.join(folder, n), "rb") as f:
                out[os.path.relpath(os.path.join(folder, n), root)] = f.read()
    return out


def test_files_are_written_once(spark, tmp_path):
    rows = [(f"a{i % 3}/b/{i}.bin", bytes([i % 256]) * i) for i in range(40)]
    df = spark.createDataFrame([*rows, rows[5]], "path string, bytes binary").withColumn("other", F.lit(1))
    assert files.extracted(df, str(tmp_path / "x")) == {"written": 40, "skipped": 0}
    assert tree(tmp_path / "x") == dict(rows)
    assert files.write_files(df, f"file://{tmp_path}/x") == {"written": 0, "skipped": 40}
    # A file of another size is written over, one that is lost comes back.
    (tmp_path / "x" / "a1/b/1.bin").write_bytes(b"too long")
    (tmp_path / "x" / "a2/b/2.bin").unlink()
    assert files.write_files(df, str(tmp_path / "x")) == {"written": 2, "skipped": 38}
    assert tree(tmp_path / "x") == dict(rows)
    assert files.write_files(df.limit(0), str(tmp_path / "none")) == {"written": 0, "skipped": 0}


def test_a_run_that_fails_half_way_leaves_whole_files(spark, tmp_path):
    good = [(f"{i}.bin", b"x" * i) for i in range(60)]
    df = spark.createDataFrame(good, "path string, bytes binary").repartition(6)
    root = tmp_path / "x"
    root.mkdir()
    (root / "59.bin").mkdir()  # no file can be put here: its task fails
    (root / "59.bin" / "inner").write_bytes(b"")
    with pytest.raises(Exception, match="59.bin"):
        files.write_files(df, str(root))
    left = tree(root)
    assert all(left[p] == dict(good)[p] for p in left if "inner" not in p)
    assert not [p for p in os.listdir(root) if p.startswith(".waiting")]
    (root / "59.bin" / "inner").unlink()
    (root / "59.bin").rmdir()
    done = files.write_files(df, str(root))
    assert done["written"] + done["skipped"] == 60 and tree(root) == dict(good)


@pytest.mark.parametrize("rows", [[("../x", b"1")], [("/x", b"1")], [("", b"1")], [(None, b"1")], [("a/./b", b"1")], [("a//b", b"1")], [("s3://b/x", b"1")], [("a", None)], [("a", b"1"), ("a", b"2")]])
def test_bad_rows_are_refused_before_anything_is_written(spark, tmp_path, rows):
    df = spark.createDataFrame([("good", b"1"), *rows], "path string, bytes binary")
    with pytest.raises(ValueError, match="no path within"):
        files.write_files(df, str(tmp_path / "x"))
    assert tree(tmp_path / "x") == {}


def test_images_move_out_of_a_table(spark, tmp_path):
    image = {i: bytes([i]) * 60 for i in range(3)}
    rows = [(i, base64.b64encode(image[i]).decode(), "q") for i in range(3)] + [(7, "1", "q")]
    df = spark.createDataFrame(rows, "index long, image string, question string")
    out = files.localised(df, str(tmp_path))
    assert out.columns == ["index", "question", "image_path"]
    for r in out.collect():
        with open(r.image_path, "rb") as f:
            assert f.read() == image[1 if r["index"] == 7 else r["index"]]
    with pytest.raises(ValueError, match="without an image"):
        files.localised(df.where("index <> 1"), str(tmp_path / "y"))
    with pytest.raises(Exception, match="no base64"):
        files.localised(spark.createDataFrame([(1, "*" * 80, "q")], df.schema), str(tmp_path / "y")).count()
    named = files.localised(df.where("index < 2").withColumn("image_path", F.concat(F.lit("im/"), "index")), str(tmp_path / "z"))
    assert {r.image_path for r in named.collect()} == {f"{tmp_path}/z/im/{i}" for i in range(2)}


# ------------------------------------------------------------------------- steps


def rows_of(spark, path):
    return sorted((r.epoch, r.step, r.pos) for r in spark.read.parquet(path).select("epoch", "step", "pos").collect())


def test_no_row_is_lost_or_repeated_over_restarts(spark, tmp_path):
    df = spark.range(47).select(F.col("id").alias("pos"), (F.col("id") * 2).alias("v"))
    whole, cut = f"{tmp_path}/whole", f"{tmp_path}/cut"
    assert Loader(df, f"{tmp_path}/a", 10, 2, seed=3).run(step_writer(whole), at_once=4) == 10
    calls = []

    def failing(rows, epoch, step):
        """Fails twice, once before and once behind what it writes."""
        calls.append((epoch, step))
        if len(calls) == 4:
            raise RuntimeError("lost")
        step_writer(cut)(rows, epoch, step)
        if len(calls) == 7:
            raise RuntimeError("lost")

    at = [0]
    for _ in range(12):
        loader = Loader(df, f"{tmp_path}/b", 10, 2, seed=3)  # as a new driver would
        try:
            at.append(loader.run(failing, at_once=2, stop_after=1))
        except Exception as e:
            assert "lost" in str(e)
        if loader.position() == 10:
            break
    assert at == [0, 2, 4, 6, 8, 10] or at[-1] == 10
    assert len(calls) > 10 and rows_of(spark, cut) == rows_of(spark, whole)
    for epoch in range(2):
        assert sorted(p for e, _, p in rows_of(spark, whole) if e == epoch) == list(range(47))
    orders = [[p for e, s, p in rows_of(spark, whole) if e == k and s == 0] for k in range(2)]
    assert orders[0] != orders[1]
    assert Loader(df, f"{tmp_path}/b", 10, 2, seed=3).run(failing) == 10  # nothing is left


def test_another_reading_is_refused(spark, tmp_path):
    df = spark.range(9).withColumnRenamed("id", "pos")
    Loader(df, f"{tmp_path}/a", 4, 1, seed=3)
    for other in (dict(size=5), dict(size=4, seed=4), dict(size=4, epochs=2)):
        with pytest.raises(ValueError, match="another reading"):
            Loader(df, f"{tmp_path}/a", **{"epochs": 1, "seed": 3, **other})
    with pytest.raises(ValueError, match="another reading"):
        Loader(df.where("pos < 8"), f"{tmp_path}/a", 4, 1, seed=3)
    with pytest.raises(ValueError, match="nulls"):
        Loader(df.select(F.lit(None).cast("long").alias("pos")), f"{tmp_path}/b", 4)


def test_steps_of_odd_tables(spark, tmp_path):
    df = spark.range(9).withColumnRenamed("id", "pos")
    assert Loader(df.limit(0), f"{tmp_path}/a", 4).run(None) == 0
    seen = []
    loader = Loader(df, f"{tmp_path}/b", 4, drop_last=True)
    assert loader.run(lambda rows, e, s: seen.append(sorted(r["rank"] for r in rows.collect()))) == 2
    assert seen == [[0, 1, 2, 3], [4, 5, 6, 7]]


# ------------------------------------------------------------------ users' modules

SCORER = """
BASE = 0.5

def score(data_source, solution_str, ground_truth, bonus=0.0):
    return {"score": BASE + bonus + (solution_str == ground_truth), "more": 1}

def plain(data_source, solution_str, ground_truth):
    return len(data_source)

NUMBER = 3
"""


def test_a_scorer_from_a_file_works_in_tasks(spark, tmp_path):
    at = tmp_path / "mine.py"
    at.write_text(SCORER)
    df = spark.createDataFrame([("a", "x", "x"), ("bb", "x", "y")] * 8, "s string, t string, g string").repartition(4)
    got = df.select("s", extend.user_scorer(spark, str(at), "score", bonus=0.25)("s", "t", "g").alias("v"), extend.user_scorer(spark, str(at), "plain")("s", "t", "g").alias("n")).distinct().collect()
    assert {tuple(r) for r in got} == {("a", 1.75, 1.0), ("bb", 0.75, 2.0)}
    at.write_text(SCORER.replace("0.5", "2.0"))  # a changed file is another module
    assert {r.v for r in df.select(extend.user_scorer(spark, str(at), "score")("s", "t", "g").alias("v")).collect()} == {3.0, 2.0}
    with pytest.raises(AttributeError, match="no lost in"):
        extend.user_scorer(spark, str(at), "lost")
    with pytest.raises(TypeError, match="no function"):
        extend.user_scorer(spark, str(at), "NUMBER")
    with pytest.raises(FileNotFoundError):
        extend.user_scorer(spark, str(tmp_path / "none.py"), "score")
    at.write_text("1 / 0")
    with pytest.raises(RuntimeError, match="can't be loaded"):
        extend.user_scorer(spark, str(at), "score")


DATASET = """
from pyspark.sql import functions as F
from sparkloom.operators.extend import Dataset

class Mine(Dataset):
    TABLES = {"mine_v1": "PATH"}

    def post_build(self, data):
        return data.where("question <> ''")

    def evaluate(self, predictions):
        both = predictions.join(self.data, "index")
        return both.agg(F.avg((F.col("prediction") == F.col("answer")).cast("double")).alias("acc"))

class Other:
    pass
"""


def test_dataset_hooks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(extend, "DATASETS", {})
    spark.createDataFrame([(1, "q1", "A", "i.jpg"), (2, "q2", "B", None), (3, "", "C", None)], "index long, question string, answer string, image_path string").write.parquet(f"{tmp_path}/t.parquet")
    at = tmp_path / "sets.py"
    at.write_text(DATASET.replace("PATH", f"{tmp_path}/t.parquet"))
    cls = extend.register_dataset(extend.dataset_class(spark, str(at), "Mine"))
    mine = extend.dataset(spark, "mine_v1")
    assert isinstance(mine, cls) and mine.data.count() == 2
    got = {r["index"]: [tuple(m) for m in r.messages] for r in mine.prompts(mine.data).collect()}
    assert got == {1: [("image", "i.jpg"), ("text", "q1")], 2: [("text", "q2")]}
    said = spark.createDataFrame([(1, "A"), (2, "A"), (3, "C")], "index long, prediction string")
    assert mine.evaluate(said).first().acc == 0.5
    with pytest.raises(ValueError, match="no class"):
        extend.dataset(spark, "lost")
    with pytest.raises(TypeError, match="no Dataset"):
        extend.dataset_class(spark, str(at), "Other")
    with pytest.raises(ValueError, match="registered already"):
        extend.register_dataset(type("Mine", (extend.Dataset,), {"evaluate": lambda self, p: p}))


def test_metrics_by_name(spark, monkeypatch):
    monkeypatch.setattr(extend, "METRICS", {})
    extend.register_metric("same")(lambda a, b: (a == b).cast("double"))
    df = spark.createDataFrame([("g", "x", "x"), ("g", "x", "y"), ("h", "x", "x")], "k string, a string, b string")
    assert {tuple(r) for r in extend.metrics_of(df, ["same"], "a", "b", by=["k"]).collect()} == {("g", 0.5), ("h", 1.0)}
    with pytest.raises(ValueError, match="no metric"):
        extend.metrics_of(df, ["lost"], "a", "b")
    with pytest.raises(ValueError, match="registered already"):
        extend.register_metric("same")(lambda a, b: a)
