"""Archives of line annotations: every kind of bad line, and overlaps against a grid."""

import io
import zipfile

import numpy as np
import pytest

from sparkloom.sources import annotations as an


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return out.getvalue()


def test_lines_of_archives(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.zip").write_bytes(archive({"gt_img_1.txt": "﻿1,2,3,4\r\n\r\nx\r\n".encode(), "gt_img_2.txt": b"\xff1", "other.md": "no"}))
    (tmp_path / "deep" / "b.zip").write_bytes(archive({"gt_img_7.txt": "a\nb", "empty.txt": ""}))
    (tmp_path / "c.txt").write_text("no archive")
    df = an.read_archives(spark, str(tmp_path))
    got = sorted((r.path.rsplit("/", 1)[1], r.name, r.line, r.text) for r in an.archive_lines(df, r"gt_img_(\d+)\.txt").collect())
    assert got == [("a.zip", "1", 1, "1,2,3,4"), ("a.zip", "1", 3, "x"), ("a.zip", "2", 1, "�1"), ("b.zip", "7", 1, "a"), ("b.zip", "7", 2, "b")]
    with pytest.raises(Exception, match="another name"):
        an.archive_lines(df, r"gt_img_(\d+)\.txt", every=True).collect()
    bad = spark.createDataFrame([("p", b"no archive"), ("q", None)], "path string, content binary")
    with pytest.raises(Exception, match="p is no archive"):
        an.archive_lines(bad).collect()
    assert an.archive_lines(bad.where("path = 'q'")).count() == 0


CASES = [
    (dict(), "1,2,3,4", [1, 2, 3, 4], None), (dict(), " -1 , 2,3,4 ,", [-1, 2, 3, 4], None), (dict(), "1,2,-3,4", None, "format"), (dict(), "5,2,3,4", None, "xmax before xmin"), (dict(), "1,5,3,4", None, "ymax before ymin"),
    (dict(), "1,2,3", None, "format"), (dict(), "1,2,3,4,5", None, "format"), (dict(), None, None, "format"), (dict(), "1.5,2,3,4", None, "format"),
    (dict(width=10, height=10), "1,2,10,10", [1, 2, 10, 10], None), (dict(width=10, height=10), "1,2,11,10", None, "outside of the picture"), (dict(width=10, height=10), "-1,2,3,10", None, "outside of the picture"),
    (dict(box=False), "0,0,4,0,4,4,0,4", [0, 0, 4, 0, 4, 4, 0, 4], None), (dict(box=False), "0,0,0,4,4,4,4,0", None, "not clockwise"), (dict(box=False), "0,0,4,0,4,4,0", None, "format"),
    (dict(confidence=True), "1,2,3,4,0.5", [1, 2, 3, 4], None), (dict(confidence=True), "1,2,3,4,7", None, "format"), (dict(confidence=True), "1,2,3,4,1x5", None, "confidence"),
    (dict(transcription=True), "1,2,3,4,a, b", [1, 2, 3, 4], None),
]


@pytest.mark.parametrize("options, text, points, error", CASES)
def test_lines(spark, options, text, points, error):
    got = an.annotations(spark.createDataFrame([(text,)], "text string"), **options).first()
    assert (got.points, got.error) == (points, error)


def test_texts_and_confidences(spark):
    lines = ['1,2,3,4,0.25,plain, text', '1,2,3,4,1, "in \\"quotes\\" and \\\\ more" ', "1,2,3,4,0,###", "1,2,3,4,"]
    df = an.annotations(spark.createDataFrame([("z", "f", i, t) for i, t in enumerate(lines)], "path string, name string, line long, text string"), transcription=True, confidence=True)
    assert [(r.confidence, r.transcription) for r in df.orderBy("line").collect()] == [(0.25, "plain, text"), (1.0, 'in "quotes" and \\ more'), (0.0, "###"), (None, None)]
    assert an.checked(df.where("line < 3")).count() == 3
    with pytest.raises(Exception, match="z, f, line 3: format: 1,2,3,4,"):
        an.checked(df).collect()


def test_overlaps_against_a_grid(spark):
    rng = np.random.RandomState(5)

    def quad():
        c, r = rng.uniform(3, 7, 2), rng.uniform(1, 3)
        angles = np.sort(rng.uniform(0, 2 * np.pi, 4))
        return np.stack([c[0] + r * np.cos(angles), c[1] + r * np.sin(angles)], axis=1)

    xs, ys = np.meshgrid(np.arange(0, 10, 0.02) + 0.01, np.arange(0, 10, 0.02) + 0.01)

    def inside(shape):
        ok = np.ones_like(xs, bool)
        for a, b in zip(shape, np.roll(shape, -1, axis=0)):
            ok &= (b[0] - a[0]) * (ys - a[1]) - (b[1] - a[1]) * (xs - a[0]) >= 0
        return ok

    for _ in range(40):
        a, b = quad(), quad()
        x, y = inside(a), inside(b)
        want = (x & y).sum() / max((x | y).sum(), 1)
        assert an.polygon_iou(a.ravel(), b.ravel()) == pytest.approx(want, abs=0.02)
        assert an.polygon_iou(a[::-1].ravel(), b.ravel()) == pytest.approx(an.polygon_iou(a.ravel(), b.ravel()))
    df = spark.createDataFrame([([0.0, 0.0, 2.0, 2.0], [1.0, 0.0, 3.0, 2.0]), ([0.0, 0.0, 1.0, 1.0], None)], "a array<double>, b array<double>")
    assert [r.o for r in df.select(an.overlap(an.corners(df.a), an.corners(df.b)).alias("o")).collect()] == [pytest.approx(1 / 3), 0.0]
