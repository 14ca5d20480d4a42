"""Line annotations in ZIP archives: boxes or quadrangles with confidence and text.

Archives are rows of (path, content), as Spark's ``binaryFile`` reads them; a table
function unpacks one at a time and gives its lines.  Lines are judged by DataFrame
functions, so a bad one is a row with its error, file and number.
"""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of ZIP files; each must fit a row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")


def archive_lines(archives: DataFrame, pattern: str = "", every: bool = False) -> DataFrame:
    """(path, name, line, text) of the lines of the entries of ``archives`` (path,
    content) whose names ``pattern`` matches; its first group, if it has one, is the name.

    Lines count from 1 and end with a line feed, with or without a carriage return; empty
    ones are left out.  Text is UTF-8, with or without a mark; bad bytes become the
    replacement character.  ``every``: an entry that doesn't match fails the query, as
    does content that is no archive; null content has no lines.
    """
    wanted = re.compile(pattern)

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not content.is_valid:
                    continue
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_buffer()))
                except zipfile.BadZipFile as e:
                    raise ValueError(f"{path} is no archive: {e}") from e
                for entry in archive.namelist():
                    m = wanted.match(entry)
                    if m is None:
                        if every:
                            raise ValueError(f"{path} has an entry of another name: {entry}")
                        continue
                    texts = [t.replace("\r", "") for t in archive.read(entry).decode("utf-8-sig", "replace").split("\n")]
                    kept = [(i, t) for i, t in enumerate(texts, 1) if t]
                    name = m.group(1) if m.groups() else entry
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(kept), pa.string()), pa.array([name] * len(kept), pa.string()), pa.array([i for i, _ in kept], pa.int64()), pa.array([t for _, t in kept], pa.string())], ["path", "name", "line", "text"])

    return archives.select("path", "content").mapInArrow(run, "path string, name string, line long, text string")


def annotations(lines: DataFrame, box: bool = True, transcription: bool = False, confidence: bool = False, width: int = 0, height: int = 0) -> DataFrame:
    """``lines`` (text; any others) with ``points``, ``confidence``, ``transcription`` and
    ``error``, null where the line is right.

    A line has xmin, ymin, xmax, ymax of a ``box``, else four corners, as whole numbers
    (the last two of a box not negative), then as asked a confidence and a text, which
    double quotes may enclose.  Boxes must not end before they begin, corners must go
    clockwise on the screen; with ``width`` and ``height`` every point must lie within the
    picture.  A bad line has no other values.  Null text is a bad line.
    """
    n = 4 if box else 8
    number = [r"\s*(-?[0-9]+)\s*"] * (2 if box else 8) + [r"\s*([0-9]+)\s*"] * (2 if box else 0)
    tail = (r",\s*([0-1].?[0-9]*)\s*" if confidence else "") + (",(.*)" if transcription else "")
    if box and not tail:
        tail = r",?\s*"
    pattern = "(?s)^" + ",".join(number) + tail + r"\z"
    group = lambda i: F.regexp_extract("text", pattern, i)
    fits = F.coalesce(F.rlike("text", F.lit(pattern)), F.lit(False))
    points = F.array(*[group(i + 1).try_cast("double") for i in range(n)])
    df = lines.withColumn("points", F.when(fits, points))
    p = lambda i: F.col("points")[i]
    sure = group(n + 1).try_cast("double") if confidence else F.lit(0.0)
    text = group(n + 1 + int(confidence)) if transcription else F.lit("")
    inner = F.regexp_extract(text, r'(?s)^\s*"(.*)"\s*\z', 1)
    quoted = F.rlike(text, F.lit(r'(?s)^\s*".*"\s*\z'))
    plain = F.when(quoted, F.replace(F.replace(inner, F.lit("\\\\"), F.lit("\\")), F.lit('\\"'), F.lit('"'))).otherwise(text)
    error = F.when(~fits, "format")
    if box:
        error = error.when(p(2) < p(0), "xmax before xmin").when(p(3) < p(1), "ymax before ymin")
    else:
        turn = sum(((p((2 * i + 2) % 8) - p(2 * i)) * (p((2 * i + 3) % 8) + p(2 * i + 1)) for i in range(4)), F.lit(0.0))
        error = error.when(turn > 0, "not clockwise")
    if width > 0 and height > 0:
        outside = F.exists(F.sequence(F.lit(0), F.lit(n // 2 - 1)), lambda i: ~F.get("points", 2 * i).between(0, width) | ~F.get("points", 2 * i + 1).between(0, height))
        error = error.when(outside, "outside of the picture")
    if confidence:
        error = error.when(sure.isNull(), "confidence")
    df = df.withColumns({"error": error, "confidence": sure, "transcription": plain})
    good = F.col("error").isNull()
    return df.withColumns({c: F.when(good, F.col(c)) for c in ("points", "confidence", "transcription")})


def checked(df: DataFrame) -> DataFrame:
    """Rows of ``annotations`` over ``archive_lines``; the first bad line that is read
    fails the query with its file, name, number and error."""
    said = F.concat(F.col("path"), F.lit(", "), F.col("name"), F.lit(", line "), F.col("line"), F.lit(": "), F.col("error"), F.lit(": "), F.coalesce("text", F.lit("")))
    return df.withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(F.raise_error(said))).drop("error")


def corners(points: Column) -> Column:
    """A box as four corners, clockwise; four corners as they are."""
    box = F.array(points[0], points[1], points[2], points[1], points[2], points[3], points[0], points[3])
    return F.when(F.size(points) == 4, box).otherwise(points)


def _clipped(shape: list, by: list) -> list:
    """What of a polygon lies within a convex one, edge by edge; both clockwise."""
    for (ax, ay), (bx, by_) in zip(by, by[1:] + by[:1], strict=True):
        if not shape:
            break
        side = [(bx - ax) * (y - ay) - (by_ - ay) * (x - ax) for x, y in shape]
        out = []
        for (px, py), (qx, qy), s, t in zip(shape, shape[1:] + shape[:1], side, side[1:] + side[:1], strict=True):
            if s >= 0:
                out.append((px, py))
            if (s > 0 > t) or (s < 0 < t):
                k = s / (s - t)
                out.append((px + (qx - px) * k, py + (qy - py) * k))
        shape = out
    return shape


def _turn(shape: list) -> float:
    """Twice the area, below 0 if the corners go the other way."""
    return sum(x * v - y * u for (x, y), (u, v) in zip(shape, shape[1:] + shape[:1], strict=True))


def polygon_iou(a, b) -> float:
    """Common area over joint area of two convex polygons of corners x1, y1, ...; 0 where
    one is null or has no area.  Polygons are small: plain numbers, no arrays."""
    if a is None or b is None:
        return 0.0
    x, y = ([(float(u), float(v)) for u, v in zip(p[::2], p[1::2], strict=True)] for p in (a, b))
    own, other = _turn(x), _turn(y)
    if len(x) < 3 or len(y) < 3 or own == 0 or other == 0:
        return 0.0
    x, y = x if own > 0 else x[::-1], y if other > 0 else y[::-1]
    shared = _clipped(x, y)
    both = abs(_turn(shared)) if len(shared) > 2 else 0.0
    return both / (abs(own) + abs(other) - both)


@F.pandas_udf(T.DoubleType())
def overlap(a, b):
    """``polygon_iou`` of two columns."""
    return a.combine(b, lambda p, q: polygon_iou(None if p is None else p.tolist(), None if q is None else q.tolist())).astype(float)
