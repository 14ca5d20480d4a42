"""Binary cells as files: a sink that may be run again, and images moved out of a table.

Tasks write the files where they run, through the file system of the target's scheme,
each under a name of its own first and then by a rename, so a file is whole or not
there.  A file that is there with the right size is passed over.  Nothing but counts
reaches the driver.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortest text that is an image; a shorter one names the row that has it.
LEAST_IMAGE = 65


def relative(path: Column) -> Column:
    """Whether a path stays within its root: not empty, absolute or with a scheme, and
    no part of it is ``..`` or empty."""
    return F.coalesce((path != "") & ~path.rlike(r"^/|^[A-Za-z][A-Za-z0-9+.-]*:|(^|/)\.{0,2}(/|$)|\\|\x00"), F.lit(False))


def write_files(df: DataFrame, root: str, path: str = "path", content: str = "bytes") -> dict[str, int]:
    """Writes ``content`` of each row to ``path`` under ``root`` and returns the numbers of
    files ``written`` and ``skipped`` (there already, of that size).

    A run that failed half-way, or a second one, leaves what one run leaves.  A path that
    is null or leaves the root, null content, and two contents for one path are errors
    before anything is written; equal rows are one file.  ``root`` must be a folder that
    all executors reach.
    """
    rows = df.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("bytes"))
    seen = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("bytes")).alias("a"), F.max(F.xxhash64("bytes")).alias("b"), F.count("bytes").alias("known"))
    bad = seen.where(~relative(F.col("path")) | (F.col("a") != F.col("b")) | (F.col("known") < F.col("n"))).select("path").limit(5).collect()
    if bad:
        raise ValueError(f"no path within the folder, no content, or more than one: {[r.path for r in bad]}")
    waiting = f".waiting-{uuid.uuid4().hex}"

    def write(batches):
        from pyarrow import fs

        files, base = _opened(root)
        made: set[str] = set()
        for b in batches:
            sizes = {"written": 0, "skipped": 0}
            for name, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                target, data = f"{base}/{name}", body.as_buffer()
                there = files.get_file_info(target)
                if there.type == fs.FileType.File and there.size == data.size:
                    sizes["skipped"] += 1
                    continue
                folder = target.rsplit("/", 1)[0]
                for x in (folder, f"{base}/{waiting}"):
                    if x not in made:
                        files.create_dir(x, recursive=True)
                        made.add(x)
                part = f"{base}/{waiting}/{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(data)
                files.move(part, target)
                sizes["written"] += 1
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in sizes.items()})

    try:
        # A path's rows meet in one task, so no two tasks write one file.
        once = rows.repartition("path").dropDuplicates(["path"])
        done = once.mapInArrow(write, "written long, skipped long").agg(F.coalesce(F.sum("written"), F.lit(0)), F.coalesce(F.sum("skipped"), F.lit(0))).first()
        return {"written": done[0], "skipped": done[1]}
    finally:
        files, base = _opened(root)
        left = f"{base}/{waiting}"
        if files.get_file_info(left).type.name == "Directory":
            files.delete_dir(left)


def _opened(root: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root.rstrip("/")
    files, base = fs.FileSystem.from_uri("file://" + root.removeprefix("file:") if root.startswith("file:/") and not root.startswith("file://") else root)
    return files, base.rstrip("/")


def extracted(shards: DataFrame, root: str) -> dict[str, int]:
    """The files of image shards, rows of (path, bytes); other columns are not read."""
    return write_files(shards.select("path", "bytes"), root)


def localised(df: DataFrame, root: str, index: str = "index", image: str = "image", path: str = "image_path") -> DataFrame:
    """``df`` with its base64 images in files under ``root`` and their absolute paths in
    ``path`` instead of the column ``image``.

    An image is a text of LEAST_IMAGE characters or more and goes to its row's ``path``,
    or ``<index>.jpg`` where the table has no such column.  A shorter text is the index of
    the row whose image is meant; one that names no row with an image is an error, as is
    an image that is no base64.
    """
    own = F.length(image) >= LEAST_IMAGE
    key = F.col(index).cast("string")
    name = F.col(path).cast("string") if path in df.columns else F.concat(F.when(own, key).otherwise(F.col(image)), F.lit(".jpg"))
    holders = df.where(own).select(key.alias("_holder"), F.lit(True).alias("_held")).distinct()
    rows = df.withColumn("_name", name).join(holders, ~own & (F.col(image) == F.col("_holder")), "left")
    lost = rows.where(F.col(image).isNull() | (~own & F.col("_held").isNull())).select(index).limit(5).collect()
    if lost:
        raise ValueError(f"rows without an image: {[r[0] for r in lost]}")
    broken = F.raise_error(F.concat(F.lit("no base64 image in row "), key))
    write_files(df.where(own).select(name.alias("path"), F.coalesce(F.try_to_binary(F.col(image), F.lit("base64")), broken.cast("binary")).alias("bytes")), root)
    return rows.withColumn(path, F.concat(F.lit(root.rstrip("/") + "/"), F.col("_name"))).drop("_name", "_holder", "_held", image)
