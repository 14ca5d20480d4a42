"""Shared plumbing: scratch tables, word hashing, range buckets, safe columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII blanks.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True

_ODD = 0x9E3779B97F4A7C15
_OTHER = 0xC2B2AE3D27D4EB4F


# --------------------------------------------------------------- scratch tables


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of our own is made only where none is set and the session is a
    local one, where the driver and its executors are one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="sparkloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return "file://" + folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.getParent())
    files.deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, so
    a lost executor costs its own tasks only."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a table made by ``written`` that is not read again."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if folder.split(":", 1)[-1].lstrip("/").startswith(shared_folder(spark).split(":", 1)[-1].lstrip("/")):
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


# ------------------------------------------------------------ memory of workers

#: Rows of an Arrow batch: texts are long, so far fewer than Spark's default.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch; one row at least.
BATCH_BYTES = 16 << 20


def short_batches(spark: SparkSession) -> SparkSession:
    """Bounds the rows and bytes that a Python worker and its executor hold at
    once, for the whole session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def tidy(fn):
    """``fn`` for mapInArrow; when a task ends, its worker, which Spark keeps for
    other tasks, hands free memory back to the system."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


# ------------------------------------------------------------------ expressions


def word_count(text: Column) -> Column:
    """Number of words; null counts as the empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------- range buckets


def quantile_bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` ascending split points of a long column.  The
    list is bounded by the number of buckets, not by the rows."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    got = df.select(F.percentile_approx(F.col(column), shares, max(20_000, 8 * buckets))).first()[0]
    return sorted(set(got or []))


# ------------------------------------------------------------- hashing of words


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[bool, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, other: bool) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64, kept for the next call."""
    if other not in _POWERS or len(_POWERS[other][0]) < n:
        base = _OTHER if other else _ODD
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(max(n, 1 << 16), b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _POWERS[other] = tuple(both)
    up, down = _POWERS[other]
    return up[:n], down[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column and n + 1 offsets; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.binary(), pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def spans_of(offsets: np.ndarray, limit: int = 1 << 21) -> list[tuple[int, int]]:
    """Consecutive document ranges of about ``limit`` bytes, one document at
    least: bounds the memory of the vectorised passes."""
    out, first = [], 0
    n = len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        out.append((first, last))
        first = last
    return out


def word_bounds(raw: np.ndarray, offsets: np.ndarray, blanks: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the words before each document
    (n + 1 entries).  Documents never share a word."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~blanks[raw]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < n]
    fresh[edge] |= inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = edge[edge > 0] - 1
    last[inner] |= inside[inner]
    starts = np.flatnonzero(fresh)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """64-bit hash of each word, the same wherever the word stands: prefix sums
    of byte * base^i modulo 2^64, shifted back to the word's start; ``other`` takes
    another base."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1, other)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and the shingles before each
    document (n + 1 entries); a document with fewer words has one shingle, its
    whole word sequence, and one without words has none."""
    counts = np.diff(first)
    n_shingles = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    before = np.zeros(len(first), np.int64)
    np.cumsum(n_shingles, out=before[1:])
    total = int(before[-1])
    if total == 0:
        return np.zeros(0, np.uint64), before
    doc = np.repeat(np.arange(len(counts)), n_shingles)
    at = np.arange(total) - before[doc] + first[doc]
    short = (counts < width)[doc]
    out = np.zeros(total, np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    stop = first[1:][doc]
    with np.errstate(over="ignore"):
        for k in range(width):
            term = padded[at + k]
            if short.any():
                term = np.where(short & (at + k >= stop), np.uint64(0), term)
            out = out * np.uint64(0xD6E8FEB86659FD93) + term
    return mixed(out), before


# ------------------------------------------------------- fixed-size id filters

#: Bits of an id bitmap: 131,072 words of 64 bits, about 2 MB whatever the input.
BITMAP_BITS = 1 << 23


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _places(columns: list[Column]) -> tuple[Column, Column]:
    """The word of the bitmap and the bit within it that stand for a key."""
    h = F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS).cast("long"))
    return F.shiftright(h, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))


def id_bitmap(ids: DataFrame, *columns: str) -> DataFrame:
    """A bitmap of the hashed ids as at most 131,072 rows (_slot, _bits)."""
    slot, bit = _places([F.col(c) for c in columns])
    return ids.select(slot.alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))


def with_possible(df: DataFrame, columns: Column | str | list[Column], bitmap: DataFrame, name: str) -> DataFrame:
    """``df`` with boolean ``name``: false only where the key is surely not in the
    bitmap.  The broadcast is bounded by BITMAP_BITS, so a filter on it spares a
    shuffle of wide rows; an exact join of the few that pass follows where the
    result must be exact.  ``df`` may have columns of any other name."""
    columns = columns if isinstance(columns, list) else [F.col(columns) if isinstance(columns, str) else columns]
    slot, bit = _places(columns)
    at, word, bits = (fresh_name(df, x) for x in ("_at", "_slot", "_bits"))
    bitmap = bitmap.select(F.col("_slot").alias(word), F.col("_bits").alias(bits))
    out = df.withColumn(at, slot).join(F.broadcast(bitmap), F.col(at) == F.col(word), "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False)).alias(name))


def row_keys(df: DataFrame) -> list[Column]:
    """What tells rows of documents apart by id and text: whether the id is null,
    the id, and 128 bits of the text's hash.  None is null."""
    text = df["text"].cast("string")
    return [df["doc_id"].isNull(), F.coalesce(df["doc_id"].cast("long"), F.lit(0).cast("long")), F.xxhash64(text), F.xxhash64(F.lit(1), text)]


#: Names of the ``row_keys`` in a table of them.
ROW_KEYS = ["z", "id", "x1", "x2"]


def without_rows(df: DataFrame, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``df`` (doc_id, text, ...) without the rows whose ``row_keys`` are in ``gone``
    (columns ROW_KEYS), null ids among them; of rows whose keys are in
    ``repeated`` one stays.  Only rows that the bitmap can't rule out are
    shuffled."""
    known = gone if repeated is None else gone.unionByName(repeated)
    maybe = fresh_name(df, "_maybe")
    marked = with_possible(df, row_keys(df), written(id_bitmap(known, *ROW_KEYS), "bitmap"), maybe)
    sure, rest = marked.where(~F.col(maybe)).drop(maybe), marked.where(F.col(maybe)).drop(maybe)
    names = [fresh_name(df, "_key_" + k) for k in ROW_KEYS]
    rest = rest.select("*", *[k.alias(n) for k, n in zip(row_keys(rest), names, strict=True)])
    rest = rest.join(gone.select(*[F.col(k).alias("_gone_" + n) for k, n in zip(ROW_KEYS, names, strict=True)]), [F.col(n) == F.col("_gone_" + n) for n in names], "left_anti")
    if repeated is not None:
        rest = rest.dropDuplicates(names)
    return sure.unionByName(rest.drop(*names))


# -------------------------------------------------------- connected components

#: Links that one task brings to an end, 16 bytes each; more of them first go
#: through star steps over all tasks.
LAST_LINKS = 2_000_000


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of two arrays of ends of links, and the smallest that
    each reaches."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return names, names[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _joined(batches, own: bool = False):
    """Links of a partition as (number, smallest number that links of the same
    LAST_LINKS ones reach), with ``own`` also for that number itself."""
    held, size = [], 0

    def flush():
        table = pa.Table.from_batches(held)
        names, root = _roots(np.asarray(table.column(0)), np.asarray(table.column(1)))
        go = np.ones(len(names), bool) if own else names != root
        return pa.RecordBatch.from_arrays([pa.array(names[go]), pa.array(root[go])], ["u", "v"])

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= LAST_LINKS:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def joined(fn):
    """``fn`` for mapInArrow, which gives links (u, v), with its links joined in the
    same Python worker: see ``_joined``."""
    return lambda batches: _joined(b.rename_columns(["u", "v"]) for b in fn(batches))


def components_of(edges: DataFrame, is_joined: bool = False) -> DataFrame:
    """``connected_components`` with Arrow tasks: links of a task are joined before
    they are written (unless ``joined`` did so where they arise), star steps follow
    if they are more than LAST_LINKS, else one task, bounded by that number, does
    the rest."""
    e = edges.where("u <> v").select("u", "v")
    e = written(e if is_joined else e.mapInArrow(tidy(_joined), "u long, v long"), "edges")
    if e.count() > LAST_LINKS:
        return connected_components(e)
    return e.coalesce(1).mapInArrow(tidy(lambda batches: _joined(batches, own=True)), "node long, component long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (long u, v): component is
    the smallest node that is reachable.  Alternating large-star and small-star
    steps, each written to the shared folder, until all that is left are stars;
    nothing but counts reaches the driver, and the steps are about the logarithm of
    the longest chain."""
    spark = edges.sparkSession
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def stars(x):
        """Whether no node has two links upwards, or one upwards and one downwards."""
        ends = x.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(x.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return ends.where("up > 1 or (up > 0 and down > 0)").isEmpty()

    while not stars(e):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v")))
        fresh = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        for x in (e, large):
            dropped(spark, x)
        e = fresh
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
