"""What the corpus operators share: the shared work folder, stable columns, word hashing."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A folder all executors share: the cluster's spark.checkpoint.dir. Where that is unset, a local one on a local
    master, else one in the warehouse, which a cluster shares as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lodestone"
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, so later stages survive
    lost executors and see one fixed evaluation of df. discard() deletes it."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what materialise wrote for tables that nothing reads any more: those made of them are written, too."""
    for table in tables:
        path = getattr(table, "_written", None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Bits for each key of a bitmap, and the most rows of 4 KB that one has: a broadcast of 64 MB at most.
_BITS_A_KEY = 16
_MOST_BITMAPS = 16_384


def marked(df: DataFrame, keys: list[str], wanted: DataFrame, n: int, name: str = "_maybe") -> DataFrame:
    """df with a boolean: false only where its keys are none of wanted (n rows). A bitmap of hashes of bounded size is
    broadcast, whatever n is: the fuller it is, the more rows are marked that are not wanted."""
    bitmaps = min(_MOST_BITMAPS, max(1, -(-n * _BITS_A_KEY // 32_768)))
    place = F.pmod(F.xxhash64(*keys), F.lit(bitmaps * 32_768))
    bits = wanted.select(place.alias("p")).groupBy(F.floor(F.col("p") / 32_768).cast("int").alias("_bitmap")).agg(F.bitmap_construct_agg((F.col("p") % 32_768)).alias("_bits"))
    at = (place % 32_768).cast("int")
    byte = F.conv(F.hex(F.expr("substring(_bits, _byte, 1)")), 16, 10).cast("int")
    joined = df.withColumns({"_bitmap": F.floor(place / 32_768).cast("int"), "_byte": F.floor(at / 8).cast("int") + 1, "_bit": at % 8}).join(F.broadcast(bits), "_bitmap", "left")
    return joined.withColumn(name, F.coalesce(F.getbit(byte, F.col("_bit")) == 1, F.lit(False))).drop("_bitmap", "_bits", "_byte", "_bit")


def among(df: DataFrame, keys: list[str], wanted: DataFrame, n: int) -> DataFrame:
    """Inner join of df with wanted (n rows, different keys) on keys; only rows that may be wanted are shuffled."""
    return marked(df, keys, wanted.select(*keys), n).where("_maybe").drop("_maybe").join(wanted.hint("merge"), keys)


def without(df: DataFrame, keys: list[str], dropped: DataFrame, n: int) -> DataFrame:
    """The rows of df (read twice) whose keys are none of dropped (n rows); only rows that may be dropped are shuffled."""
    if not n:
        return df
    told = marked(df, keys, dropped.select(*keys), n)
    sure, maybe = told.where(~F.col("_maybe")).drop("_maybe"), told.where("_maybe").drop("_maybe")
    return sure.select(*df.columns).unionByName(maybe.join(dropped.select(*keys).hint("merge"), keys, "left_anti").select(*df.columns))


def buckets(spark: SparkSession, per_partition: int = 1) -> int:
    """How many hash buckets to deal to: follows the number of shuffle partitions, which follows the input."""
    return max(16, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Give memory that Arrow and the C library hold in reserve back to the system: Python workers stay for later
    stages, and what they keep is missing there."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def thrifty(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back after each partition."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return run


def thrifty_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function for applyInArrow that gives memory back after each group."""

    @functools.wraps(f)
    def run(part: pa.Table) -> pa.Table:
        out = f(part)
        release()
        return out

    return run


def slices(batch: pa.RecordBatch, at: int, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about size bytes each in its text column."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(batch):
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + size)))
        yield batch.slice(low, high - low)
        low = high


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all runs of width consecutive values: a polynomial modulo 2**64, scrambled. base: odd."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    powers = _powers(base, width)
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        out += hashes[k : k + len(out)] * powers[k]
    return mixed(out)


def numbered_columns(df: DataFrame) -> DataFrame:
    """df with c0, c1 and so on for the names of its columns, so that none of them clashes with names used here."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def named_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The first columns of numbered_columns, by their own names again."""
    return df.select(*[f"c{k}" for k in range(len(names))]).toDF(*names)


def with_row(df: DataFrame, file: str = "_file", row: str = "_row") -> DataFrame:
    """df with the place of each row, two longs that stay the same however often it is read: hash of the file and
    number in it. A df that is not a scan of Parquet files is written as a table first."""
    place = [F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)]
    try:
        return df.select("*", *place)
    except AnalysisException:
        return materialise(df).select("*", *place)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, head): the smallest node of the component of each node of edges, by alternating large and small stars.

    The rounds grow as the logarithm of the longest path; each is two aggregations and joins over the edges that are
    left, written to the shared folder. They end when every node is the head of its neighbours or has its head alone."""
    pairs = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        # Large star: the larger neighbours of each node move to the smallest of its neighbours and itself.
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written down, so that both sides of a join are exchanges that a hot node's rows can be split in.
        first = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("down"), F.count_if(F.col("v") > F.col("u")).alias("up")).select("u", F.least("u", "m").alias("m"), "down", "up"))
        if first.where("down > 1 OR down = 1 AND up > 0").isEmpty():
            discard(first)
            break
        large = materialise(both.where("v > u").join(first.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")))  # repeats go with the next distinct
        # Small star: the smaller neighbours of each node, and it, move to the smallest of them.
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        old, pairs = pairs, materialise(small)
        discard(old, first, least, large)
    heads = pairs.select(F.col("u").alias("node"), F.col("v").alias("head"))
    return heads.union(heads.select(F.col("head").alias("node"), "head").distinct())
