"""What several operators of this subpackage share: the folder for tables between jobs, Arrow text access and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- shared folder


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, the context's own, or a new one on a single machine (tests).
    A cluster without either is an error, as its executors share no temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skeinrank-"))
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_root(spark)}/skeinrank/{name}-{uuid.uuid4().hex}"
    where, fs = _hadoop_path(spark, path)
    fs.mkdirs(where.getParent())
    fs.deleteOnExit(where)
    return path


def _hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    where, fs = _hadoop_path(spark, path)
    fs.delete(where, True)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives the loss of executors.

    The files go when the application ends, or earlier by drop_path().
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df: for a file scan, the size of its files. Where it knows none (rows that came
    from the driver), the bytes of all text are summed."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 60:
        return known
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    return df.agg(F.sum(sum((F.coalesce(t, F.lit(0)).cast("long") for t in texts), F.lit(0)))).first()[0] or 0


# --------------------------------------------------------------------------- names and hot keys


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, whatever the case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key with more rows than PART_ROWS, and than a share of 1 / HOT_KEYS of all, is hot: so at most HOT_KEYS keys are.
PART_ROWS, HOT_KEYS = 256, 10_000


def deal(rows: DataFrame, once: DataFrame, keys: list[str], by: str, n: str = "n") -> tuple[DataFrame, DataFrame]:
    """Both tables with a column _part, so that a join on keys and _part is that on keys, and no part of a hot key has much
    more rows than that share. once has each key once, and in n how many rows have it; rows are dealt by the column `by`,
    once is copied to each part. The list of hot keys has at most HOT_KEYS rows, so it is broadcast; where no key is hot
    there is one part."""
    total, most = once.agg(F.sum(n), F.max(n)).first()
    share = max(PART_ROWS, -(-(total or 0) // HOT_KEYS))
    if (most or 0) <= share:
        return rows.withColumn("_part", F.lit(0)), once.withColumn("_part", F.lit(0))
    hot = once.where(F.col(n) > share).select(*keys, F.ceil(F.col(n) / share).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copies = once.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt, copies


def join_dealt(rows: DataFrame, once: DataFrame, keys: list[str], by: str, n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with once on keys, hot keys in parts (see deal()). once keeps its n."""
    dealt, copies = deal(rows, once, keys, by, n)
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


# --------------------------------------------------------------------------- Arrow text


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer text has a range of its own."""
    at, rows = 0, len(offs) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, min(end, rows)
        at = min(end, rows)


# --------------------------------------------------------------------------- words and hashes

#: Bytes of words: all but space and the controls from tab to carriage return.
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BYTE = constants(256, 1)
_PLACE = constants(256, 2)


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in buf, and for each row the number of its first word (one more at the end)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = SOLID[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends[:-1] &= ~solid[1:] | edge[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a multilinear sum over its bytes, then mixed."""
    global _PLACE
    if not len(s):
        return np.zeros(0, np.uint64)
    length = e - s
    if (longest := int(length.max())) > len(_PLACE):
        _PLACE = constants(longest, 2)
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    value = _BYTE[buf[place + np.repeat(s, length)]] * _PLACE[place]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64))


def run_hashes(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of each run of k words; len(words) - k + 1 of them, none if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    by = constants(k, seed)
    total = words[:n] * by[0]
    for j in range(1, k):
        total += words[j : j + n] * by[j]
    return mix(total)
