"""What the operators of this subpackage share: tables, cut lineage, and vectorised words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size of a side that is broadcast; beyond it every caller has a shuffled way.
BROADCAST_BYTES = 32 << 20
#: Keys of many rows that meet() broadcasts, at most: a few megabytes together.
HOT_KEYS = 20_000
#: Text bytes that one vectorised step works on; a longer text makes a step of its own.
CHUNK_BYTES = 256 << 10
#: Bytes whose words are hashed at once, unless one word is longer: the arrays of a step stay in the cache.
HASH_BYTES = 128 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none: beside its warehouse, or a temporary folder if all runs on this machine."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given and spark.sparkContext.master.startswith("local["):
        given = f"{tempfile.gettempdir()}/checkpoints"
    return (given or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


def whole_key(df: DataFrame, key: str) -> Column:
    """The column of keys as longs; TypeError unless they are whole numbers."""
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} has to be of whole numbers, not {kind}")
    return F.col(f"`{key}`").cast("long")


def free(df: DataFrame, name: str) -> str:
    """name, or what it becomes with underscores at its end until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, row_bytes: int) -> bool:
    """Whether df (cheap to count) may be broadcast."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def meet(rows: DataFrame, side: DataFrame, key: str, row_bytes: int) -> DataFrame:
    """rows inner-joined by key with side, which has one row of about row_bytes for each key: by broadcast if side is small.

    Otherwise keys that more than 1/HOT_KEYS of the rows share, which are at most HOT_KEYS, meet their rows by
    broadcast, so that none of these is dealt by key; the others are joined as usual. Both tables are read several
    times then, so they should be tables that cut() wrote.
    """
    if small(side, row_bytes):
        return rows.join(F.broadcast(side), key)
    limit = max(1, rows.count() // HOT_KEYS)
    often = F.broadcast(cut(rows.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit).select(key), "hot-keys"))
    hot, rest = side.join(often, key, "left_semi"), side.join(often, key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(often, key, "left_anti").join(rest, key))


def cut(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, so that lost executors cost no recomputation.

    by: columns whose values have folders of their own, so that a filter on them reads no other files.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Remove what cut() wrote, when nothing will read it again."""
    if path := getattr(df, "_cut_path", None):
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges (first row, end row) of a batch, of at most limit bytes unless one row is longer."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end
        first = end


def give_back() -> None:
    """Return to the system what this process's allocators hold without using it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def freeing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, a function for mapInArrow, that gives memory back when its task ends: a Python worker stays for later tasks and stages, with all that its allocators hold."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; a null is an empty text."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()) if pa.types.is_string_view(column.type) else column, np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place of a hash of integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(2 * HASH_BYTES)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


#: Words are runs of bytes other than these.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SPACES)] = False


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in data, and where the words of each text begin: texts lie at offsets (from 0)."""
    n = len(data)
    inside = _IN_WORD[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begins[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begins[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (in order, none within another); equal words have equal hashes wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        at = int(starts[first])
        end = max(first + 1, int(np.searchsorted(ends, at + HASH_BYTES, side="right")))
        part = data[at : int(ends[end - 1])]
        up, down = _kept_powers() if len(part) <= 2 * HASH_BYTES else _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_byte_codes()[part] * up[: len(part)], out=sums[1:])
        a, b = starts[first:end] - at, ends[first:end] - at
        out[first:end] = mix((sums[b] - sums[a]) * down[a])
        first = end
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words; the last k-1 entries wrap no text and are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(BASE) + words[i : i + n]
    return mix(total)
