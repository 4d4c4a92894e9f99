"""What the operators of this subpackage share: written tables that cut lineage, row keys, UTF-8 buffers, word hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose id is null sort after every other row.
LAST_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs only a re-read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows in an Arrow batch: whole texts are long, and two batches of each Python worker are in memory at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows where they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Keys that join_counted may broadcast at most: a few MB.
HOT_KEYS = 50_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows, a written table of total rows, with counted: a row for each key with n, the number of rows that have it.

    Keys of more than total / HOT_KEYS rows, of which there are fewer than HOT_KEYS, are broadcast, so no task gathers such a
    key's rows; the others are shuffled.
    """
    most = max(1000, total // HOT_KEYS)
    hot, cold = counted.filter(F.col("n") > most), counted.filter(F.col("n") <= most)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rk, ord, doc_id, body): rows that agree in id and text share rk; ord orders ids with null last; body is UTF-8, null as empty."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    ident = F.col(id_col).cast("long")
    return docs.select(
        F.xxhash64(ident, body).alias("rk"),
        F.coalesce(ident, F.lit(LAST_ID)).alias("ord"),
        ident.alias("doc_id"),
        body.alias("body"),
    )


def give_back() -> None:
    """Return the memory that this worker no longer uses to the system, at the end of a task: idle workers keep theirs for a minute."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary Arrow column without nulls as one byte array and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of whole documents of about size bytes; a longer document makes a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _RNG.integers(1, 1 << 64, 256, np.uint64) | np.uint64(1)
MULTIPLIERS = _RNG.integers(1, 1 << 64, 64, np.uint64) | np.uint64(1)
_POWERS = np.cumprod(np.full(64, MULTIPLIERS[0]))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of concatenated documents: starts, ends, and the n + 1 word offsets of the documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    full = offsets[1:] > offsets[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][full]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:][full] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    global _POWERS
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    longest = int(lengths.max())
    if longest > len(_POWERS):
        _POWERS = np.cumprod(np.full(longest * 2, MULTIPLIERS[0]))
    begin = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=begin[1:])
    at = np.arange(int(lengths.sum()))
    within = at - np.repeat(begin, lengths)
    at += np.repeat(starts - begin, lengths)
    return mix(np.add.reduceat(BYTE_VALUES[data[at]] * _POWERS[within], begin) + lengths.astype(np.uint64))


def window_hashes(hashes: np.ndarray, doc_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one document, and the index of each window's first word."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[: total - n + 1].copy()
    for k in range(1, n):
        out *= MULTIPLIERS[1]
        out += hashes[k : total - n + 1 + k]
    ok = np.ones(total + 1, bool)
    counts = np.diff(doc_offsets)
    for k in range(n - 1):  # the last n - 1 words of a document start no window
        ok[(doc_offsets[1:] - 1 - k)[counts > k]] = False
    at = np.flatnonzero(ok[: total - n + 1])
    return mix(out[at]), at


def squeeze(values: np.ndarray) -> tuple[int, bytes]:
    """Unsigned integers as little-endian numbers of as few bytes as the largest needs."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return width, values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unsqueeze(width: int, raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :width] = part
    return out.view(np.uint64).ravel()


def packed(docs: DataFrame) -> DataFrame:
    """docs (rk, doc_id, body) with each body compressed, so that a shuffle of whole texts moves less."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            bodies = pa.array([tool.compress(x.as_py()) for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bodies], ["rk", "doc_id", "body"])

    return docs.select("rk", "doc_id", "body").mapInArrow(pack, "rk long, doc_id long, body binary")


def unpacked(column: pa.Array) -> Iterator[bytes]:
    tool = zstandard.ZstdDecompressor()
    for x in column:
        yield tool.decompress(x.as_py())
