"""What the operators of this subpackage share: scratch tables and Arrow settings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes of one Arrow batch; long texts make 10,000-row batches too large.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset and all run in one process (tests) a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="changeloom-"))
        path = _OWN[0]
    return path.rstrip("/")


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, so a batch of long texts fits in a Python worker.

    Spark reads these settings when a plan runs, after the operator has returned, so they stay set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    """The Arrow type of a column, as Spark expects it back from Python."""
    return to_arrow_type(df.schema[name].dataType)


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with underscores behind until no column is called so (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Scratch:
    """Tables written to the shared folder to cut lineage; survives lost executors.

    ``keep`` writes a frame and rereads it; ``drop`` deletes it when no later
    step reads it.  Files of final results stay, as they are read lazily.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/changeloom-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(conf).delete(path, True)
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Let the driver forget unreachable shuffles, so their files go before the next step needs the disk."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def list_array(values: np.ndarray, lengths: Iterable[int], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def gathered(batches: Iterable[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterable[pa.RecordBatch]:
    """Batches put together up to about so many bytes, for code that has a cost by batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def byte_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one byte array and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: The first k bytes of eight, as a little-endian mask.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Words longer than so many bytes are hashed one by one.
_LONG = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[data]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, stop) of every word [^\\x20\\x09-\\x0D]+; words end with their text."""
    n = len(data)
    inside = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, stops


def span_hashes(low: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each range of bytes: eight bytes at a time, each step multiplied and xor-shifted.

    No step is a polynomial over the bytes, so no pattern of letters collides
    by its form.  Long ranges are hashed by xxh3.
    """
    size = stops - starts
    h = mix(size.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % 2**64))
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(low) + 1, "<u8", padded, strides=(1,))
    some = np.flatnonzero(size <= _LONG)
    at = 0
    while len(some):
        left = np.minimum(size[some] - at, 8)
        h[some] = mix((h[some] ^ (eight[starts[some] + at] & _FIRST[left])) * np.uint64(0x9FB21C651E98DF25) + np.uint64(at + 1))
        at += 8
        some = some[size[some] > at]
    for k in np.flatnonzero(size > _LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(low[starts[k] : stops[k]].tobytes(), seed + 1)
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, document, start, stop) of every word, A-Z lower-cased; another seed gives an independent hash."""
    if not len(data):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    doc, starts, stops = word_places(data, offsets)
    return span_hashes(_LOWER[data], starts, stops, seed), doc, starts, stops
