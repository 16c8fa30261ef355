"""Helpers shared by the training-data operators: vectorised scanning of Arrow text, and durable tables.

Text is never turned into Python objects row by row here. An Arrow string column is one byte buffer with offsets, so
words, lines and hashes of thousands of documents are found with a few NumPy passes over that buffer.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..functions.arrow import BATCH_BYTES, bound_batches, release  # noqa: F401

#: Bytes of text that one vectorised pass works on; a longer document is a pass of its own.
SLICE_BYTES = 512 << 10
#: Spark's setting that has shuffle files deleted at the end of an execution.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_rng = np.random.default_rng(20240229)
_SEED = int(_rng.integers(1, 2**63))
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: How intermediate tables are written: no mark of success, as nothing looks for it, and on a local file system no files of
#: checksums: without Hadoop's native library a process is spawned there for the mode of each file.
WRITING = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Bytes of a span up to which spans are hashed in step.
LONG_SPAN = 64

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32

#: Word bytes of `[^\\x20\\x09-\\x0D]+` and of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` (after lower-casing).
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True


def work_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a temporary folder serves a local session; a
    cluster without the setting is refused, because a folder of one machine is invisible to the others.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lodestack-")
    return f"{root.rstrip('/')}/lodestack-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there and executors may be lost. Its
    shuffle files are deleted at once, not when the driver happens to collect its garbage."""
    session = df.sparkSession
    path, had = work_dir(session), session.conf.get(SHUFFLE_CLEANUP)
    session.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**WRITING).parquet(path)
    finally:
        session.conf.set(SHUFFLE_CLEANUP, had)
    out = session.read.schema(df.schema).parquet(path)
    out._lodestack_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that nothing reads any more: whatever was made of them has been stored itself."""
    for table in tables:
        session = table.sparkSession
        path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(table._lodestack_path)
        path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text each; one row may exceed it."""
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield begin, min(end, n)
        begin = min(end, n)


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return (_ASCII_LOWER[data] if lower else data), offsets - offsets[0]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, cut at row borders, and the n+1 run numbers at which rows begin."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | border[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: equal spans get equal values wherever they stand. Eight bytes at a time are stirred
    in; spans of more than ``LONG_SPAN`` bytes are hashed one by one."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(_BASE % (1 << 64)))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    todo, left, at = None, size, starts
    for _ in range(LONG_SPAN // 8):
        block = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
        if todo is None:
            out = mix(out ^ block)
        else:
            out[todo] = mix(out[todo] ^ block)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        todo, left, at = more if todo is None else todo[more], left[more] - 8, at[more] + 8
    raw = data.tobytes()
    for r in todo.tolist():
        out[r] = xxhash.xxh3_64_intdigest(raw[starts[r] : ends[r]], _SEED)
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes (n - size + 1 of them)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= np.uint64(_BASE % (1 << 64))
        out += words[j : j + n]
    return mix(out)


def pack(values: np.ndarray, cut: np.ndarray, width: int, planes: bool = False) -> pa.Array:
    """Little-endian integers of ``width`` bytes, as one binary for each stretch between the places ``cut``. In ``planes``,
    a binary holds the first bytes of all its integers, then the second ones, and so on, which compresses better."""
    data = np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    if planes:
        out = np.empty(len(values) * width, np.uint8)
        size = np.diff(cut)
        at = np.arange(len(values)) + np.repeat(cut[:-1] * (width - 1), size)
        step = np.repeat(size, size)
        for j in range(width):
            out[at + j * step] = data[:, j]
    else:
        out = np.ascontiguousarray(data).reshape(-1)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * width).astype(np.int32)), pa.py_buffer(out)])


def unpack(column: pa.Array, width: int, planes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """What ``pack`` was given: unsigned integers, and the places at which those of each row begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    cut = (offsets - offsets[0]) // width
    out = np.zeros((int(cut[-1]), 8), np.uint8)
    if planes:
        size = np.diff(cut)
        at = np.arange(len(out)) + np.repeat(cut[:-1] * (width - 1), size)
        step = np.repeat(size, size)
        for j in range(width):
            out[:, j] = data[at + j * step]
    else:
        out[:, :width] = data.reshape(-1, width)
    return out.reshape(-1).view("<u8"), cut


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting beats the hashing of ``np.unique`` on integers."""
    x = np.sort(x)
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the n+1 item numbers at which rows begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values by row, from the n+1 item numbers at which rows begin."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def map_text(df: DataFrame, keep: list[str], text: str, schema: str, make: Callable[[], Callable[[pa.Array], dict]], most: int = SLICE_BYTES) -> DataFrame:
    """``keep`` columns and what ``make()`` gives for slices of the text column, batch by batch in Arrow.

    ``make`` runs once per task and returns the function that maps a string array to new columns of the same length.
    """
    names = [x.split()[0] for x in schema.split(", ")]  # ", " stands between columns only, not inside their types
    out = df.select(*[df[c].alias(c) for c in keep], df[text].cast("string").alias("__text"))
    types = ", ".join([f"`{c}` {out.schema[c].dataType.simpleString()}" for c in keep] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            column = batch.column(len(keep))
            for begin, end in row_slices(column, most):
                new = work(column.slice(begin, end - begin))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(begin, end - begin) for i in range(len(keep))] + [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in (new[c] for c in names)], names=[*keep, *names])
            del batch, column, new
            release()

    bound_batches(df.sparkSession)
    return out.mapInArrow(run, types)
