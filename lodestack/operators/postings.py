"""An inverted index of chunks: built once when text comes in, read by term when it is searched.

Chunks get numbers. A row of the postings is a term with its entries in some thousands of chunks: the number of each, its
length and the places of the term in it, as numbers of one to five bytes. Rows are in order of terms and cut into even ranges, so a term that a third of all
chunks hold is spread over many files, and a search for some words reads the pages of these words only, by the statistics of
the files. The text of chunks is read for the few rows that are returned.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fulltext as FT
from ..functions.arrow import bound_batches, release
from ..schema import CHUNK, DENSE
from ..sources.folder import Folder

POSTINGS = "head string, term string, start long, n int, entries binary"
#: Terms that are inverted at a time, and entries that are decoded, about.
INVERTED, DECODED = 1 << 20, 200_000
#: Bytes of postings, as Parquet, that are sorted by one task.
PART_BYTES = 16 << 20
#: Rows that are looked up by their numbers as literals, so that files without them are skipped.
LOOKUP_ROWS = 1000


@dataclass(frozen=True)
class Index:
    """Postings, the numbered chunks (``n`` and the columns of the chunk table), and what BM25 needs of all chunks."""

    postings: DataFrame
    rows: DataFrame
    count: int
    average: float
    gone: DataFrame | None = None  # numbers that postings have and ``rows`` no longer has


def _head(term: str) -> str:
    return term[0] if term[:1].isascii() and term[:1].isalnum() else "_"


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, terms) to one row for each term of a batch of chunks, with all its entries in them."""
    for batch in batches:
        number = batch.column(0).to_numpy()
        # numbers of one row are near each other, as those of one file are
        total = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy().astype(np.int64)) // INVERTED
        cuts = np.unique([0, *(np.flatnonzero((np.abs(np.diff(number)) >= 1 << 30) | (np.diff(total) > 0)) + 1), batch.num_rows]).tolist()
        for begin, end in zip(cuts, cuts[1:]):
            yield _inverted(number[begin:end], batch.column(1).slice(begin, end - begin))
        del batch, number
        release()


def _inverted(number: np.ndarray, lists: pa.Array) -> pa.RecordBatch:
    words = lists.flatten().dictionary_encode()
    size = lists.value_lengths().fill_null(0).to_numpy().astype(np.int32)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    place = (np.arange(len(row)) - np.repeat(np.cumsum(size, dtype=np.int64) - size, size)).astype(np.int32)
    code = words.indices.to_numpy()
    order = np.argsort(code, kind="stable")  # chunks and places are in order already
    row, code, place = row[order], code[order], place[order]
    new = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    cut = np.flatnonzero(np.concatenate(([True], new, [True]))) if len(row) else np.zeros(1, np.int64)
    own, row = code[cut[:-1]], row[cut[:-1]]
    term_cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True]))) if len(own) else np.zeros(1, np.int64)
    start = number[row[term_cut[:-1]]]
    terms = words.dictionary.take(pa.array(own[term_cut[:-1]])).cast(pa.string())
    heads = pa.array([_head(t) for t in terms.to_pylist()], pa.string())
    # for each term the steps of its chunks' numbers, their lengths, the times it is in each, and the steps of its places
    n, at = np.diff(term_cut), cut[term_cut]
    of, nth = np.repeat(np.arange(len(n)), n), np.arange(len(row)) - np.repeat(term_cut[:-1], n)
    base = 3 * term_cut[:-1] + at[:-1]
    values = np.zeros(3 * len(row) + len(place), np.int32)
    values[base[of] + nth] = np.where(nth > 0, np.diff(number[row], prepend=0), 0)
    values[base[of] + n[of] + nth] = size[row]
    values[base[of] + 2 * n[of] + nth] = np.diff(cut)
    step = np.diff(place, prepend=0)
    step[cut[:-1]] = place[cut[:-1]]
    values[np.arange(len(place)) + np.repeat(3 * term_cut[1:], np.diff(at))] = step
    data, begin = packed(values)
    blobs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(begin[np.append(base, len(values))].astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([heads, terms, pa.array(start, pa.int64()), pa.array(n, pa.int32()), blobs], names=[x.split()[0] for x in POSTINGS.split(", ")])


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**35 as bytes of seven bits each, the high bit set where one goes on; the places at which they begin, with
    an end."""
    size = np.ones(len(values), np.int8)
    for k in range(1, 5):
        size += values >= 1 << 7 * k
    begin = np.append(0, np.cumsum(size, dtype=np.int64))
    out = np.zeros(begin[-1], np.uint8)
    for k in range(5):
        more = np.flatnonzero(size > k)
        out[begin[more] + k] = ((values[more] >> 7 * k) & 127) | np.where(size[more] > k + 1, 128, 0)
    return out, begin


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` was given, and the places at which the numbers begin."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    begin = np.append(0, last[:-1] + 1)
    shift = 7 * (np.arange(len(data)) - np.repeat(begin, last - begin + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, begin), begin


def _decoded(term: pa.Array, start: np.ndarray, n: np.ndarray, blobs: pa.Array) -> pa.RecordBatch:
    offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    values, begin = unpacked(np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    base = np.searchsorted(begin, offsets - offsets[0])
    first = np.cumsum(n) - n
    of, nth = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(first, n)
    whole = np.cumsum(values[base[of] + nth])
    number = start[of] + whole - whole[first][of]
    times = values[base[of] + 2 * n[of] + nth]
    cut = np.append(0, np.cumsum(times))
    each = np.diff(cut[np.append(first, len(of))])
    step = values[np.arange(cut[-1]) + np.repeat(base[:-1] + 3 * n - cut[first], each)]
    place = np.cumsum(step)
    place -= np.repeat(place[cut[:-1]] - step[cut[:-1]], times)
    places = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(place.astype(np.int32)))
    return pa.RecordBatch.from_arrays([term.take(pa.array(of)), pa.array(number), pa.array(values[base[of] + n[of] + nth].astype(np.int32)), places], names=["term", "n", "length", "places"])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, start, n, entries) to a row for each entry, some at a time."""
    for batch in batches:
        n = batch.column(2).to_numpy().astype(np.int64)
        cut = np.unique([0, *np.searchsorted(np.cumsum(n), np.arange(DECODED, n.sum(), DECODED), "right"), len(n)])
        for begin, end in zip(cut.tolist(), cut[1:].tolist()):
            some = batch.slice(begin, end - begin)
            yield _decoded(some.column(0), some.column(1).to_numpy(), n[begin:end], some.column(3))
        del batch
        release()


ROWS = T.StructType([*CHUNK.fields, T.StructField("n", T.LongType()), T.StructField("length", T.IntegerType())])


def write(chunk: DataFrame, path: str, base: int = 0) -> tuple[int, int]:
    """The index of a chunk table, as the folders ``rows`` and ``postings`` below ``path``; its chunks and their terms.

    Numbers count on from ``base``, of 2**50 each; they follow the files that rows are written to, so a look-up of few numbers
    skips most files."""
    spark = chunk.sparkSession
    number = F.monotonically_increasing_id() + F.lit(base << 50)
    chunk.select(*CHUNK.fieldNames(), number.alias("n"), F.size("terms").alias("length")).write.options(**DENSE).parquet(f"{path}/rows")
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    # written down, as the ranges are drawn from a look at all rows
    bound_batches(spark)
    rows.select("n", "terms").mapInArrow(_invert, POSTINGS).write.options(**DENSE).parquet(f"{path}/unsorted")
    inverted, folder = spark.read.schema(POSTINGS).parquet(f"{path}/unsorted"), Folder(spark, path)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-folder.bytes("unsorted") // PART_BYTES))
    # rows of one term are told apart by their first entry, so a term of very many chunks is cut too
    by = ("head", "term", "start")
    inverted.repartitionByRange(parts, *by).sortWithinPartitions(*by).write.partitionBy("head").options(**DENSE).parquet(f"{path}/postings")
    folder.delete("unsorted")
    found = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return found[0], found[1]


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{path}/rows")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS.replace("head string, ", "") + ", head string").parquet(f"{path}/postings")


def read(spark: SparkSession, path: str, count: int, terms: int) -> Index:
    """The index below ``path``, with what ``write`` returned."""
    return Index(read_postings(spark, path), read_rows(spark, path), count, terms / count if count else 0.0)


class Places(FT.Terms):
    """Search terms of a row as the places of those words that a query asks for."""

    def __init__(self, places: dict[tuple[str, bool], Column], length: Column) -> None:
        self.places, self._length = places, length

    def length(self) -> Column:
        return self._length

    def starts(self, p: FT.Phrase) -> Column:
        if not p.terms:
            return F.expr("cast(array() as array<int>)")
        last = len(p.terms) - 1
        own = [self.places[(t, p.prefix and k == last)] for k, t in enumerate(p.terms)]
        hits = own[0]
        if last:
            hits = F.filter(hits, lambda i: functools.reduce(lambda a, b: a & b, [F.array_contains(x, i + k) for k, x in enumerate(own) if k]))
        return F.filter(hits, lambda i: i == 0) if p.first else hits

    def count(self, p: FT.Phrase) -> Column:
        return F.size(self.starts(p))

    def has(self, p: FT.Phrase) -> Column:
        return self.count(p) > 0

    def once(self, body) -> Column:
        return body(self)


def _asked(node: FT.Node) -> list[tuple[str, bool]]:
    """The words of a query, each with whether it is a prefix."""
    found = [(t, p.prefix and k == len(p.terms) - 1) for p in FT.phrases(node) for k, t in enumerate(p.terms)]
    return list(dict.fromkeys(found))


def _entries(rows: DataFrame) -> DataFrame:
    """(term, n, length, places) of all entries of rows of postings."""
    return rows.select("term", "start", "n", "entries").mapInArrow(_decode, "term string, n long, length int, places array<int>")


def hits(index: Index, node: FT.Node) -> tuple[DataFrame, Places]:
    """One row (n, length, places of the words asked for) for each chunk that holds any of a query's words."""
    asked = _asked(node)
    if not asked:
        none = _entries(index.postings.limit(0))
        return none.select("n", "length"), Places({}, F.col("length"))
    same = lambda t, prefix: F.col("term").startswith(t) if prefix else F.col("term") == t
    rows = index.postings.where(F.col("head").isin(sorted({_head(t) for t, _ in asked}))).where(functools.reduce(lambda a, b: a | b, [same(t, prefix) for t, prefix in asked]))
    rows = _entries(rows)
    if index.gone is not None:
        rows = rows.join(index.gone, "n", "left_anti")
    if len(asked) == 1 and not asked[0][1]:  # a chunk has one row of a word
        return rows.select("n", "length", F.col("places").alias("w0")), Places({asked[0]: F.col("w0")}, F.col("length"))
    none = F.expr("cast(array() as array<int>)")
    own = []
    for k, (t, prefix) in enumerate(asked):
        found = F.when(same(t, prefix), F.col("places"))
        # words of one prefix stand at different places
        own.append((F.array_sort(F.flatten(F.collect_list(found))) if prefix else F.coalesce(F.max(found), none)).alias(f"w{k}"))
    rows = rows.groupBy("n").agg(F.max("length").alias("length"), *own)
    return rows, Places({a: F.col(f"w{k}") for k, a in enumerate(asked)}, F.col("length"))


def search(index: Index, node: FT.Node) -> DataFrame:
    """(n, bm25) of all chunks that match. One short job counts the chunks that each phrase is in."""
    rows, places = hits(index, node)
    having = [F.sum(places.has(p).cast("long")).alias(f"n{i}") for i, p in enumerate(FT.phrases(node))]
    found = rows.agg(*having).first()
    stats = FT.Stats(index.count, index.average, tuple(found[k] or 0 for k in range(len(having))))
    return rows.where(FT.matches(node, places)).select("n", FT.bm25(node, places, stats).alias("bm25"))


def lookup(index: Index, numbers: list[int], columns: list[str]) -> DataFrame:
    """Columns of chunks by number; files that hold none of them are skipped."""
    return index.rows.where(F.col("n").isin(numbers)).select("n", *columns)
