"""Text files as documents."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.chunking import metadata
from ..plans.filters import path_glob

#: Bytes of a file that are hashed at a time.
BLOCK = 1 << 20
FILES = "path string, modificationTime timestamp, length long, content binary"


def chosen(path: Column, include: str | None = None, exclude: Sequence[str] = ()) -> Column:
    """Whether a path is taken: no exclude glob matches it, and the include glob, if any, does."""
    out = F.lit(True)
    for pattern in exclude:
        out = out & ~path.rlike(path_glob(pattern))
    return out & path.rlike(path_glob(include)) if include else out


def scan(spark: SparkSession, paths: Sequence[str], include: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """(path, mtime, size, content) of files, and of all files below folders; without paths, of the working folder.

    Unreadable files are skipped. ``path`` keeps the form in which its root was given.
    """
    files = _listed(spark, paths).where(chosen(F.col("path"), include, exclude))
    return files.select("path", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("mtime"), F.col("length").alias("size"), "content")


def _listed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, uri, modificationTime, length, content) of files; what isn't asked for isn't read."""
    found = []
    for root in paths or ["."]:
        base = root.rstrip("/") or "/"
        remote = "://" in base
        full = base if remote else os.path.abspath(base)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(full)
        plain = F.col("path") if remote else F.regexp_replace("path", r"\A[a-z0-9]+:/+(?=[^/])", "/")
        shown = F.concat(F.lit(base), F.substring(plain, len(full) + 1, F.length(plain)))
        found.append(files.select(shown.alias("path"), F.col("path").alias("uri"), "modificationTime", "length", "content"))
    return reduce(DataFrame.unionByName, found)


def digests(spark: SparkSession, paths: Sequence[str], include: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """(path, size, hash) of the files that ``scan`` finds. A file is hashed in blocks: it may be larger than what fits in memory,
    or in a row. Its bytes go through one task, as SHA-256 takes them in order."""
    files = _listed(spark, paths).where(chosen(F.col("path"), include, exclude))
    return files.select("path", "uri", F.col("length").alias("size")).mapInArrow(_digest, "path string, size long, hash string")


def _open(uri: str):
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    system, path = pa.fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, uri, size in zip(*(c.to_pylist() for c in batch.columns)):
            done = hashlib.sha256()
            try:
                with _open(uri) as file:
                    while block := file.read(BLOCK):
                        done.update(block)
            except OSError:  # unreadable, as in a scan
                continue
            out.append((path, size, done.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "size", "hash"])


def unchanged(files: DataFrame, doc: DataFrame) -> DataFrame:
    """Files without those that the store holds, alive, with the same path and time."""
    return files.join(doc.where(~F.col("deleted")).select("path", "mtime"), ["path", "mtime"], "left_anti")


def documents(files: DataFrame, tag: str | None = None, source: str | None = None, parser: str | None = None, meta: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows of the doc table with ``text`` and ``parser``, paths of files that aren't text); without ``meta``, metadata in
    the texts isn't looked for."""
    found = metadata(F.col("text")) if meta else F.lit(None).cast("string")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.col("content").cast("string")
    rows = files.where(good).withColumn("text", text).withColumn("hash", X.content_hash(text))
    docs = rows.select(
        X.doc_id(F.col("path"), F.col("hash")).alias("id"), "path", "mtime", "size", "hash",
        F.lit(tag).cast("string").alias("tag"), F.lit(source).cast("string").alias("source"), found.alias("meta"), F.lit(False).alias("deleted"),
        "text", X.parser_of(F.col("path"), parser).alias("parser"),
    )
    return docs, files.where(~good).select("path")
