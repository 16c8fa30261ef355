"""A store: the doc and chunk tables in segments of Parquet files, and a manifest that names the current ones.

A change writes one segment: the rows that are new, their postings, and marks on older rows that are deleted or replaced. Rows
are never written again but for folding: a store of many segments, and one that is compacted, becomes a single segment. The
manifest is replaced in one rename, so readers see the old state or the new one without a lock, and a lost job leaves nothing
half done; the files of the state before stay until the next change but one. One writer at a time holds the lock file.
"""

from __future__ import annotations

import functools
import json
import os
import resource
import socket
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import Embedder
from ..operators import postings as PT
from ..operators.chunking import chunk_documents
from ..schema import CHUNK, DENSE, DOC, SCHEMA_VERSION, Config, Corpus, StoreError
from . import files as FS
from .folder import Folder

#: Segments that are folded into one, and seconds after which the lock of a writer on another machine is taken for lost.
FOLD, LEASE = 16, 3600
MARKS = "id string, gone boolean"


@dataclass(frozen=True)
class Added:
    """What an ingestion did."""

    documents: int
    chunks: int
    skipped: tuple[str, ...]


class Store:
    def __init__(self, spark: SparkSession, path: str | Path, embedder: Embedder) -> None:
        self.spark, self.path, self.embedder, self.folder = spark, path, embedder, Folder(spark, path)
        self._owner: str | None = None

    # manifest and lock

    @classmethod
    def create(cls, spark: SparkSession, path: str | Path, embedder: Embedder) -> Store:
        """A new, empty store; it is an error if there is one."""
        self = cls(spark, path, embedder)
        if self.folder.exists("manifest.json"):
            raise StoreError(f"there is a store at {path}")
        self.folder.make()
        with self.lock():
            self._commit(0, [self._segment(0, spark.createDataFrame([], DOC), spark.createDataFrame([], CHUNK))], [])
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str | Path, embedder: Embedder) -> Store:
        """An existing store, of this version and of the embedder's name and dimension."""
        self = cls(spark, path, embedder)
        found = self.manifest()
        if found.get("schema_version") != SCHEMA_VERSION:
            raise StoreError(f"the store has version {found.get('schema_version')}, not {SCHEMA_VERSION}")
        if (found.get("embedding"), found.get("embedding_dim")) != (embedder.name, embedder.dim):
            raise StoreError(f"the store holds vectors of {found.get('embedding')}/{found.get('embedding_dim')}, not {embedder.name}/{embedder.dim}")
        return self

    def manifest(self) -> dict:
        text = self.folder.read("manifest.json")
        if text is None:
            raise StoreError(f"there is no store at {self.path}")
        return json.loads(text)

    def _lost(self, text: str) -> bool:
        """Whether the writer of a lock is gone: its process on this machine, or its lease elsewhere."""
        try:
            own = json.loads(text)
        except ValueError:
            return False
        if own["host"] != socket.gethostname():
            return time.time() - own["time"] > LEASE
        try:
            os.kill(own["pid"], 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            pass
        return False

    @contextmanager
    def lock(self, wait: float = 5.0, poll: float = 0.05) -> Iterator[None]:
        """The writer's lock, for which others wait a while. That of a lost writer is taken over."""
        own = json.dumps({"owner": uuid.uuid4().hex, "host": socket.gethostname(), "pid": os.getpid(), "time": time.time()})
        until = time.monotonic() + wait
        while not self.folder.create("writer.lock", own):
            there = self.folder.read("writer.lock")
            if there is not None and self._lost(there):
                self.folder.move("writer.lock", aside := f"lost-{uuid.uuid4().hex}")
                if self.folder.read(aside) not in (there, None):  # another writer was faster, so it is that one's
                    self.folder.move(aside, "writer.lock")
                self.folder.delete(aside)
                continue
            if time.monotonic() > until:
                raise StoreError(f"the store is locked: {self.folder.at('writer.lock')}")
            time.sleep(poll)
        self._owner = own
        try:
            yield
        finally:
            self._owner = None
            if self.folder.read("writer.lock") == own:
                self.folder.delete("writer.lock")

    # segments

    def _segment(self, number: int, doc: DataFrame | None, chunk: DataFrame | None, marks: DataFrame | None = None) -> dict:
        """Write a segment; what the manifest says of it."""
        out = {"number": number, "rows": doc is not None, "chunks": 0, "terms": 0, "dead": 0, "gone": 0}
        if doc is not None:
            doc.select(*DOC.fieldNames()).write.options(**DENSE).parquet(self.folder.at(f"s{number}/doc"))
            out["chunks"], out["terms"] = PT.write(chunk, self.folder.at(f"s{number}/chunk"), number)
        if marks is not None:
            marks.write.parquet(self.folder.at(f"s{number}/marks"))
            n = self._read(number, "marks", MARKS).agg(F.count_if("gone"), F.count_if(~F.col("gone"))).first()
            out["gone"], out["dead"] = n[0], n[1]
        return out

    def _read(self, number: int, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.folder.at(f"s{number}/{name}"))

    def _commit(self, version: int, segments: list[dict], before: list[dict]) -> None:
        if self._owner is None or self.folder.read("writer.lock") != self._owner:
            raise StoreError("the lock was taken over by another writer")
        old = [s["number"] for s in before]
        parts = {"version": version, "segments": segments, "before": old, "embedding": self.embedder.name, "embedding_dim": self.embedder.dim}
        self.folder.replace("manifest.json", json.dumps({"schema_version": SCHEMA_VERSION} | parts))
        used = {f"s{n}" for n in (*old, *(s["number"] for s in segments))}
        for name in self.folder.names():
            if name[:1] == "s" and name[1:].isdigit() and name not in used:
                self.folder.delete(name)

    def _next(self) -> tuple[list[dict], int]:
        """The segments now, and the number of one to be written."""
        found = self.manifest()
        number = found["version"] + 1
        self.folder.delete(f"s{number}")  # of a writer that was lost
        return found["segments"], number

    def corpus(self) -> Corpus:
        return self._corpus(self.manifest()["segments"])

    def _corpus(self, segments: list[dict]) -> Corpus:
        full = [s["number"] for s in segments if s["rows"]]
        every = lambda make: functools.reduce(DataFrame.unionByName, [make(n).withColumn("segment", F.lit(n)) for n in full])
        chunk_path = lambda n: self.folder.at(f"s{n}/chunk")
        doc, rows = every(lambda n: self._read(n, "doc", DOC)), every(lambda n: PT.read_rows(self.spark, chunk_path(n)))
        postings = every(lambda n: PT.read_postings(self.spark, chunk_path(n))).drop("segment")
        count, terms = sum(s["chunks"] for s in segments), sum(s["terms"] for s in segments)
        marked, gone = [s["number"] for s in segments if s["dead"] or s["gone"]], None
        if marked:
            at = functools.reduce(DataFrame.unionByName, [self._read(n, "marks", MARKS).withColumn("at", F.lit(n)) for n in marked])
            last = at.groupBy(F.col("id").alias("mark_id")).agg(F.max(F.when(F.col("gone"), F.col("at"))).alias("gone_at"), F.max(F.when(~F.col("gone"), F.col("at"))).alias("dead_at"))
            later = lambda c: F.coalesce(F.col(c) > F.col("segment"), F.lit(False))
            if any(s["gone"] for s in segments):
                gone = rows.select("n", "doc_id", "segment").join(last, F.col("doc_id") == F.col("mark_id")).where(later("gone_at")).select("n")
            shown = lambda t, c: t.join(last, F.col(c) == F.col("mark_id"), "left").where(~later("gone_at")).withColumn("deleted", F.col("deleted") | later("dead_at"))
            doc, rows = shown(doc, "id"), shown(rows, "doc_id")
        rows = rows.select(*PT.ROWS.fieldNames())
        index = PT.Index(postings, rows, count, terms / count if count else 0.0, gone)
        return Corpus(doc.select(*DOC.fieldNames()), rows.drop("n", "length"), index)

    def _append(self, segments: list[dict], number: int, new: dict, lost: tuple[int, int] = (0, 0)) -> None:
        """Commit one more segment; ``lost`` are chunks and terms of rows that it replaces. Many segments are folded."""
        new["chunks"], new["terms"] = new["chunks"] - lost[0], new["terms"] - lost[1]
        after = [*segments, new]
        if len(after) > FOLD:
            now = self._corpus(after)
            after, number = [self._segment(number + 1, now.doc, now.chunk)], number + 1
        self._commit(number, after, segments)

    # changes

    def upsert(self, docs: DataFrame, config: Config) -> Added:
        """Documents (doc rows with text and parser) in place of those at their paths. One that is there unchanged stays. Of
        rows with one path, the one with the latest time counts, and of these the one with the greatest id.

        The batch is written down first, so that all that is made of it is of one state of the files."""
        with self.lock():
            segments, number = self._next()
            batch = f"s{number}/batch"
            docs.select(*DOC.fieldNames(), "text", "parser", F.monotonically_increasing_id().alias("row")).write.options(**DENSE).parquet(self.folder.at(batch))
            found = self.spark.read.parquet(self.folder.at(batch))
            paths = found.groupBy("path").agg(F.max(F.struct("mtime", "id", "row")).alias("one"), F.count("*").alias("rows"))
            if paths.where(F.col("rows") > 1).limit(1).count():  # else no row is moved
                later = paths.where(F.col("rows") > 1).select(F.col("path").alias("its_path"), F.col("one.row").alias("kept"))
                out = found.select("path", "row").join(later, (F.col("path") == F.col("its_path")) & (F.col("row") != F.col("kept"))).select("row")
                found = found.join(out, "row", "left_anti")
            found = found.drop("row")
            now = self._corpus(segments)
            found_marks = marks(now.doc, found)
            new = self._segment(number, found, chunk_documents(found, config.chunk_tokens, config.overlap, self.embedder, parser="parser"), found_marks)
            again = self._read(number, "marks", MARKS).where("gone").select(F.col("id").alias("gone_id"))
            lost = now.index.rows.select("doc_id", "length").join(again, F.col("doc_id") == F.col("gone_id"), "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first() if new["gone"] else (0, 0)
            chunks, n = new["chunks"], self._read(number, "doc", DOC).count()
            self.folder.delete(batch)
            self._append(segments, number, new, (lost[0], lost[1]))
        return Added(n, chunks, ())

    def add(self, paths: Sequence[str], config: Config, tag: str | None = None, source: str | None = None, parser: str | None = None, include: str | None = None, exclude: Sequence[str] = (), mtime_only: bool = False, meta: bool = True) -> Added:
        """Ingest files. With ``mtime_only``, those whose path and time are known are skipped. Files that aren't text are
        skipped and named."""
        found = FS.scan(self.spark, paths, include, exclude)
        if mtime_only:
            found = FS.unchanged(found, self.corpus().doc)
        docs, bad = FS.documents(found, tag, source, parser, meta)
        done = self.upsert(docs, config)
        return Added(done.documents, done.chunks, tuple(sorted(r["path"] for r in bad.toLocalIterator())))

    def remove(self, targets: Sequence[str], purge: bool = False) -> int:
        """Tombstones of live documents named by path (if it holds a separator, or names one) or else by id; with ``purge``,
        all tombstones go for good."""
        with self.lock():
            segments, number = self._next()
            now = self._corpus(segments)
            named = self.spark.createDataFrame([(t, "/" not in t) for t in dict.fromkeys(targets)], "target string, may_be_id boolean")
            live = now.doc.where(~F.col("deleted")).select("id", "path")
            by_path = live.join(named, F.col("path") == F.col("target"), "left_semi")
            by_id = live.join(named.where("may_be_id"), F.col("id") == F.col("target"), "left_semi")
            new = self._segment(number, None, None, by_path.union(by_id).select("id", F.lit(False).alias("gone")).distinct())
            if new["dead"]:
                self._append(segments, number, new)
            else:
                self.folder.delete(f"s{number}")
            if purge:
                self._fold()
        return new["dead"]

    def _fold(self, files: int | None = None) -> None:
        """One segment of the live rows."""
        segments, number = self._next()
        now = self._corpus(segments)
        doc, chunk = now.doc.where(~F.col("deleted")), now.chunk.where(~F.col("deleted"))
        if files:
            doc, chunk = doc.coalesce(files), chunk.coalesce(files)
        self._commit(number, [self._segment(number, doc, chunk)], segments)

    def compact(self) -> None:
        """Rewrite the live rows in few files; a store with problems isn't touched."""
        if problems := self.doctor():
            raise StoreError("; ".join(problems))
        with self.lock():
            self._fold(max(1, self.bytes() >> 27))

    def replace(self, doc: DataFrame, chunk: DataFrame) -> None:
        """New tables altogether."""
        with self.lock():
            segments, number = self._next()
            self._commit(number, [self._segment(number, doc, chunk)], segments)

    # reports

    def doctor(self, fix: bool = False) -> list[str]:
        """What is wrong with the store. ``fix`` computes what is derived again: search terms, and missing vectors."""
        now = self.corpus()
        live = now.chunk.where(~F.col("deleted"))
        found = {
            "doc ids that repeat": now.doc.groupBy("id").count().where(F.col("count") > 1),
            "chunk ids that repeat": now.chunk.groupBy("id").count().where(F.col("count") > 1),
            "chunks without a document": live.join(now.doc.where(~F.col("deleted")), F.col("doc_id") == now.doc["id"], "left_anti"),
            "chunks without a vector": live.where(F.col("embedding").isNull() | (F.size("embedding") != self.embedder.dim)),
            "chunks with other search terms than their text's": live.where(~F.col("terms").eqNullSafe(X.terms(F.col("text")))),
        }
        problems = [f"{n} {what}" for what, rows in found.items() if (n := rows.count())]
        if problems and fix:
            vector = F.when(F.col("embedding").isNull() | (F.size("embedding") != self.embedder.dim), self.embedder.column(F.split("text", " "))).otherwise(F.col("embedding"))
            self.replace(now.doc, now.chunk.withColumn("terms", X.terms(F.col("text"))).withColumn("embedding", vector))
            return self.doctor()
        return problems

    def stats(self) -> dict:
        now = self.corpus()
        chunk = now.chunk.where(~F.col("deleted")).agg(F.count("*").alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
        doc = now.doc.where(~F.col("deleted")).agg(F.count("*").alias("docs"), F.coalesce(F.max("mtime"), F.lit("")).alias("snapshot")).first()
        return {"docs": doc["docs"], "chunks": chunk["chunks"], "tokens": chunk["tokens"], "snapshot": doc["snapshot"], "bytes": self.bytes(), "parts": self._parts(), "memory": {"driver_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss << 10}}

    def _parts(self) -> dict[str, int]:
        """Bytes of the tables and of the index."""
        full = [s["number"] for s in self.manifest()["segments"] if s["rows"]]
        return {name: sum(self.folder.bytes(f"s{n}/{where}") for n in full) for name, where in (("doc", "doc"), ("chunk", "chunk/rows"), ("postings", "chunk/postings"))}

    def bytes(self) -> int:
        return self.folder.bytes()


def marks(doc: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, gone) of rows that documents take the places of: those of their ids are gone, and live ones at their paths with
    other ids are deleted."""
    new = incoming.select(F.col("path").alias("new_path"), F.col("id").alias("new_id"))
    again = doc.join(new, F.col("id") == F.col("new_id"), "left_semi").select("id", F.lit(True).alias("gone"))
    other = doc.where(~F.col("deleted")).join(new, (F.col("path") == F.col("new_path")) & (F.col("id") != F.col("new_id")), "left_semi").select("id", F.lit(False).alias("gone"))
    return again.unionByName(other)


def marked(doc: DataFrame, found: DataFrame) -> DataFrame:
    """The doc table after marks: without rows that are gone, and with tombstones."""
    rows = doc.join(found.withColumnRenamed("id", "mark_id"), F.col("id") == F.col("mark_id"), "left")
    return rows.where(~F.coalesce("gone", F.lit(False))).withColumn("deleted", F.col("deleted") | F.col("mark_id").isNotNull()).select(*doc.columns)
