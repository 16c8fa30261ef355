"""The engine: everything a user calls."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import output
from .functions.vectors import Embedder, HashEmbedder
from .operators import context as C
from .operators import retrieval as R
from .plans.syntax import Query, parse_filter, parse_query
from .schema import Config, Corpus, QueryError
from .sources import transfer
from .sources.store import Added, Store

_TIME = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\Z")


def at_file(text: str) -> str:
    """A text, or that of the file which ``@name`` names."""
    if not text.startswith("@"):
        return text
    found = Path(text[1:]).read_text(encoding="utf-8").strip()
    if not found:
        raise QueryError(f"{text[1:]} is empty")
    return found


def snapshot_token(token: str | None) -> str | None:
    if token is not None and not _TIME.match(token):
        raise QueryError(f"a snapshot is an RFC 3339 time, not {token!r}")
    return token


@dataclass
class Result:
    """Rows of a search (score, lexical, semantic, doc, chunk), what of them is shown, and how they came about."""

    rows: DataFrame
    selection: R.Selection
    explain: dict[str, Any] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    fused: DataFrame | None = None
    asked: dict[str, Any] = field(default_factory=dict)
    lists: dict[str, DataFrame | None] = field(default_factory=dict)

    def hits(self, returned: int | None = None) -> int:
        """Rows of a search before they are grouped and paged; of a query without one, those that are returned."""
        if self.fused is not None:
            return self.fused.count()
        return self.rows.count() if returned is None else returned

    def frame(self) -> DataFrame:
        """The selected fields as columns."""
        return R.project(self.rows, self.selection)

    def json(self, explain: bool = False) -> dict[str, Any]:
        began = time.monotonic()
        found = self.rows.collect()
        hits = self.hits(len(found))
        stats = {"returned": len(found), "total_hits": hits, "took_ms": int(1000 * (time.monotonic() - began)), "snapshot": self.asked.get("snapshot")}
        limit, offset = self.asked.get("limit"), self.asked.get("offset", 0)
        told = self.explain | {f"{k}_hits": t.count() for k, t in self.lists.items() if t is not None} if explain else None
        return output.envelope(query=self.asked or None, results=[output.item(r, self.selection, explain) for r in found], stats=stats, explain=told, warnings=self.warnings or None, next_offset=offset + len(found) if limit and len(found) == limit else None)


class Engine:
    """Searches over a corpus, or over a store that can also be changed."""

    def __init__(self, source: Corpus | Store, config: Config | None = None, embedder: Embedder | None = None) -> None:
        self.config = config or Config()
        self.store = source if isinstance(source, Store) else None
        self._corpus = source if isinstance(source, Corpus) else None
        self.embedder = embedder or (self.store.embedder if self.store else HashEmbedder(self.config.embedding_dim))

    @classmethod
    def create(cls, spark: SparkSession, path: str | Path, config: Config | None = None) -> Engine:
        config = config or Config()
        return cls(Store.create(spark, path, HashEmbedder(config.embedding_dim)), config)

    @classmethod
    def open(cls, spark: SparkSession, path: str | Path, config: Config | None = None) -> Engine:
        config = config or Config()
        return cls(Store.open(spark, path, HashEmbedder(config.embedding_dim)), config)

    @property
    def corpus(self) -> Corpus:
        return self._corpus or self._need().corpus()

    def _need(self) -> Store:
        if self.store is None:
            raise QueryError("this engine has no store")
        return self.store

    def _search(self, lexical: str | None, semantic: str | list[float] | None, k: int, where=None, snapshot: str | None = None, literal: bool = False) -> Result:
        corpus, lex, sem, explain, warnings = self.corpus, None, None, {}, []
        if lexical is not None:
            ran = R.lexical(corpus, lexical, k, where, snapshot, literal)
            lex = ran.rows
            explain["lexical"] = {"original": ran.original, "sanitized": ran.sanitized}
            warnings += [ran.warning] if ran.warning else []
        if semantic is not None:
            vector = self.embedder.query(semantic) if isinstance(semantic, str) else semantic
            sem = R.semantic(corpus, vector, k, where, snapshot, self.config.max_limit)
            explain["candidates"] = R.candidates(k, where is not None or snapshot is not None, self.config.max_limit)
        explain["mode"] = "hybrid" if lex is not None and sem is not None else "lexical" if lex is not None else "semantic"
        explain["config"] = {"bm25_weight": self.config.bm25_weight, "vector_weight": self.config.vector_weight, "embedding": self.embedder.name, "embedding_dim": self.embedder.dim}
        rows = R.fuse(lex, sem, self.config.bm25_weight, self.config.vector_weight)
        if rows is None:
            rows = R._empty(corpus)
        explain["snapshot"] = snapshot
        return Result(rows, R.select_fields(None), explain, warnings, rows, {}, {"lexical": lex, "semantic": sem})

    def search(self, text: str, k: int = 8, bm25: bool = False, vector: bool = False, filter: str | None = None, snapshot: str | None = None, literal: bool = False, strict: bool = True) -> Result:
        """The ``k`` best chunks: by full text with ``bm25``, by vectors with ``vector``, by both with neither or both."""
        where = parse_filter(at_file(filter), strict) if filter else None
        found = self._search(text if bm25 or not vector else None, text if vector or not bm25 else None, k, where, snapshot_token(snapshot), literal)
        found.rows = R.page(R.reorder(found.rows, None, "chunk"), k)
        found.asked = {"text": text, "filters": filter, "limit": k, "offset": 0, "lexical_mode": "literal" if literal else "syntax", "snapshot": snapshot}
        return found

    def query(self, source: str | Query, snapshot: str | None = None, literal: bool = False, strict: bool = True) -> Result:
        """A query of the query language."""
        q = parse_query(at_file(source), strict) if isinstance(source, str) else source
        snapshot = snapshot_token(snapshot)
        chosen = R.select_fields(q.select, q.table)
        asked = {"query": source if isinstance(source, str) else None, "offset": q.offset, "lexical_mode": "literal" if literal else "syntax", "snapshot": snapshot}
        if not q.using:
            return Result(R.structured(self.corpus, q, snapshot), chosen, {"mode": "structured", "snapshot": snapshot}, asked=asked | {"limit": R.DEFAULT_LIMIT if q.limit is None else q.limit})
        limit = self.config.max_limit if q.limit is None else q.limit
        found = self._search(q.lexical, q.semantic, limit + q.offset, q.filter, snapshot, literal)
        rows = R.page(R.reorder(found.rows, None, "chunk"), limit + q.offset)
        if q.table == "doc":
            rows = R.best_per_doc(rows)
        found.rows, found.selection, found.asked = R.page(R.reorder(rows, q.order, q.table), limit, q.offset), chosen, asked | {"limit": limit}
        return found

    def context(self, text: str, budget: int = C.BUDGET, diversity: int | None = None, filter: str | None = None, snapshot: str | None = None) -> DataFrame:
        """(text, used_tokens, chunks): the best chunks that fit a budget of tokens."""
        return C.render(self.packed(text, budget, diversity, filter, snapshot))

    def packed(self, text: str, budget: int = C.BUDGET, diversity: int | None = None, filter: str | None = None, snapshot: str | None = None) -> DataFrame:
        rows = self.search(text, C.RETRIEVED, filter=filter, snapshot=snapshot).rows
        return C.pack(ranked(rows), budget, diversity)

    # a store's changes and reports

    def add(self, paths: list[str], **options: Any) -> Added:
        return self._need().add(paths, self.config, **options)

    def remove(self, targets: list[str], purge: bool = False) -> int:
        return self._need().remove(targets, purge)

    def compact(self) -> None:
        self._need().compact()

    def doctor(self, fix: bool = False) -> list[str]:
        return self._need().doctor(fix)

    def stats(self) -> dict:
        return self._need().stats()

    def export(self, path: str) -> None:
        transfer.export(self.corpus, path)

    def import_(self, path: str) -> None:
        store = self._need()
        new = transfer.merged(store.corpus(), *transfer.read_lines(store.spark, path))
        store.replace(new.doc, new.chunk)


def ranked(rows: DataFrame) -> DataFrame:
    """A search's rows with their ``rank`` from 1 (few rows: one window over all)."""
    from pyspark.sql import Window as W

    return rows.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(*R.scored_order("chunk"))))
