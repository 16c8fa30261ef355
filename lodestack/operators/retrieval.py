"""Search over chunks: full text, nearest neighbours, their fusion, grouping, order and paging.

Results are DataFrames of (score, lexical, semantic, doc, chunk); scores are 32-bit floats, and every order is total.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fulltext as FT
from ..functions.vectors import cosine
from ..plans.filters import Filters, meta_is_number, meta_key, meta_value
from ..plans.syntax import Expr, Field, Order, Query
from ..schema import CHUNK_FIELDS, DOC_FIELDS, NUMERIC_FIELDS, Corpus, QueryError
from . import postings as PT

#: Limit of a structured query that names none.
DEFAULT_LIMIT = 1000


@dataclass(frozen=True)
class Lexical:
    """What a full-text search ran: the rows and, if the text had to be cleaned, how."""

    rows: DataFrame
    original: str
    sanitized: str | None = None
    warning: str | None = None


def filters() -> Filters:
    return Filters(lambda table, name: F.col(f"{table}.{name}"))


def live_docs(corpus: Corpus, snapshot: str | None = None) -> DataFrame:
    rows = corpus.doc.where(~F.col("deleted"))
    return rows if snapshot is None else rows.where(F.col("mtime") <= F.lit(snapshot))


def joined(corpus: Corpus, snapshot: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Live chunks with their live documents, as structs ``doc`` and ``chunk``, and ``extra`` columns of chunks."""
    doc = live_docs(corpus, snapshot).select(F.struct(*DOC_FIELDS).alias("doc"))
    chunk = corpus.chunk.where(~F.col("deleted")).select(F.struct(*CHUNK_FIELDS).alias("chunk"), *extra)
    return chunk.join(doc, F.col("chunk.doc_id") == F.col("doc.id"))


def _rank() -> list[Column]:
    return [F.col("doc.path").asc(), F.col("chunk.offset").asc(), F.col("chunk.id").asc()]


def _empty(corpus: Corpus) -> DataFrame:
    rows = joined(corpus).limit(0)
    none = F.lit(None).cast("float")
    return rows.select(none.alias("score"), none.alias("lexical"), none.alias("semantic"), "doc", "chunk")


def lexical_tree(corpus: Corpus, node: FT.Node, k: int, where: Expr | None = None, snapshot: str | None = None) -> DataFrame:
    """The ``k`` best rows by BM25 that match and pass the filter, which comes before the cut.

    Statistics cover all rows of the chunk table, deleted ones too, as an index of all rows would. The displayed score is
    1/(1 + max(bm25, 0)); BM25 is negative for every match, so it is 1.
    """
    if k <= 0:
        return _empty(corpus)
    if corpus.index is not None:
        return _from_index(corpus, node, k, where, snapshot)
    stats = FT.corpus_stats(corpus.chunk, node)
    chunk = corpus.chunk.where(~F.col("deleted") & FT.matches(node, F.col("terms")))
    rows = chunk.select(_narrow(where), FT.bm25(node, F.col("terms"), stats).alias("bm25"))
    best = _best(corpus, rows, k, where, snapshot)
    if k <= PT.LOOKUP_ROWS:
        found = best.collect()
        best = corpus.doc.sparkSession.createDataFrame(found, best.schema)
        texts = corpus.chunk.where(F.col("id").isin([r["chunk"]["id"] for r in found]))
    else:
        texts = corpus.chunk
    texts = texts.select(F.col("id").alias("own_id"), F.col("text").alias("own_text")).dropDuplicates(["own_id"])
    return _with_text(best.join(texts, F.col("chunk.id") == F.col("own_id")))


def _narrow(where: Expr | None) -> Column:
    """A chunk without its text, if the filter doesn't look at that."""
    text = F.col("text") if where is not None and "text" in _fields(where) else F.lit("").alias("text")
    return F.struct("id", "doc_id", "offset", "tokens", text).alias("chunk")


def _best(corpus: Corpus, rows: DataFrame, k: int, where: Expr | None, snapshot: str | None) -> DataFrame:
    """The ``k`` best of matching chunks (with ``bm25``) whose documents live and that pass the filter, with their documents."""
    doc = live_docs(corpus, snapshot).select(F.struct(*DOC_FIELDS).alias("doc"))
    found = rows.join(doc, F.col("chunk.doc_id") == F.col("doc.id"))
    if where is not None:
        found = found.where(filters().compile(where))
    return found.select(*rows.columns, "doc").orderBy("bm25", *_rank()).limit(k)


def _with_text(best: DataFrame) -> DataFrame:
    """A full-text search's result, of its best rows with their ``own_text``."""
    whole = F.col("chunk").withField("text", F.col("own_text")).alias("chunk")
    score = (1.0 / (1.0 + F.greatest(F.col("bm25"), F.lit(0.0)))).cast("float")
    return best.select(score.alias("score"), score.alias("lexical"), F.lit(None).cast("float").alias("semantic"), "doc", whole)


def _fields(e: Expr) -> set[str]:
    """Names of the chunk fields that a filter looks at."""
    if hasattr(e, "field"):
        return {e.field.name} if e.field.table != "doc" else set()
    return set().union(*[_fields(part) for part in vars(e).values()])


def _from_index(corpus: Corpus, node: FT.Node, k: int, where: Expr | None, snapshot: str | None) -> DataFrame:
    """``lexical_tree`` over an index: postings of the query's words, narrow columns of the chunks that match, and the text of
    the best ones only."""
    index = corpus.index
    chunk = index.rows.where(~F.col("deleted")).select("n", _narrow(where))
    best = _best(corpus, PT.search(index, node).join(chunk, "n"), k, where, snapshot)
    if k <= PT.LOOKUP_ROWS:
        found = best.collect()
        best = corpus.doc.sparkSession.createDataFrame(found, best.schema)
        texts = PT.lookup(index, [r["n"] for r in found], [F.col("text").alias("own_text")])
    else:
        texts = index.rows.select("n", F.col("text").alias("own_text"))
    return _with_text(best.join(texts, "n"))


def lexical(corpus: Corpus, text: str, k: int, where: Expr | None = None, snapshot: str | None = None, literal: bool = False) -> Lexical:
    """Full-text search. In literal mode the text is cleaned first; else only after a syntax error, if that changes it."""
    if literal:
        clean = FT.sanitize(text)
        if not clean:
            return Lexical(_empty(corpus), text, clean, "nothing to search for is left of the text")
        return Lexical(lexical_tree(corpus, FT.parse(clean), k, where, snapshot), text, clean if clean != text else None)
    try:
        return Lexical(lexical_tree(corpus, FT.parse(text), k, where, snapshot), text)
    except FT.FullTextSyntaxError as error:
        clean = FT.sanitize(text)
        if clean == text:
            raise
        if not clean:
            return Lexical(_empty(corpus), text, clean, "nothing to search for is left of the text")
        try:
            node = FT.parse(clean)
        except QueryError:
            raise error from None
        return Lexical(lexical_tree(corpus, node, k, where, snapshot), text, clean, f"the text was searched as: {clean}")


def candidates(k: int, filtered: bool, max_limit: int) -> int:
    """How many nearest neighbours are taken before a filter: more than ``k``, as some will fail it."""
    return min(max(k, 64), max(max_limit, k)) if filtered else k


def semantic(corpus: Corpus, vector: list[float], k: int, where: Expr | None = None, snapshot: str | None = None, max_limit: int = 1000) -> DataFrame:
    """The ``k`` most similar chunks of the nearest candidates that pass the filter, which comes after the neighbours.

    The search is exact: one pass that keeps the top of every task. Only ids and vectors take part; the few rows found are
    looked up by their ids, before anything is joined to them. Vectors without length, or of another dimension, are nobody's neighbours. Ties go by path, offset and id.
    """
    if k <= 0:
        return _empty(corpus)
    near = candidates(k, where is not None or snapshot is not None, max_limit)
    live = corpus.chunk.where(~F.col("deleted")).select(F.col("id").alias("near_id"), "doc_id", "offset", cosine(F.col("embedding"), vector).alias("similarity")).where(F.col("similarity").isNotNull())
    top = live.orderBy(F.col("similarity").desc(), "doc_id", "offset", "near_id").limit(near).select("near_id", "similarity")
    chunk, doc = corpus.chunk, corpus.doc
    if near <= PT.LOOKUP_ROWS:
        found = live.select("near_id", "doc_id", "similarity", "offset").orderBy(F.col("similarity").desc(), "doc_id", "offset", "near_id").limit(near).collect()
        top = chunk.sparkSession.createDataFrame([(r["near_id"], r["similarity"]) for r in found], "near_id string, similarity double")
        chunk, doc = chunk.where(F.col("id").isin([r["near_id"] for r in found])), doc.where(F.col("id").isin([r["doc_id"] for r in found]))
    rows = chunk.join(F.broadcast(top), F.col("id") == F.col("near_id")).where(~F.col("deleted")).select(F.struct(*CHUNK_FIELDS).alias("chunk"), "similarity")  # at most ``near`` rows
    rows = rows.join(live_docs(Corpus(doc, chunk), snapshot).select(F.struct(*DOC_FIELDS).alias("doc")), F.col("chunk.doc_id") == F.col("doc.id"))
    if where is not None:
        rows = rows.where(filters().compile(where))
    score = F.col("similarity").cast("float")
    rows = rows.select(score.alias("score"), F.lit(None).cast("float").alias("lexical"), score.alias("semantic"), "doc", "chunk")
    return rows.orderBy(F.col("score").desc(), *_rank()).limit(k)


def fuse(lex: DataFrame | None, sem: DataFrame | None, bm25_weight: float, vector_weight: float) -> DataFrame:
    """Weighted sum of both lists by chunk; a side that lacks a chunk counts 0. If one list is empty, the other passes as it
    is, unweighted."""
    if lex is None or sem is None:
        return lex if sem is None else sem
    left = lex.select(F.col("chunk.id").alias("id"), F.col("lexical").alias("l"), F.col("doc").alias("doc_l"), F.col("chunk").alias("chunk_l"))
    right = sem.select(F.col("chunk.id").alias("id"), F.col("semantic").alias("s"), F.col("doc").alias("doc_s"), F.col("chunk").alias("chunk_s"))
    both = left.join(right, "id", "full_outer")
    # emptiness of either list: over the whole result, which has no more rows than the limits of both
    every = W.partitionBy()
    both = both.withColumn("n_l", F.count("l").over(every)).withColumn("n_s", F.count("s").over(every))
    zero = F.lit(0.0).cast("float")
    weighted = (F.coalesce("l", zero) * F.lit(bm25_weight).cast("float") + F.coalesce("s", zero) * F.lit(vector_weight).cast("float")).cast("float")
    score = F.when(F.col("n_l") == 0, F.col("s")).when(F.col("n_s") == 0, F.col("l")).otherwise(weighted)
    return both.select(score.alias("score"), F.col("l").alias("lexical"), F.col("s").alias("semantic"), F.coalesce("doc_l", "doc_s").alias("doc"), F.coalesce("chunk_l", "chunk_s").alias("chunk"))


def best_per_doc(rows: DataFrame) -> DataFrame:
    """The best chunk of each document."""
    w = W.partitionBy("doc.id").orderBy(F.col("score").desc(), F.col("chunk.offset"), F.col("chunk.id"))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") == 1).drop("place")


def scored_order(table: str) -> list[Column]:
    ties = _rank() if table == "chunk" else [F.col("doc.path").asc(), F.col("doc.id").asc()]
    return [F.col("score").desc(), *ties]


def _value(f: Field) -> tuple[Column, Column] | None:
    """(is a number, value) that a scored query sorts by; None for a field that isn't there."""
    table, name = f.table or ("doc" if f.name in DOC_FIELDS or f.name.startswith("meta.") else "chunk"), f.name
    if table == "doc" and name.startswith("meta."):
        meta, key = F.col("doc.meta"), meta_key(name)
        return meta_is_number(meta, key), F.coalesce(meta_value(meta, key), F.lit(""))
    if name not in (DOC_FIELDS if table == "doc" else CHUNK_FIELDS):
        return None
    x = F.col(f"{table}.{name}")
    return (F.lit(True), x) if (table, name) in NUMERIC_FIELDS else (F.lit(False), F.coalesce(x, F.lit("")))


def reorder(rows: DataFrame, order: Order | None, table: str) -> DataFrame:
    """Order of a scored result: by one field, texts before numbers, missing texts as empty ones; ties by rank."""
    keys = scored_order(table)
    if order is None or (order.field.table is None and order.field.name == "score"):
        if order is not None and not order.descending:
            keys[0] = F.col("score").asc()
        return rows.orderBy(*keys)
    found = _value(order.field)
    if found is None:
        return rows.orderBy(*keys[1:])
    number, value = found
    columns = [number, F.when(number, value.try_cast("double")), F.when(~number, value.cast("string"))]
    turn = (lambda c: c.desc()) if order.descending else (lambda c: c.asc())
    return rows.orderBy(*[turn(c) for c in columns], *keys[1:])


#: Above this, a limit isn't kept as a heap of rows in every task.
HEAP_LIMIT = 100_000


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of ordered rows. A limit that all rows fit in leaves them spread over the
    cluster; it costs a count, which is made for large limits only."""
    if limit + offset > HEAP_LIMIT:
        if not offset and rows.count() <= limit:
            return rows
        rows = rows.where(F.monotonically_increasing_id() >= 0)  # keeps the sort apart from the limit
    return (rows.offset(offset) if offset else rows).limit(limit)


def structured(corpus: Corpus, query: Query, snapshot: str | None = None) -> DataFrame:
    """A query without a search: filter, sort, page; rows of doc, or of doc and chunk. Scores are null."""
    where = query.filter
    none = F.lit(None).cast("float")
    head = [none.alias("score"), none.alias("lexical"), none.alias("semantic")]
    if query.table == "doc":
        rows = live_docs(corpus, snapshot).select(F.struct(*DOC_FIELDS).alias("doc"))
        missing = F.lit(None).cast("struct<id:string,doc_id:string,offset:bigint,tokens:bigint,text:string>")
        if where is not None:
            _only(where, "doc")
            rows = rows.where(filters().compile(where))
        ties = [F.col("doc.path").asc(), F.col("doc.id").asc()]
        rows = rows.select(*head, "doc", missing.alias("chunk"))
    else:
        rows = joined(corpus, snapshot)
        if where is not None:
            rows = rows.where(filters().compile(where))
        ties = _rank()
        rows = rows.select(*head, "doc", "chunk")
    keys = ties
    if query.order and not (query.order.field.table is None and query.order.field.name == "score"):
        by = query.order.field
        table, name = by.table or query.table, by.name
        if table == "chunk" and query.table == "doc":
            raise QueryError("chunk fields need FROM chunk")
        filters().resolve(Field(table, name))
        c = meta_value(F.col("doc.meta"), meta_key(name)) if name.startswith("meta.") else F.col(f"{table}.{name}")
        keys = [c.desc() if query.order.descending else c.asc(), *ties]
    return page(rows.orderBy(*keys), DEFAULT_LIMIT if query.limit is None else query.limit, query.offset)


def _only(e: Expr, table: str) -> None:
    if hasattr(e, "field"):
        if e.field.table != table:
            raise QueryError(f"a query over {table} can't filter by {e.field.table}.{e.field.name}")
    else:
        for part in vars(e).values():
            _only(part, table)


@dataclass(frozen=True)
class Selection:
    """Which fields a result shows; unknown names are left out."""

    score: bool
    doc: tuple[str, ...]
    chunk: tuple[str, ...]
    meta: tuple[str, ...] = ()


def select_fields(fields: tuple[Field, ...] | None, table: str = "chunk") -> Selection:
    """Of no selection: the score and everything. ``*``: everything but the score, in place of what was named before."""
    if fields is None:
        return Selection(True, DOC_FIELDS, CHUNK_FIELDS)
    score, doc, chunk, meta = False, [], [], []
    for f in fields:
        name = f.name
        if f.table is None and name == "*":
            doc, chunk = list(DOC_FIELDS), list(CHUNK_FIELDS)
        elif f.table is None and name == "score":
            score = True
        elif name.startswith("meta.") and f.table != "chunk":
            meta.append(meta_key(name))
        elif f.table != "chunk" and name in DOC_FIELDS:
            doc.append(name)
        elif f.table != "doc" and name in CHUNK_FIELDS:
            chunk.append(name)
    one = lambda x: tuple(dict.fromkeys(x))
    return Selection(score, one(doc), one(chunk), one(meta))


def project(rows: DataFrame, chosen: Selection) -> DataFrame:
    """Flat columns of a selection: score, doc_<field>, doc_meta_<key>, chunk_<field>; none leave rows of nothing."""
    out = [F.col("score")] if chosen.score else []
    out += [F.col(f"doc.{f}").alias(f"doc_{f}") for f in chosen.doc]
    out += [meta_value(F.col("doc.meta"), k).alias(f"doc_meta_{k}") for k in chosen.meta]
    out += [F.col(f"chunk.{f}").alias(f"chunk_{f}") for f in chosen.chunk]
    return rows.select(*out) if out else rows.select(F.struct().alias("empty"))
