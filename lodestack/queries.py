"""Queries over the test tables, one or more for each operator, and the same in DuckDB SQL.

``documents`` are documents (path from source, language and number), cut into plain chunks of 256 tokens with 32 of overlap.
For vectors, chunks are whole documents that have a row in ``embeddings``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import output as OUT
from .api import Engine, at_file, ranked
from .functions import fulltext as FT
from .functions import text as X
from .functions.vectors import HashEmbedder
from .operators import chunking as CH
from .operators import context as C
from .operators import postings as PT
from .operators import retrieval as R
from .plans.syntax import Query, parse_filter
from .schema import DOC, Config, Corpus
from .sources import files as FS
from .sources import store as ST
from .sources import transfer as TR

SIZE, OVERLAP = 256, 32
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


# the tables


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the doc table, with ``n`` and ``text``."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang, source, text = F.coalesce("lang", F.lit("und")), F.coalesce("source", F.lit("none")), F.coalesce("text", F.lit(""))
    path = F.concat(source, F.lit("/"), lang, F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".txt"))
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    rows = d.select(path.alias("path"), F.concat(F.lit("2024-01-"), day, F.lit("T00:00:00Z")).alias("mtime"), F.octet_length(text).cast("long").alias("size"), X.content_hash(text).alias("hash"), lang.alias("tag"), source.alias("source"), F.concat(F.lit('{"lang":"'), lang, F.lit('","n_chars":"'), F.coalesce(F.col("n_chars").cast("string"), F.lit("0")), F.lit('"}')).alias("meta"), F.col("doc_id").alias("n"), text.alias("text"))
    return rows.select(X.doc_id(F.col("path"), F.col("hash")).alias("id"), "path", "mtime", "size", "hash", "tag", "source", "meta", F.lit(False).alias("deleted"), "n", "text")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    d = docs(spark, sf_dir)
    return Corpus(d.select(*DOC.fieldNames()), CH.chunk_documents(d, SIZE, OVERLAP))


def vector_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    d = docs(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = d.join(e, F.col("n") == F.col("vec_id"))
    chunk = rows.select(X.chunk_id(F.col("id"), F.lit(0)).alias("id"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("offset"), F.size(X.tokens(F.col("text"))).cast("long").alias("tokens"), "text", X.terms(F.col("text")).alias("terms"), "embedding", F.lit(False).alias("deleted"))
    return Corpus(d.select(*DOC.fieldNames()), chunk)


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the first row of ``embeddings``."""
    return list(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 0").select("embedding").first()[0])


_INGESTED: dict[tuple, Corpus] = {}


def _folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share: below ``spark.checkpoint.dir``, or a temporary one of a local session."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lodestack-")
    return f"{root.rstrip('/')}/ingested-{uuid.uuid4().hex}"


def ingested(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus of a folder with its inverted index, as a store holds it: written once in a session for the state that the
    table is in, and read by every search after that."""
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    key = (id(spark), *sorted((r[0], r[1], str(r[2])) for r in found))
    if key not in _INGESTED:
        d, path = docs(spark, sf_dir), _folder(spark)
        fresh = Corpus(d.select(*DOC.fieldNames()), CH.chunk_documents(d, SIZE, OVERLAP, HashEmbedder(256)))
        fresh.doc.write.parquet(f"{path}/doc")
        index = PT.read(spark, f"{path}/chunk", *PT.write(fresh.chunk, f"{path}/chunk"))
        _INGESTED[key] = Corpus(spark.read.schema(DOC).parquet(f"{path}/doc"), index.rows.drop("n", "length"), index)
    return _INGESTED[key]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(corpus(spark, sf_dir), Config())


def searcher(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(ingested(spark, sf_dir), Config())


DOC_SQL = """doc AS (SELECT *, sha256(path || chr(0) || hash) AS id FROM (SELECT doc_id AS n, coalesce(text, '') AS text, coalesce(lang, 'und') AS tag,
  coalesce(source, 'none') AS source, coalesce(source, 'none') || '/' || coalesce(lang, 'und') || '/' || lpad(doc_id::VARCHAR, 7, '0') || '.txt' AS path,
  sha256(coalesce(text, '')) AS hash, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' AS mtime, strlen(coalesce(text, '')) AS size,
  '{"lang":"' || coalesce(lang, 'und') || '","n_chars":"' || coalesce(n_chars, 0)::VARCHAR || '"}' AS meta FROM documents))"""
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
TERMS = r"list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
CHUNK_SQL = (
    DOC_SQL
    + f""", words AS (SELECT id AS doc_id, path, tag, {WORDS.format("text")} AS w FROM doc),
  cut AS (SELECT doc_id, path, tag, unnest(range(0, greatest(0, len(w) - {OVERLAP} - 1) + 1, {SIZE - OVERLAP})) AS "offset", w FROM words WHERE len(w) > 0),
  chunk AS (SELECT sha256(doc_id || ':' || "offset"::VARCHAR) AS id, doc_id, path, tag, "offset", len(own) AS tokens, array_to_string(own, ' ') AS text
    FROM (SELECT *, list_slice(w, "offset" + 1, "offset" + {SIZE}) AS own FROM cut)),
  terms AS (SELECT *, {TERMS.format("text")} AS t FROM chunk)"""
)
VECTOR_SQL = (
    DOC_SQL
    + f""", chunk AS (SELECT sha256(id || ':0') AS id, id AS doc_id, path, tag, 0 AS "offset", text, embedding::DOUBLE[] AS e, {TERMS.format("text")} AS t FROM doc JOIN embeddings ON n = vec_id),
  near AS (SELECT *, round(list_cosine_similarity(e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 12)::FLOAT AS s FROM chunk)"""
)


def _round(name: str, out: str | None = None) -> Column:
    return F.round(F.col(name).cast("double"), 5).alias(out or name)


# sources and sinks


@register()
def ingest_scan(spark, sf_dir):
    return FS.digests(spark, [sf_dir])


@register(f"WITH {DOC_SQL} SELECT path FROM doc WHERE regexp_matches(path, '^src1[0-9]*/(.*/)?[^/]*[.]txt$') AND NOT regexp_matches(path, '^.*/(fr|de)/.*$')")
def ingest_glob(spark, sf_dir):
    return docs(spark, sf_dir).where(FS.chosen(F.col("path"), "src1*/**/*.txt", ["**/{fr,de}/**"])).select("path")


@register(f"WITH {DOC_SQL} SELECT path, mtime FROM (SELECT path, CASE WHEN n % 3 = 0 THEN '2025-01-01T00:00:00Z' ELSE mtime END AS mtime, mtime AS old, n FROM doc) WHERE n % 5 = 0 OR mtime <> old")
def ingest_mtime_skip(spark, sf_dir):
    d = docs(spark, sf_dir)
    known = d.where(F.col("n") % 5 != 0)
    return FS.unchanged(d.withColumn("mtime", F.when(F.col("n") % 3 == 0, "2025-01-01T00:00:00Z").otherwise(F.col("mtime"))), known).select("path", "mtime")


@register(f"""WITH {DOC_SQL} SELECT id, path, n % 4 = 0 AS deleted FROM doc
  UNION ALL SELECT sha256(path || chr(0) || sha256(text || ' more')), path, false FROM doc WHERE n % 4 = 0""")
def upsert_tombstone(spark, sf_dir):
    d = docs(spark, sf_dir)
    new = d.where(F.col("n") % 4 == 0).withColumn("hash", X.content_hash(F.concat("text", F.lit(" more")))).withColumn("id", X.doc_id(F.col("path"), F.col("hash")))
    rows = d.select(*DOC.fieldNames())
    return ST.marked(rows, ST.marks(rows, new)).unionByName(new.select(*DOC.fieldNames())).select("id", "path", "deleted")


@register(f"""WITH {DOC_SQL} SELECT id, path, mtime, size::BIGINT AS size, hash, tag, source, meta FROM doc""")
def export_doc_lines(spark, sf_dir):
    lines = TR.doc_lines(corpus(spark, sf_dir).doc)
    return TR.parse_lines(lines)[0].select("id", "path", "mtime", "size", "hash", "tag", "source", "meta")


@register(f"""WITH {VECTOR_SQL} SELECT id, doc_id, "offset"::BIGINT AS "offset", text, round(list_sum(e), 4) AS total FROM chunk""")
def import_roundtrip(spark, sf_dir):
    _, chunk = TR.parse_lines(TR.chunk_lines(vector_corpus(spark, sf_dir).chunk))
    return chunk.select("id", "doc_id", "offset", "text", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


# ingest transforms


@register("""SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'markdown' WHEN doc_id % 5 IN (2, 3) THEN 'code' ELSE 'plain' END AS parser FROM documents""")
def parser_resolve(spark, sf_dir):
    name = F.element_at(F.array(F.lit(".txt"), F.lit(".md"), F.lit(".RS"), F.lit(".json"), F.lit(".tar.gz")), (F.col("n") % 5 + 1).cast("int"))
    return docs(spark, sf_dir).select(F.col("n").alias("doc_id"), X.parser_of(F.concat(F.regexp_replace("path", r"\.txt$", ""), name)).alias("parser"))


@register(f"WITH {DOC_SQL} SELECT n AS doc_id, len(w)::BIGINT AS n_tokens, sha256(array_to_string(w, '|')) AS tokens_hash FROM (SELECT n, {WORDS.format('text')} AS w FROM doc)")
def tokenize_ws(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("w", X.tokens(F.col("text"))).select(F.col("n").alias("doc_id"), F.size("w").cast("long").alias("n_tokens"), F.sha2(F.array_join("w", "|"), 256).alias("tokens_hash"))


@register(f"""WITH {CHUNK_SQL} SELECT id, doc_id, "offset"::BIGINT AS "offset", tokens::BIGINT AS tokens, text FROM chunk""")
def chunk_plain(spark, sf_dir):
    return corpus(spark, sf_dir).chunk.select("id", "doc_id", "offset", "tokens", "text")


def _marked(spark, sf_dir, parser: str, fifth: Callable[[Column], Column], seventh: str) -> DataFrame:
    line = lambda l: F.when(F.length(l) % 7 == 0, seventh).when(F.length(l) % 5 == 0, fifth(l)).otherwise(l)
    return docs(spark, sf_dir).withColumn("text", F.array_join(F.transform(F.split("text", "\n"), line), "\n")).withColumn("parser", F.lit(parser))


def _blocks_sql(fifth: str, seventh: str, cut: str, kept: str) -> str:
    return f"""WITH {DOC_SQL}, l AS (SELECT id, unnest(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN length(l) % 7 = 0 THEN '{seventh}' WHEN length(l) % 5 = 0 THEN '{fifth}' || l ELSE l END)) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS k FROM doc),
  f AS (SELECT *, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS fences, lag(line) OVER (PARTITION BY id ORDER BY k) AS prev FROM l),
  b AS (SELECT *, sum(CASE WHEN {cut} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS block FROM f),
  w AS (SELECT id, block, {WORDS.format("string_agg(line, chr(10) ORDER BY k)")} AS w FROM b WHERE {kept} GROUP BY id, block),
  o AS (SELECT id, w, coalesce(sum(len(w)) OVER (PARTITION BY id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM w WHERE len(w) > 0),
  c AS (SELECT id, w, base, unnest(range(0, greatest(0, len(w) - 9) + 1, 24)) AS s FROM o)
SELECT id AS doc_id, (base + s)::BIGINT AS "offset", len(list_slice(w, s + 1, s + 32))::BIGINT AS tokens, array_to_string(list_slice(w, s + 1, s + 32), ' ') AS text FROM c"""


@register(_blocks_sql("# ", "```", "(line LIKE '```%' AND fences % 2 = 1) OR (line LIKE '#%' AND fences % 2 = 0) OR (prev LIKE '```%' AND (fences - CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) % 2 = 0)", "true"))
def chunk_markdown(spark, sf_dir):
    d = _marked(spark, sf_dir, "markdown", lambda l: F.concat(F.lit("# "), l), "```")
    return CH.chunks(d, 32, 8, parser="parser").select("doc_id", "offset", "tokens", "text")


@register(_blocks_sql("  def ", "", "ltrim(line) LIKE 'def %' OR trim(prev) = ''", "trim(line) <> ''"))
def chunk_code(spark, sf_dir):
    d = _marked(spark, sf_dir, "code", lambda l: F.concat(F.lit("  def "), l), "")
    return CH.chunks(d, 32, 8, parser="parser").select("doc_id", "offset", "tokens", "text")


@register(f"WITH {DOC_SQL} SELECT n AS doc_id, hash, id, sha256(id || ':0') AS chunk_id FROM doc")
def content_ids(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("n").alias("doc_id"), "hash", "id", X.chunk_id(F.col("id"), F.lit(0)).alias("chunk_id"))


@register(f"""WITH {DOC_SQL} SELECT n AS doc_id, '{{"lang":"' || tag || '","status":"' || source || '"}}' AS meta FROM doc""")
def meta_front_matter(spark, sf_dir):
    text = F.concat(F.lit("---\nStatus: open\nLang: "), F.col("tag"), F.lit("\nstatus: "), F.col("source"), F.lit("\n---\n"), F.col("text"))
    return docs(spark, sf_dir).select(F.col("n").alias("doc_id"), CH.metadata(text).alias("meta"))


@register(f"""WITH {DOC_SQL} SELECT n AS doc_id, '{{"doc_lang":"' || tag || '","owner":"","status":"active"}}' AS meta FROM doc""")
def meta_header(spark, sf_dir):
    text = F.concat(F.lit("\n# Title\n\nStatus: active\nDoc Lang: "), F.col("tag"), F.lit("\nOwner:\n\n"), F.col("text"))
    return docs(spark, sf_dir).select(F.col("n").alias("doc_id"), CH.metadata(text).alias("meta"))


@register(r"""SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(trim(head), '[^A-Za-z0-9 _-]', '', 'g'), '[ _-]+', '_', 'g'), '^_+|_+$', '', 'g')) AS key
  FROM (SELECT doc_id, coalesce(replace(text, chr(10), ' '), '') AS head FROM documents)""")
def meta_key_norm(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("n").alias("doc_id"), X.meta_key(F.replace("text", F.lit("\n"), F.lit(" "))).alias("key"))


@register(f"""WITH {DOC_SQL}, t AS (SELECT DISTINCT unnest({WORDS.format("text")}) AS token FROM doc),
  h AS (SELECT token, list_reduce(list_transform(range(8), lambda i: ('0x' || substr(sha256(token), (15 - 2 * i)::INT, 2))::UBIGINT::HUGEINT), lambda a, b: a * 256 + b) AS v FROM t)
SELECT token, (v % 256)::INTEGER AS idx, CASE WHEN v >= 9223372036854775808 THEN 1 ELSE -1 END::INTEGER AS sign FROM h""")
def hash_features(spark, sf_dir):
    place = HashEmbedder(256).place(F.col("token"))
    return docs(spark, sf_dir).select(F.explode(X.tokens(F.col("text"))).alias("token")).distinct().select("token", place["idx"].alias("idx"), place["sign"].alias("sign"))


PLACE_SQL = """place AS (SELECT token, (v % 256)::INTEGER AS idx, CASE WHEN v >= 9223372036854775808 THEN 1 ELSE -1 END AS sign FROM
    (SELECT token, list_reduce(list_transform(range(8), lambda i: ('0x' || substr(sha256(token), (15 - 2 * i)::INT, 2))::UBIGINT::HUGEINT), lambda a, b: a * 256 + b) AS v FROM
      (SELECT token FROM tok UNION SELECT token FROM asked)))"""


@register(f"""WITH {DOC_SQL}, tok AS (SELECT n AS id, unnest({WORDS.format("text")}) AS token FROM doc), asked AS (SELECT 'x' AS token), {PLACE_SQL},
  vec AS (SELECT id, idx, sum(sign)::DOUBLE AS x FROM tok JOIN place USING (token) GROUP BY id, idx),
  unit AS (SELECT id, idx, (x / sqrt(sum(x * x) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x FROM vec WHERE x <> 0)
SELECT n AS doc_id, coalesce(len(list(idx) FILTER (idx IS NOT NULL)), 0)::BIGINT AS n_places, round(coalesce(sum(x * (idx + 1)), 0), 2) + 0.0 AS checksum, round(coalesce(sum(abs(x)), 0), 2) AS total
FROM doc LEFT JOIN unit ON n = unit.id GROUP BY n""")
def hash_vector(spark, sf_dir):
    v = docs(spark, sf_dir).select(F.col("n").alias("doc_id"), HashEmbedder(256).column(X.tokens(F.col("text"))).alias("v"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    # adding 0.0 makes a sum of -0.0 a plain zero
    return v.select("doc_id", F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("n_places"), (F.round(add(F.transform("v", lambda x, i: x.cast("double") * (i + 1))), 2) + 0.0).alias("checksum"), F.round(add(F.transform("v", lambda x: F.abs(x.cast("double")))), 2).alias("total"))


# projection, filters, structured queries


def _asked(spark, sf_dir, source: str) -> DataFrame:
    return engine(spark, sf_dir).query(source).frame()


@register(f"""WITH {DOC_SQL} SELECT id AS doc_id, path AS doc_path, mtime AS doc_mtime, hash AS doc_hash, tag AS doc_tag, source AS doc_source, meta AS doc_meta,
  NULL::VARCHAR AS chunk_id, NULL::VARCHAR AS chunk_doc_id, NULL::BIGINT AS chunk_offset, NULL::BIGINT AS chunk_tokens, NULL::VARCHAR AS chunk_text FROM doc""")
def select_star_doc(spark, sf_dir):
    return _asked(spark, sf_dir, "FROM doc LIMIT 1000000000 SELECT *;")


@register(f"""WITH {CHUNK_SQL} SELECT path AS doc_path, "offset"::BIGINT AS chunk_offset, tokens::BIGINT AS chunk_tokens FROM chunk""")
def select_fields_chunk(spark, sf_dir):
    return _asked(spark, sf_dir, "FROM chunk LIMIT 1000000000 SELECT doc.path, chunk.offset, tokens;")


@register(f"WITH {DOC_SQL} SELECT path AS doc_path FROM doc")
def select_unknown_ignored(spark, sf_dir):
    return _asked(spark, sf_dir, "FROM doc LIMIT 1000000000 SELECT doc.path, doc.nothing, doc.text;")


def _filtered(spark, sf_dir, source: str, table: str = "doc") -> DataFrame:
    fields = "doc.path" if table == "doc" else "doc.path, chunk.offset"
    return _asked(spark, sf_dir, f"FROM {table} FILTER {source} LIMIT 1000000000 SELECT {fields};")


@register(f"""WITH {CHUNK_SQL} SELECT path AS doc_path, "offset"::BIGINT AS chunk_offset FROM chunk WHERE "offset" >= 224 AND tokens < 200 AND tag <> 'fr'""")
def filter_cmp(spark, sf_dir):
    return _filtered(spark, sf_dir, "chunk.offset >= 224 AND chunk.tokens < '200' AND doc.tag != 'fr'", "chunk")


@register(f"WITH {DOC_SQL} SELECT path AS doc_path FROM doc WHERE path ILIKE 'SRC1_/%/%7.txt'")
def filter_like(spark, sf_dir):
    return _filtered(spark, sf_dir, "doc.path LIKE 'SRC1_/%/%7.TXT'")


@register(f"WITH {DOC_SQL} SELECT path AS doc_path FROM doc WHERE path GLOB 'src[1-3]*/e?/*[05].txt'")
def filter_glob(spark, sf_dir):
    return _filtered(spark, sf_dir, "doc.path GLOB 'src[1-3]*/e?/*[05].txt'")


@register(f"WITH {DOC_SQL} SELECT path AS doc_path FROM doc WHERE tag IN ('de', 'es')")
def filter_in(spark, sf_dir):
    return _filtered(spark, sf_dir, "doc.tag IN ('de', \"es\", 5)")


@register(f"WITH {DOC_SQL} SELECT path AS doc_path FROM doc WHERE NOT tag = 'en' AND source = 'src2' OR mtime >= '2024-01-27T00:00:00Z' AND NOT (source = 'src1' OR source = 'src3')")
def filter_bool(spark, sf_dir):
    return _filtered(spark, sf_dir, "NOT doc.tag = 'en' AND doc.source = 'src2' OR doc.mtime >= '2024-01-27T00:00:00Z' AND NOT (doc.source = 'src1' OR doc.source = 'src3')")


@register(f"WITH {DOC_SQL} SELECT path AS doc_path FROM doc WHERE meta->>'$.lang' = 'de' AND meta->>'$.n_chars' > '2000'")
def filter_meta(spark, sf_dir):
    return _filtered(spark, sf_dir, "doc.meta.lang = 'de' AND doc.meta.n_chars > '2000' AND doc.meta.n_chars > 9999999 AND NOT doc.meta.n_chars = 5")


@register(f"""WITH {CHUNK_SQL}, dead AS (SELECT id FROM doc WHERE n % 3 = 0) SELECT path AS doc_path, "offset"::BIGINT AS chunk_offset FROM chunk WHERE doc_id NOT IN (SELECT id FROM dead)""")
def filter_live(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("deleted", F.col("n") % 3 == 0)
    e = Engine(Corpus(d.select(*DOC.fieldNames()), CH.chunk_documents(d, SIZE, OVERLAP)))
    return e.query("FROM chunk LIMIT 1000000000 SELECT doc.path, chunk.offset").frame()


@register(f"WITH {DOC_SQL} SELECT path AS doc_path FROM doc WHERE mtime <= '2024-01-10T00:00:00Z'")
def snapshot_filter(spark, sf_dir):
    return engine(spark, sf_dir).query("FROM doc LIMIT 1000000000 SELECT doc.path", snapshot="2024-01-10T00:00:00Z").frame()


@register(f"WITH {DOC_SQL} SELECT path AS doc_path, tag AS doc_tag, meta->>'$.n_chars' AS doc_meta_n_chars FROM doc WHERE tag = 'de'")
def select_first(spark, sf_dir):
    return _asked(spark, sf_dir, "SELECT doc.path, tag, doc.meta.n_chars FROM doc FILTER doc.tag = 'de' LIMIT 1000000000")


@register(f"WITH {DOC_SQL} SELECT path AS doc_path FROM doc WHERE tag = 'es' AND NOT source = 'src2'")
def filter_from_file(spark, sf_dir):
    with tempfile.NamedTemporaryFile("w", suffix=".txt") as file:  # read by this process at once
        file.write("doc.tag = 'es' AND NOT doc.source = 'src2'\n")
        file.flush()
        where = parse_filter(at_file(f"@{file.name}"))
    rows = R.structured(corpus(spark, sf_dir), Query(select=None, table="doc", filter=where, limit=10**9))
    return rows.select(F.col("doc.path").alias("doc_path"))


# joins


@register(f"""WITH {CHUNK_SQL} SELECT doc.path, chunk.id, chunk."offset"::BIGINT AS "offset" FROM chunk JOIN doc ON doc.id = chunk.doc_id""")
def join_chunk_doc(spark, sf_dir):
    return R.joined(corpus(spark, sf_dir)).select("doc.path", "chunk.id", "chunk.offset")


@register(f"""WITH {CHUNK_SQL} SELECT id FROM chunk WHERE "offset" >= 448""")
def anti_missing_index(spark, sf_dir):
    chunk = corpus(spark, sf_dir).chunk
    index = chunk.where(F.col("offset") < 448).select(F.col("id").alias("indexed"))
    return chunk.join(index, F.col("id") == F.col("indexed"), "left_anti").select("id")


# full text


def _matching(spark, sf_dir, text: str) -> DataFrame:
    """All chunks that match, with their scores."""
    index = ingested(spark, sf_dir).index
    return PT.search(index, FT.parse(text)).join(index.rows.select("n", "id"), "n").select("id", F.round("bm25", 5).alias("bm25"))


def _lex_sql(where: str, *counts: str) -> str:
    """Matching chunks and BM25; ``counts`` are occurrences of each phrase that counts where the row matches."""
    n = range(len(counts))
    idf = [f"greatest(ln(((SELECT count(*) FROM terms) - d{i} + 0.5) / (d{i} + 0.5)), 1e-6)" for i in n]
    parts = [f"{idf[i]} * (f{i} * 2.2::DOUBLE) / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in n]
    return f"""WITH {CHUNK_SQL}, tf AS (SELECT id, t, len(t)::DOUBLE AS dl, {", ".join(f"({c})::DOUBLE AS f{i}" for i, c in enumerate(counts))} FROM terms),
  s AS (SELECT avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (f{i} > 0)::DOUBLE AS d{i}" for i in n)} FROM tf)
SELECT id, round(-({" + ".join(parts)}), 5) AS bm25 FROM tf, s WHERE {where}"""


def _tf(word: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{word}'))"


_PREFIX = "len(list_filter(t, lambda x: starts_with(x, 'thre')))"
_PAIR = "len(list_filter(range(1, len(t)::BIGINT), lambda i: t[i] = 'of' AND t[i + 1] = 'the'))"


@register(_lex_sql("f0 > 0 AND f1 > 0", _tf("with"), _tf("was")))
def lex_and(spark, sf_dir):
    return _matching(spark, sf_dir, "with AND was")


@register(_lex_sql("f0 > 0 OR f1 > 0", _tf("pour"), _tf("nicht")))
def lex_or(spark, sf_dir):
    return _matching(spark, sf_dir, "pour OR nicht")


@register(_lex_sql(f"f0 > 0 AND NOT {_tf('from')} > 0", _tf("with")))
def lex_not(spark, sf_dir):
    return _matching(spark, sf_dir, "with NOT from")


@register(_lex_sql("f0 > 0", _PAIR))
def lex_phrase(spark, sf_dir):
    return _matching(spark, sf_dir, '"of the"')


@register(_lex_sql("f0 > 0", _PREFIX))
def lex_prefix(spark, sf_dir):
    return _matching(spark, sf_dir, "thre*")


@register(f"""WITH {CHUNK_SQL}, found AS ({_lex_sql("f0 > 0 OR f1 > 0", _tf("idiot"), _tf("trash"))})
SELECT path, "offset"::BIGINT AS "offset", 1.0::DOUBLE AS score FROM chunk JOIN found USING (id) ORDER BY bm25, path, "offset", id LIMIT 20""")
def lex_bm25_topk(spark, sf_dir):
    rows = searcher(spark, sf_dir).search("idiot OR trash", 20, bm25=True).rows
    return rows.select("doc.path", "chunk.offset", F.col("score").cast("double").alias("score"))


@register(f"""WITH {CHUNK_SQL}, found AS ({_lex_sql("f0 > 0 AND f1 > 0", _tf("stupid"), _tf("the"))})
SELECT path, "offset"::BIGINT AS "offset", 1.0::DOUBLE AS score FROM chunk JOIN found USING (id) ORDER BY bm25, path, "offset", id LIMIT 20""")
def lex_sanitized(spark, sf_dir):
    rows = searcher(spark, sf_dir).search("stupid, the?", 20, bm25=True).rows
    return rows.select("doc.path", "chunk.offset", F.col("score").cast("double").alias("score"))


@register(f"""WITH {CHUNK_SQL} SELECT id FROM terms WHERE len(list_filter(range(1, len(t)::BIGINT + 1), lambda i: t[i] = 'with' AND list_contains(t[greatest(1, i - 4):i + 4], 'of'))) > 0""")
def lex_near(spark, sf_dir):
    return _matching(spark, sf_dir, "NEAR(with of, 3)").select("id")


@register(f"WITH {CHUNK_SQL} SELECT id FROM terms WHERE t[1] = 'the' OR (t[1] = 'of' AND t[2] = 'the')")
def lex_first(spark, sf_dir):
    return _matching(spark, sf_dir, "^the OR ^of + the").select("id")


@register(_lex_sql("f0 > 0", _PAIR))
def lex_plus(spark, sf_dir):
    return _matching(spark, sf_dir, "of + the")


@register(_lex_sql("f0 > 0 AND NOT f1 > 0", _tf("with"), "0"))
def lex_column(spark, sf_dir):
    return _matching(spark, sf_dir, "text : with")


@register(f"""WITH {CHUNK_SQL}, found AS ({_lex_sql("f0 > 0 AND f1 > 0", _tf("stupid"), _tf("the"))})
SELECT path, "offset"::BIGINT AS "offset", 1.0::DOUBLE AS score FROM chunk JOIN found USING (id) ORDER BY bm25, path, "offset", id LIMIT 20""")
def lex_literal(spark, sf_dir):
    rows = searcher(spark, sf_dir).search('"stupid" - the!', 20, bm25=True, literal=True).rows
    return rows.select("doc.path", "chunk.offset", F.col("score").cast("double").alias("score"))


def _found_sql(k: int, rest: str) -> str:
    """The ``k`` best chunks with the word "with" as ``top``, then ``rest``."""
    return f"""WITH {CHUNK_SQL}, found AS ({_lex_sql("f0 > 0", _tf("with"))}), top AS (SELECT chunk.* FROM chunk JOIN found USING (id) ORDER BY bm25, path, "offset", id LIMIT {k}) {rest}"""


@register(_found_sql(25, """SELECT path AS doc_path, "offset"::BIGINT AS chunk_offset, tokens::BIGINT AS chunk_tokens FROM top ORDER BY tokens, path, "offset", id LIMIT 15 OFFSET 10"""))
def scored_order(spark, sf_dir):
    return searcher(spark, sf_dir).query("FROM chunk USING lexical('with') ORDER BY chunk.tokens ASC LIMIT 15 OFFSET 10 SELECT doc.path, chunk.offset, chunk.tokens").frame()


@register(_found_sql(50, """SELECT 1.0::DOUBLE AS score, path AS doc_path, "offset"::BIGINT AS chunk_offset FROM top ORDER BY path, "offset", id LIMIT 30 OFFSET 20"""))
def scored_page(spark, sf_dir):
    found = searcher(spark, sf_dir).query("FROM chunk USING lexical('with') LIMIT 30 OFFSET 20 SELECT score, doc.path, chunk.offset").frame()
    return found.withColumn("score", F.col("score").cast("double"))


@register(_found_sql(40, """SELECT 1.0::DOUBLE AS score, doc.id AS doc_id, doc.path AS doc_path, mtime AS doc_mtime, hash AS doc_hash, doc.tag AS doc_tag, source AS doc_source, meta AS doc_meta,
  top.id AS chunk_id, top.doc_id AS chunk_doc_id, "offset"::BIGINT AS chunk_offset, tokens::BIGINT AS chunk_tokens, top.text AS chunk_text FROM top JOIN doc ON doc.id = top.doc_id"""))
def select_default(spark, sf_dir):
    found = searcher(spark, sf_dir).search("with", 40, bm25=True).frame()
    return found.withColumn("score", F.col("score").cast("double"))


@register(_found_sql(20, """SELECT '1.000' || chr(9) || path || chr(9) || "offset"::VARCHAR || chr(9) || text AS line FROM top"""))
def output_table(spark, sf_dir):
    rows = searcher(spark, sf_dir).search("with", 20, bm25=True).rows.collect()  # a page for people
    return spark.createDataFrame([(x,) for x in OUT.table(rows, explain=True).split("\n")] if rows else [], "line string")


@register(_found_sql(20, """SELECT 'result' AS type, path, "offset"::BIGINT AS "offset", text FROM top UNION ALL SELECT 'meta', NULL, NULL, NULL"""))
def output_jsonl(spark, sf_dir):
    answer = searcher(spark, sf_dir).search("with", 20, bm25=True).json()
    found = spark.createDataFrame([(x,) for x in OUT.json_lines(answer)], "line string")
    at = lambda path: F.get_json_object("line", path)
    return found.select(at("$.type").alias("type"), at("$.doc.path").alias("path"), at("$.chunk.offset").cast("long").alias("offset"), at("$.chunk.text").alias("text"))


@register(_found_sql(60, """SELECT least(10, (SELECT count(DISTINCT path) FROM top))::BIGINT AS returned, count(*)::BIGINT AS total_hits, 'lexical' AS mode FROM top"""))
def search_stats(spark, sf_dir):
    # the 60 best chunks are found for 10 documents after 50
    found = searcher(spark, sf_dir).query("FROM doc USING lexical('with') LIMIT 60 SELECT doc.path")
    answer = Engine(ingested(spark, sf_dir), Config(max_limit=60)).query("FROM doc USING lexical('with') SELECT doc.path").json(explain=True)
    returned = min(10, answer["stats"]["returned"])
    return spark.createDataFrame([(returned, found.hits(), answer["explain"]["mode"])], "returned long, total_hits long, mode string")


# vectors, fusion, paging


def _hashed_sql(tokens: list[str]) -> str:
    """``near``: chunks with their similarity to hashed tokens."""
    return f"""tok AS (SELECT id, unnest(string_split(text, ' ')) AS token FROM chunk), asked AS (SELECT unnest({tokens}) AS token), {PLACE_SQL},
  vec AS (SELECT id, idx, sum(sign)::DOUBLE AS x FROM tok JOIN place USING (token) GROUP BY id, idx),
  unit AS (SELECT id, idx, (x / sqrt(sum(x * x) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x FROM vec WHERE x <> 0),
  q AS (SELECT idx, (y / sqrt(sum(y * y) OVER ()))::FLOAT::DOUBLE AS y FROM (SELECT idx, sum(sign)::DOUBLE AS y FROM asked JOIN place USING (token) GROUP BY idx) WHERE y <> 0),
  dots AS (SELECT id, round(sum(x * coalesce(y, 0)) / sqrt(sum(x * x)) / (SELECT sqrt(sum(y * y)) FROM q), 12) AS s FROM unit LEFT JOIN q USING (idx) GROUP BY id),
  near AS (SELECT chunk.*, s FROM chunk JOIN dots USING (id))"""


@register(f"""WITH {CHUNK_SQL}, {_hashed_sql(["with", "of", "the"])} SELECT path AS doc_path, "offset"::BIGINT AS chunk_offset, round(s::FLOAT::DOUBLE, 4) AS score FROM near ORDER BY s DESC, doc_id, "offset", id LIMIT 25""")
def knn_hashed_text(spark, sf_dir):
    found = searcher(spark, sf_dir).query("FROM chunk USING semantic('with of the') LIMIT 25 SELECT score, doc.path, chunk.offset").frame()
    return found.withColumn("score", F.round(F.col("score").cast("double"), 4))


def _fused_sql(k: int) -> str:
    """``fused``: the ``k`` best chunks with "with" or "was", and the ``k`` nearest to these words."""
    return f"""WITH {CHUNK_SQL}, {_hashed_sql(["with", "OR", "was"])}, found AS ({_lex_sql("f0 > 0 OR f1 > 0", _tf("with"), _tf("was"))}),
  lx AS (SELECT chunk.* FROM chunk JOIN found USING (id) ORDER BY bm25, path, "offset", id LIMIT {k}), sx AS (SELECT * FROM near ORDER BY s DESC, doc_id, "offset", id LIMIT {k}),
  fused AS (SELECT coalesce(lx.id, sx.id) AS id, (CASE WHEN lx.id IS NULL THEN 0 ELSE 0.5 END + coalesce(s, 0) * 0.5)::FLOAT AS score FROM lx FULL JOIN sx USING (id))"""


@register(_fused_sql(30) + """ SELECT * FROM (SELECT 'full text' AS mode, path, "offset"::BIGINT AS "offset", 1.0::DOUBLE AS score FROM lx)
  UNION ALL SELECT * FROM (SELECT 'vectors', path, "offset"::BIGINT, round(s::FLOAT::DOUBLE, 4) FROM sx)
  UNION ALL SELECT * FROM (SELECT 'both', path, "offset"::BIGINT, round(score::DOUBLE, 4) FROM fused JOIN chunk USING (id) ORDER BY fused.score DESC, path, "offset", id LIMIT 30)""")
def search_flags(spark, sf_dir):
    e = searcher(spark, sf_dir)
    found = [e.search("with OR was", 30, **flags).rows.select(F.lit(mode).alias("mode"), "doc.path", "chunk.offset", F.round(F.col("score").cast("double"), 4).alias("score")) for mode, flags in (("full text", {"bm25": True}), ("vectors", {"vector": True}), ("both", {}))]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _semantic(spark, sf_dir, k: int, where: str | None = None) -> DataFrame:
    rows = R.semantic(vector_corpus(spark, sf_dir), query_vector(spark, sf_dir), k, parse_filter(where) if where else None)
    return rows.select("doc.path", _round("score"))


@register(f"WITH {VECTOR_SQL} SELECT path, round(s::DOUBLE, 5) AS score FROM near ORDER BY s DESC, path LIMIT 10")
def knn_cosine(spark, sf_dir):
    return _semantic(spark, sf_dir, 10)


@register(f"WITH {VECTOR_SQL}, top AS (SELECT * FROM near ORDER BY s DESC, path LIMIT 64) SELECT path, round(s::DOUBLE, 5) AS score FROM top WHERE tag = 'de' ORDER BY s DESC, path LIMIT 30")
def knn_postfilter(spark, sf_dir):
    return _semantic(spark, sf_dir, 30, "doc.tag = 'de'")


@register(f"WITH {VECTOR_SQL}, top AS (SELECT * FROM near ORDER BY s DESC, path LIMIT 100) SELECT path, round(s::DOUBLE, 5) AS score FROM top WHERE tag <> 'en' ORDER BY s DESC, path LIMIT 100")
def knn_candidate_widen(spark, sf_dir):
    return _semantic(spark, sf_dir, 100, "doc.tag != 'en'")


_LEX_V = f"""lx AS (SELECT id, path, doc_id, -(ln(greatest((n - d + 0.5) / (d + 0.5), 1)) * 0 + i * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))) AS b FROM
    (SELECT *, greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) AS i FROM (SELECT id, path, doc_id, len(t)::DOUBLE AS dl, {_tf("with")}::DOUBLE AS f FROM chunk),
    (SELECT count(*)::DOUBLE AS n, avg(len(t)::DOUBLE) AS a, count(*) FILTER ({_tf("with")} > 0)::DOUBLE AS d FROM chunk)) WHERE f > 0 ORDER BY b, path, id LIMIT 40),
  sx AS (SELECT id, path, doc_id, s FROM near ORDER BY s DESC, path LIMIT 40),
  fused AS (SELECT coalesce(lx.id, sx.id) AS id, coalesce(lx.path, sx.path) AS path, CASE WHEN lx.id IS NULL THEN 0 ELSE 0.5 END::FLOAT + coalesce(s, 0)::FLOAT * 0.5::FLOAT AS score, lx.id IS NOT NULL AS l, s FROM lx FULL JOIN sx USING (id))"""


def _hybrid(spark, sf_dir, text: str, k: int) -> DataFrame:
    c, v = vector_corpus(spark, sf_dir), query_vector(spark, sf_dir)
    return R.fuse(R.lexical(c, text, k).rows, R.semantic(c, v, k), 0.5, 0.5)


@register(f"WITH {VECTOR_SQL}, {_LEX_V} SELECT path, l AS in_lexical, round(s::DOUBLE, 5) AS semantic, round(score::DOUBLE, 5) AS score FROM fused")
def fusion_full_outer(spark, sf_dir):
    return _hybrid(spark, sf_dir, "with", 40).select("doc.path", F.col("lexical").isNotNull().alias("in_lexical"), _round("semantic"), _round("score"))


@register(f"WITH {VECTOR_SQL}, {_LEX_V} SELECT path, round(score::DOUBLE, 5) AS score FROM fused ORDER BY fused.score DESC, path LIMIT 40")
def hybrid_topk(spark, sf_dir):
    return R.page(R.reorder(_hybrid(spark, sf_dir, "with", 40), None, "chunk"), 40).select("doc.path", _round("score"))


@register(f"WITH {VECTOR_SQL} SELECT path, round(s::DOUBLE, 5) AS score FROM near ORDER BY s DESC, path LIMIT 25")
def hybrid_lex_empty_passthrough(spark, sf_dir):
    return R.page(R.reorder(_hybrid(spark, sf_dir, "nosuchword", 25), None, "chunk"), 25).select("doc.path", _round("score"))


@register(f"""WITH {CHUNK_SQL}, found AS ({_lex_sql("f0 > 0", _tf("with"))}), top AS (SELECT chunk.* FROM chunk JOIN found USING (id) ORDER BY bm25, path, "offset", id LIMIT 60)
SELECT path, min("offset")::BIGINT AS "offset", 1.0::DOUBLE AS score FROM top GROUP BY path ORDER BY path LIMIT 60""")
def doc_group_max(spark, sf_dir):
    rows = searcher(spark, sf_dir).query("FROM doc USING lexical('with') LIMIT 60 SELECT score, doc.path").rows
    return rows.select("doc.path", "chunk.offset", F.col("score").cast("double").alias("score"))


@register(f"WITH {DOC_SQL} SELECT path AS doc_path, row_number() OVER (ORDER BY path, id) AS place FROM doc ORDER BY path, id LIMIT 1000")
def order_default_doc(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = engine(spark, sf_dir).query("FROM doc SELECT doc.path").rows
    return rows.select(F.col("doc.path").alias("doc_path"), F.row_number().over(W.partitionBy().orderBy("doc.path", "doc.id")).cast("long").alias("place"))


@register(f"WITH {DOC_SQL} SELECT path AS doc_path, tag AS doc_tag FROM doc ORDER BY tag DESC, path, id LIMIT 100")
def order_by_field_desc_default(spark, sf_dir):
    return _asked(spark, sf_dir, "FROM doc ORDER BY doc.tag LIMIT 100 SELECT doc.path, doc.tag")


@register(f"""WITH {CHUNK_SQL} SELECT path AS doc_path, "offset"::BIGINT AS chunk_offset FROM chunk ORDER BY path, "offset", id LIMIT 50 OFFSET 25""")
def limit_offset(spark, sf_dir):
    return _asked(spark, sf_dir, "FROM chunk LIMIT 50 OFFSET 25 SELECT doc.path, chunk.offset")


# aggregates


@register(f"""WITH {CHUNK_SQL} SELECT (SELECT count(*) FROM doc)::BIGINT AS docs, count(*)::BIGINT AS chunks, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM chunk""")
def corpus_stats(spark, sf_dir):
    c = corpus(spark, sf_dir)
    n = c.doc.where(~F.col("deleted")).count()
    return c.chunk.where(~F.col("deleted")).agg(F.lit(n).cast("long").alias("docs"), F.count("*").alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0).cast("long")).alias("tokens"))


@register(f"WITH {DOC_SQL} SELECT coalesce(max(mtime), '') AS token FROM doc")
def snapshot_token(spark, sf_dir):
    return corpus(spark, sf_dir).doc.where(~F.col("deleted")).agg(F.coalesce(F.max("mtime"), F.lit("")).alias("token"))


# contexts


def _packed(spark, sf_dir, budget: int, diversity: int | None = None) -> DataFrame:
    rows = searcher(spark, sf_dir).search("with", C.RETRIEVED, bm25=True).rows
    return C.pack(ranked(rows), budget, diversity)


def _pack_sql(budget: int, diversity: int = 1_000_000) -> str:
    return f"""WITH {CHUNK_SQL}, found AS ({_lex_sql("f0 > 0", _tf("with"))}), top AS (SELECT chunk.* FROM chunk JOIN found USING (id) ORDER BY bm25, path, "offset", id LIMIT 100),
  r AS (SELECT *, row_number() OVER (ORDER BY path, "offset", id) AS rank FROM top),
  v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS place FROM r) WHERE place <= {diversity}),
  p AS (SELECT *, {budget} - coalesce(sum(tokens) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM v)
SELECT rank::BIGINT AS rank, path, "offset"::BIGINT AS "offset", least(tokens, room)::BIGINT AS tokens, CASE WHEN tokens <= room THEN text ELSE array_to_string(list_slice(string_split(text, ' '), 1, room::BIGINT), ' ') END AS text
FROM p WHERE room > 0"""


def _pack_columns(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("rank").cast("long").alias("rank"), "doc.path", "chunk.offset", F.col("tokens").cast("long").alias("tokens"), "text")


@register(_pack_sql(1200))
def context_pack(spark, sf_dir):
    return _pack_columns(_packed(spark, sf_dir, 1200))


@register(_pack_sql(4000, 1))
def context_diversity(spark, sf_dir):
    return _pack_columns(_packed(spark, sf_dir, 4000, 1))


@register(_pack_sql(100))
def context_truncate(spark, sf_dir):
    return _pack_columns(_packed(spark, sf_dir, 100))


@register(_pack_sql(1200).replace("SELECT rank::BIGINT AS rank, path,", "SELECT string_agg(CASE WHEN tokens <= room THEN text ELSE array_to_string(list_slice(string_split(text, ' '), 1, room::BIGINT), ' ') END, chr(10) || chr(10) ORDER BY rank) AS text, sum(least(tokens, room))::BIGINT AS used_tokens, count(*)::BIGINT AS parts --"))
def context_render(spark, sf_dir):
    return C.render(_packed(spark, sf_dir, 1200)).select("text", F.col("used_tokens").cast("long").alias("used_tokens"), F.size("chunks").cast("long").alias("parts"))


@register(_fused_sql(100) + """, r AS (SELECT chunk.*, row_number() OVER (ORDER BY fused.score DESC, path, "offset", chunk.id) AS rank FROM fused JOIN chunk USING (id) QUALIFY rank <= 100),
  p AS (SELECT *, 1200 - coalesce(sum(tokens) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM r)
SELECT rank::BIGINT AS rank, path, "offset"::BIGINT AS "offset", least(tokens, room)::BIGINT AS tokens, CASE WHEN tokens <= room THEN text ELSE array_to_string(list_slice(string_split(text, ' '), 1, room::BIGINT), ' ') END AS text FROM p WHERE room > 0""")
def context_hybrid(spark, sf_dir):
    return _pack_columns(searcher(spark, sf_dir).packed("with OR was", 1200))


# the store


def _filled(spark, sf_dir, gone: bool) -> ST.Store:
    """A new store with all documents; with ``gone``, every seventh is removed again."""
    store = ST.Store.create(spark, _folder(spark), HashEmbedder(16))
    d = docs(spark, sf_dir)
    store.upsert(d.withColumn("parser", F.lit("plain")), Config(embedding_dim=16))
    if gone:
        store.remove([r["id"] for r in d.where(F.col("n") % 7 == 0).select("id").collect()])
    return store


@register(f"WITH {DOC_SQL} SELECT id, path, n % 7 = 0 AS deleted FROM doc")
def store_rm(spark, sf_dir):
    return _filled(spark, sf_dir, True).corpus().doc.select("id", "path", "deleted")


@register(f"""WITH {CHUNK_SQL} SELECT chunk.id, chunk."offset"::BIGINT AS "offset", tokens::BIGINT AS tokens, false AS deleted FROM chunk JOIN doc ON doc.id = chunk.doc_id WHERE n % 7 <> 0""")
def store_compact(spark, sf_dir):
    store = _filled(spark, sf_dir, True)
    store.compact()
    return store.corpus().chunk.select("id", "offset", "tokens", "deleted")


@register(f"""WITH {CHUNK_SQL} SELECT (SELECT count(*) FROM doc)::BIGINT AS docs, count(*)::BIGINT AS chunks, sum(tokens)::BIGINT AS tokens, (SELECT max(mtime) FROM doc) AS snapshot, true AS has_bytes FROM chunk""")
def store_stats(spark, sf_dir):
    s = ST.Store.open(spark, _filled(spark, sf_dir, False).path, HashEmbedder(16)).stats()
    return spark.createDataFrame([(s["docs"], s["chunks"], s["tokens"], s["snapshot"], s["bytes"] > 0)], "docs long, chunks long, tokens long, snapshot string, has_bytes boolean")


@register(f"""WITH {CHUNK_SQL}, bad AS (SELECT chunk.* FROM chunk JOIN doc ON doc.id = chunk.doc_id WHERE n % 5 = 0) SELECT count(*)::VARCHAR || ' chunks without a vector' AS problem FROM bad""")
def store_doctor(spark, sf_dir):
    store = _filled(spark, sf_dir, False)
    c = store.corpus()
    bad = c.doc.where(F.substring("path", -5, 1).isin("0", "5")).select(F.col("id").alias("bad"))
    store.replace(c.doc, c.chunk.join(bad, F.col("doc_id") == F.col("bad"), "left").withColumn("embedding", F.when(F.col("bad").isNull(), F.col("embedding"))).drop("bad"))
    return spark.createDataFrame([(x,) for x in store.doctor()], "problem string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over hashed vectors, packed into a context."""
    return _pack_columns(searcher(spark, sf_dir).packed("with OR was", 1200))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
