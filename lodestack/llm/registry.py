"""The queries of this folder, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, html, language, licenses, passages, quality, similar, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    found = chat.format_chats(chat.transcripts(turns), chat.learn(turns))
    return found.select("conv_id", "block", F.size("turns").cast("long").alias("n_turns"), "n_lines", chat.roles_of().alias("roles"), "rendered")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs, ~held_out()))
    return found.withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


def tokenizer_file(spark: SparkSession) -> str:
    """The byte-level vocabulary: the setting ``spark.lodestack.tokenizer``, else the file of the public tokenizers."""
    path = spark.conf.get("spark.lodestack.tokenizer", None)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_file(spark), extras=())


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents")).drop("name")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar(_table(spark, sf_dir, "documents"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of ``op3_quality_rules``, which SQL can say; the verdict of the method it can't."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact phrases of ``op6_license_scan``, which SQL can say; the fuzzy ones it can't."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_extraction, op2_chat_formatting, op3_quality_rules, op4_language_id, op5_bpe_encode_decode, op6_license_scan, op7_substring_dedup, op8_toxicity, op9_benchmark_decontamination, op10_ngram_jaccard_join, quality_base, license_base)
}
_SPACED = r"[^\x20\x09-\x0D]"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES: dict[str, str] = {
    "quality_base": f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
  w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_SPACED}+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS l FROM d),
  win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w)::BIGINT - 1)) AS i FROM w)),
  rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
  n AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) t(k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN n USING (r)""",
    "license_base": f"""WITH w AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
  p AS (SELECT *, list_filter(range(1, len(w)::BIGINT), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS m, list_filter(range(1, len(w)::BIGINT), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS a,
    list_filter(range(1, len(w)::BIGINT - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g FROM w)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(m) + len(a) + len(g))::BIGINT AS n_base, (list_min(m || a || g) - 1)::BIGINT AS first_word, (list_max(m || a || g) - 1)::BIGINT AS last_word,
  concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels FROM p""",
    "op9_benchmark_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
  item AS (SELECT DISTINCT item, least(len(w), 10) AS s, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w)::BIGINT - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  win AS (SELECT r, i, s, array_to_string(list_slice(w, i, i + s - 1), ' ') AS g FROM (SELECT r, w, s, unnest(range(1, len(w)::BIGINT - s + 2)) AS i FROM d, (SELECT DISTINCT s FROM item))),
  found AS (SELECT r, i, s, item FROM win JOIN item USING (s, g)), place AS (SELECT DISTINCT r, unnest(range(i, i + s)) AS k FROM found), hit AS (SELECT r, count(*) AS n FROM place GROUP BY r),
  own AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(own.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)""",
    "op10_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_SPACED}+') AS w FROM documents),
  sh AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w)::BIGINT - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  size AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
  pair AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
  link AS (SELECT x, y FROM pair JOIN size p ON p.r = x JOIN size q ON q.r = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
  edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
  reach AS (SELECT x, y FROM edge UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x),
  near AS (SELECT x AS r, count(*) AS n FROM edge GROUP BY x), least AS (SELECT x AS r, min(doc_id) AS component FROM reach JOIN d ON d.r = y GROUP BY x)
SELECT doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, coalesce(near.n, 0)::BIGINT AS n_similar, least(doc_id, coalesce(component, doc_id)) AS component_id
FROM d LEFT JOIN size USING (r) LEFT JOIN near USING (r) LEFT JOIN least USING (r)""",
}
