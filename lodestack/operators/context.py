"""The best chunks packed into a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: Chunks that are retrieved for a context.
RETRIEVED = 100
BUDGET = 1200


def pack(rows: DataFrame, budget: int = BUDGET, diversity: int | None = None) -> DataFrame:
    """(rank, doc, chunk, tokens, text) of the chunks that fit, best first.

    ``rows`` are few (a search's result) and have a total order by ``rank``. A chunk that comes again is left out, as are
    those beyond ``diversity`` of one document. Chunks are taken whole while they fit; the one that doesn't gives its first
    tokens, and nothing follows it.
    """
    again = W.partitionBy("chunk.id").orderBy("rank")
    rows = rows.withColumn("copy", F.row_number().over(again)).where(F.col("copy") == 1).drop("copy")
    rows = rows.withColumn("words", X.tokens(F.col("chunk.text"))).where(F.size("words") > 0)
    if diversity is not None:
        own = W.partitionBy("doc.id").orderBy("rank")
        rows = rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= diversity).drop("place")
    before = W.partitionBy().orderBy("rank").rowsBetween(W.unboundedPreceding, -1)  # a search's result, at most RETRIEVED rows
    rows = rows.withColumn("left", F.lit(budget) - F.coalesce(F.sum(F.size("words")).over(before), F.lit(0))).where(F.col("left") > 0)
    fits = F.size("words") <= F.col("left")
    text = F.when(fits, F.col("chunk.text")).otherwise(F.array_join(F.slice("words", 1, F.greatest(F.col("left"), F.lit(1)).cast("int")), " "))
    return rows.select("rank", "doc", "chunk", F.least(F.size("words").cast("long"), F.col("left")).alias("tokens"), text.alias("text"))


def render(packed: DataFrame) -> DataFrame:
    """One row: the texts joined by blank lines, the tokens used, and where each comes from."""
    part = F.struct("rank", "text", F.struct(F.col("chunk.id").alias("id"), F.col("doc.id").alias("doc_id"), F.col("chunk.offset").alias("offset"), "tokens", "text", F.col("doc.path").alias("path"), F.col("doc.hash").alias("hash"), F.col("doc.mtime").alias("mtime")).alias("chunk"))
    own = packed.agg(F.array_sort(F.collect_list(part)).alias("parts"), F.coalesce(F.sum("tokens"), F.lit(0).cast("long")).alias("used_tokens"))
    return own.select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"), "used_tokens", F.transform("parts", lambda p: p["chunk"]).alias("chunks"))
