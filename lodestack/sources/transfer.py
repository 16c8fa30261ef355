"""Stores as JSON lines: one line per live document, then one per live chunk."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schema import CHUNK, DOC, Corpus

LINE = "type string, id string, path string, mtime string, size long, hash string, tag string, source string, meta string, doc_id string, offset long, tokens long, text string, embedding string"


@F.pandas_udf(T.StringType())
def _encode(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _decode(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else np.frombuffer(base64.b64decode(t), "<f4"))


def doc_lines(doc: DataFrame) -> DataFrame:
    """(value) of live documents; absent tag, source and metadata have no key."""
    return doc.where(~F.col("deleted")).select(F.to_json(F.struct(F.lit("doc").alias("type"), "id", "path", "mtime", "size", "hash", "tag", "source", "meta")).alias("value"))


def chunk_lines(chunk: DataFrame) -> DataFrame:
    return chunk.where(~F.col("deleted")).select(F.to_json(F.struct(F.lit("chunk").alias("type"), "id", "doc_id", "offset", "tokens", "text", _encode("embedding").alias("embedding"))).alias("value"))


def export(corpus: Corpus, path: str) -> None:
    """Write both kinds of lines; each kind is sorted by id, and documents come first."""
    rows = doc_lines(corpus.doc).withColumn("kind", F.lit(0)).unionByName(chunk_lines(corpus.chunk).withColumn("kind", F.lit(1)))
    rows.orderBy("kind", F.get_json_object("value", "$.id")).select("value").write.text(path)


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc rows, chunk rows) of lines (value, and optionally their order ``n``). Blank lines are skipped, a bad one fails
    the job, and of rows with one id the last counts."""
    order = F.col("n") if "n" in lines.columns else F.lit(0)
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", LINE, {"mode": "FAILFAST"}).alias("x"), order.alias("n"))
    kind = F.col("x.type")
    rows = rows.where(F.when(kind.isin("doc", "chunk"), True).otherwise(F.raise_error(F.concat(F.lit("not a doc or chunk line: "), F.coalesce(kind, F.lit("null")))).cast("boolean")))
    last = W.partitionBy("x.type", "x.id").orderBy(F.col("n").desc())
    rows = rows.withColumn("place", F.row_number().over(last)).where(F.col("place") == 1)
    doc = rows.where(kind == "doc").select("x.id", "x.path", "x.mtime", "x.size", "x.hash", "x.tag", "x.source", "x.meta", F.lit(False).alias("deleted"))
    chunk = rows.where(kind == "chunk").select("x.id", "x.doc_id", "x.offset", "x.tokens", "x.text", X.terms(F.col("x.text")).alias("terms"), _decode("x.embedding").alias("embedding"), F.lit(False).alias("deleted"))
    return doc, chunk


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_lines(spark.read.text(path).withColumn("n", F.monotonically_increasing_id()))


def replaced(old: DataFrame, new: DataFrame, schema=DOC) -> DataFrame:
    """Old rows, with new ones in place of those of their ids."""
    return old.join(new.select("id"), "id", "left_anti").select(*schema.fieldNames()).unionByName(new.select(*schema.fieldNames()))


def merged(now: Corpus, doc: DataFrame, chunk: DataFrame) -> Corpus:
    """A corpus after an import; documents at the same path stay beside the imported ones."""
    return Corpus(replaced(now.doc, doc, DOC), replaced(now.chunk, chunk, CHUNK))
