"""The inverted index against a search over all rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.functions import fulltext as FT
from lodestack.functions import text as X
from lodestack.operators import chunking as CH
from lodestack.operators import postings as PT
from lodestack.operators import retrieval as R
from lodestack.plans.syntax import parse_filter
from lodestack.schema import DOC, Corpus, QueryError

QUERIES = [
    "ka", "nothere", "ka AND lo", "ka OR pim", "ka NOT lo", "ka lo", '"ka lo"', "ka + lo + mi", "^ka", "^ka + lo", "mi*", '"ka mi" *', "NEAR(ka lo, 2)", "NEAR(ka lo mi, 3)", 'NEAR("ka lo" mi, 1)',
    "text: ka", "(ka OR lo) AND mi NOT pim", "ka NOT mi*", '""', 'ka ""', "élan", "ELAN", "42", "NEAR(ka ka, 1)",
]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["ka", "lo", "mi", "mira", "pim", "élan", "42", "Ka", "zzz"]
    texts = ["", "ka", "x"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    d = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    d = d.select(X.doc_id(F.concat(F.lit("p/"), "n"), X.content_hash(F.col("text"))).alias("id"), F.concat(F.lit("p/"), "n").alias("path"), F.lit("2024-01-01T00:00:00Z").alias("mtime"), F.length("text").cast("long").alias("size"), X.content_hash(F.col("text")).alias("hash"), (F.col("n") % 3).cast("string").alias("tag"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("meta"), (F.col("n") % 11 == 5).alias("deleted"), "text")
    d = d.repartition(3).cache()
    chunk = CH.chunk_documents(d, 16, 4).cache()
    path = str(tmp_path_factory.mktemp("index"))
    doc = d.select(*DOC.fieldNames())
    index = PT.read(spark, path, *PT.write(chunk, path))
    return Corpus(doc, chunk), Corpus(doc, index.rows.drop("n", "length"), index)


def answer(rows):
    return [(r["doc"]["path"], r["chunk"]["offset"], r["chunk"]["text"], r["score"]) for r in rows.orderBy("doc.path", "chunk.offset").collect()]


@pytest.mark.parametrize("text", QUERIES)
def test_index_finds_what_a_scan_finds(both, text):
    plain, indexed = both
    node = FT.parse(text)
    stats = FT.corpus_stats(plain.chunk, node)
    want = {r["id"]: r["b"] for r in plain.chunk.where(FT.matches(node, F.col("terms"))).select("id", F.round(FT.bm25(node, F.col("terms"), stats), 9).alias("b")).collect()}
    got = PT.search(indexed.index, node).join(indexed.index.rows.select("n", "id"), "n")
    assert {r["id"]: r["b"] for r in got.select("id", F.round("bm25", 9).alias("b")).collect()} == want


@pytest.mark.parametrize("where", [None, "doc.tag = '1'", "chunk.text LIKE '%mira%' AND chunk.offset >= 12"])
def test_top_rows_are_the_same(both, where, monkeypatch):
    plain, indexed = both
    tree = parse_filter(where) if where else None
    for text, k in (("ka", 7), ("mi* NOT lo", 30)):
        want = answer(R.lexical(plain, text, k, tree).rows)
        assert answer(R.lexical(indexed, text, k, tree).rows) == want and want
        monkeypatch.setattr(PT, "LOOKUP_ROWS", 0)
        assert answer(R.lexical(indexed, text, k, tree).rows) == want
        monkeypatch.undo()


def test_a_search_reads_no_text_of_other_rows(both):
    plan = PT.search(both[1].index, FT.parse("ka AND lo"))._jdf.queryExecution().toString()
    assert "text" not in plan.split("== Physical Plan ==")[1].split("ReadSchema")[1].split(chr(10))[0]
    with pytest.raises(QueryError):
        FT.parse("ka AND")


def test_an_empty_index(spark, tmp_path, both):
    index = PT.read(spark, str(tmp_path / "none"), *PT.write(both[0].chunk.limit(0), str(tmp_path / "none")))
    assert index.count == 0 and PT.search(index, FT.parse("ka")).count() == 0


def test_postings_as_bytes_are_those_that_were_inverted(monkeypatch):
    monkeypatch.setattr(PT, "INVERTED", 500)
    monkeypatch.setattr(PT, "DECODED", 40)
    rng = random.Random(1)
    rows = [[rng.choice("abcdefg") for _ in range(rng.randrange(300))] for _ in range(60)] + [[], ["é"] * 70_000]
    numbers = [*range(5, 35), *range(2**33, 2**33 + 32)]
    batch = pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["n", "terms"])
    inverted = [x.select(["term", "start", "n", "entries"]) for x in PT._invert(iter([batch]))]
    assert len(inverted) > 5
    got = sorted((r["term"], r["n"], r["length"], tuple(r["places"])) for x in PT._decode(iter(inverted)) for r in x.to_pylist())
    assert got == sorted((t, n, len(w), tuple(i for i, x in enumerate(w) if x == t)) for n, w in zip(numbers, rows) for t in set(w))
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**31, 2**34])
    data, begin = PT.packed(values)
    assert PT.unpacked(data)[0].tolist() == values.tolist() and PT.unpacked(data)[1].tolist() == begin[:-1].tolist() and len(data) == 1 + 1 + 1 + 2 + 2 + 3 + 4 + 5 + 5 + 5


def test_postings_are_sorted_in_as_many_parts_as_their_bytes_ask_for(spark, tmp_path, both, monkeypatch):
    monkeypatch.setattr(PT, "PART_BYTES", 1000)
    PT.write(both[0].chunk, str(tmp_path / "cut"))
    assert len(list((tmp_path / "cut/postings").glob("head=*/*.parquet"))) > 12


def test_neighbours_are_looked_up_before_anything_is_joined(both):
    rows = both[1].chunk.withColumn("embedding", F.array(F.lit(1.0), F.size("terms").cast("double")).cast("array<float>"))
    near = R.semantic(Corpus(both[1].doc, rows), [1.0, 3.0], 5)
    assert near.count() == 5
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") >= 2 and all("id#" in x and " IN (" in x or "INSET" in x for x in plan.split("\n") if "Filter" in x)
