import json
import os

import pytest
from pyspark.sql import functions as F

from lodestack.api import Engine
from lodestack.functions.vectors import HashEmbedder
from lodestack.output import json_lines, table
from lodestack.schema import Config, QueryError, StoreError, find_store
from lodestack.sources.store import Store
from lodestack.streaming.ingest import watch

CONFIG = Config(embedding_dim=32, chunk_tokens=8, overlap_tokens=2)


@pytest.fixture
def engine(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    os.makedirs("docs")
    for name, text in (("b.txt", "beta gamma delta"), ("a.txt", "alpha beta gamma"), ("c.md", "Status: open\n\n# One\ngamma delta epsilon " + "word " * 20)):
        (tmp_path / "docs" / name).write_text(text)
    (tmp_path / "docs" / "bad.txt").write_bytes(b"\xff\xfe\x00")
    e = Engine.create(spark, tmp_path / "store", CONFIG)
    done = e.add(["docs"], tag="docs")
    assert done.documents == 3 and len(done.skipped) == 1
    return e


def paths(result):
    return [r["doc"]["path"] for r in result.rows.collect()]


def test_structured_queries(engine):
    assert paths(engine.query("FROM doc FILTER doc.path GLOB '**/*.txt' LIMIT 10 SELECT doc.path;")) == ["docs/a.txt", "docs/b.txt"]
    assert paths(engine.query('FROM doc FILTER doc.tag = "docs" ORDER BY doc.tag DESC LIMIT 10 SELECT doc.path, doc.tag;')) == ["docs/a.txt", "docs/b.txt", "docs/c.md"]
    assert paths(engine.query("FROM doc ORDER BY doc.path LIMIT 1 OFFSET 1 SELECT doc.path")) == ["docs/b.txt"]
    assert paths(engine.query("FROM doc FILTER doc.meta.status = 'open' SELECT doc.path")) == ["docs/c.md"]
    got = engine.query("FROM doc FILTER doc.path LIKE '%A.TXT' SELECT doc.path, doc.meta.status, doc.nothing").json()
    assert got["ok"] and got["results"] == [{"doc": {"path": "docs/a.txt", "meta.status": None}}]
    assert engine.query("FROM doc LIMIT 1 SELECT doc.nothing").json()["results"] == [{}]
    for bad in ("FROM doc FILTER tag = 'x' SELECT *", "FROM doc FILTER doc.size = 1 SELECT *", "FROM doc ORDER BY doc.nothing SELECT *", "FROM doc FILTER chunk.tokens = 1 SELECT *"):
        with pytest.raises(QueryError):
            engine.query(bad)


def test_search(engine):
    hybrid = engine.search("gamma", 4, filter="doc.tag = 'docs'")
    rows = hybrid.rows.collect()
    assert len(rows) >= 3 and all(r["lexical"] == 1.0 for r in rows[:3])
    for r in rows:
        assert r["score"] == pytest.approx(0.5 * (r["lexical"] or 0) + 0.5 * (r["semantic"] or 0), abs=1e-6)
    only = engine.search("?", 4)
    assert only.warnings and all(r["score"] == r["semantic"] for r in only.rows.collect())
    assert paths(engine.search("alpha", 4, bm25=True)) == ["docs/a.txt"]
    assert paths(engine.search("alpha beta gamma", 1, vector=True)) == ["docs/a.txt"]
    assert engine.search("gamma", 0).rows.count() == 0
    assert engine.search("gamma", 3, snapshot="2000-01-01T00:00:00Z").rows.count() == 0
    with pytest.raises(QueryError):
        engine.search("gamma", 3, snapshot="yesterday")
    with pytest.raises(QueryError):
        engine.search("a OR", 3)
    assert engine.search("a-b", 3, literal=True, bm25=True).rows.count() == 0
    answer = hybrid.json(explain=True)
    assert answer["explain"]["mode"] == "hybrid" and "explain" in answer["results"][0]
    assert [json.loads(x)["type"] for x in json_lines(answer)][:2] == ["meta", "result"]
    assert table(rows).startswith("docs/")


def test_grouping_and_reordering(engine):
    docs = engine.query("FROM doc USING lexical('word OR gamma') LIMIT 10 SELECT doc.path, score")
    assert sorted(paths(docs)) == ["docs/a.txt", "docs/b.txt", "docs/c.md"]
    got = paths(engine.query("FROM chunk USING lexical('gamma') ORDER BY doc.path LIMIT 2 SELECT doc.path"))
    assert got == ["docs/b.txt", "docs/a.txt"]
    assert engine.query("FROM chunk USING LIMIT 2 SELECT *").rows.count() == 0


def test_repeated_runs_agree(engine):
    runs = [engine.search("gamma delta", 5, snapshot="2100-01-01T00:00:00Z").json()["results"] for _ in range(3)]
    assert runs[0] == runs[1] == runs[2]


def test_context(engine):
    one = engine.context("gamma", 16).first()
    assert 0 < one["used_tokens"] <= 16 and one["chunks"][0]["path"].startswith("docs/")
    assert engine.context("gamma", 0).first()["used_tokens"] == 0
    assert engine.packed("gamma", 100, diversity=0).count() == 0
    per_doc = [r["doc"]["path"] for r in engine.packed("gamma OR word", 100, diversity=1).collect()]
    assert len(per_doc) == len(set(per_doc))
    rows = engine.packed("gamma", 4).orderBy("rank").collect()
    assert [r["tokens"] for r in rows] == [3, 1] and rows[1]["text"].count(" ") == 0


def test_changes(engine, tmp_path):
    before = engine.stats()
    assert engine.add(["docs"]).documents == 3  # unchanged files stay as they are
    after = engine.stats()
    assert (after["docs"], after["chunks"], after["tokens"]) == (before["docs"], before["chunks"], before["tokens"])
    assert engine.add(["docs"], mtime_only=True).documents == 0
    (tmp_path / "docs" / "a.txt").write_text("alpha changed")
    engine.add(["docs"], include="**/a.txt")
    assert engine.corpus.doc.where(~F.col("deleted")).count() == 3 and engine.corpus.doc.where("deleted").count() == 1
    assert [r["chunk"]["text"] for r in engine.search("alpha", 5, bm25=True).rows.collect()] == ["alpha changed"]
    assert engine.remove(["docs/b.txt"]) == 1 and engine.remove(["docs/b.txt"]) == 0
    assert engine.doctor() == []
    engine.compact()
    assert engine.corpus.doc.count() == 2 and engine.corpus.chunk.where("deleted").count() == 0
    assert engine.add(["docs"], exclude=["**/c.md"]).documents == 2
    assert engine.remove([engine.corpus.doc.where("path = 'docs/b.txt'").first()["id"]], purge=True) == 1


def test_export_and_import(engine, spark, tmp_path):
    engine.export(str(tmp_path / "out"))
    other = Engine.create(spark, tmp_path / "other", CONFIG)
    other.import_(str(tmp_path / "out"))
    other.import_(str(tmp_path / "out"))
    a, b = engine.corpus, other.corpus
    assert sorted(map(str, a.doc.collect())) == sorted(map(str, b.doc.collect()))
    assert sorted(map(str, a.chunk.drop("embedding").collect())) == sorted(map(str, b.chunk.drop("embedding").collect()))
    assert engine.search("gamma", 5).json()["results"] == other.search("gamma", 5).json()["results"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.txt").write_text('\n{"type":"other","id":"1"}\n')
    with pytest.raises(Exception, match="not a doc or chunk line"):
        other.import_(str(tmp_path / "bad"))


def test_store_checks(spark, tmp_path):
    e = HashEmbedder(8)
    with pytest.raises(StoreError):
        Store.open(spark, tmp_path / "s", e)
    store = Store.create(spark, tmp_path / "s", e)
    with pytest.raises(StoreError):
        Store.create(spark, tmp_path / "s", e)
    with pytest.raises(StoreError):
        Store.open(spark, tmp_path / "s", HashEmbedder(16))
    with store.lock(), pytest.raises(StoreError), store.lock(wait=0.1):
        pass
    assert find_store(tmp_path / "s", "s") == tmp_path / "s" and find_store(tmp_path, "nothing") is None
    assert store.stats()["docs"] == 0 and store.doctor() == []


def test_streaming(engine, tmp_path):
    q = watch(engine.store, str(tmp_path / "docs"), str(tmp_path / "cp"), CONFIG)
    q.awaitTermination(120)
    n = engine.stats()["docs"]
    assert n >= 3
    (tmp_path / "docs" / "new.txt").write_text("zeta eta")
    watch(engine.store, str(tmp_path / "docs"), str(tmp_path / "cp"), CONFIG).awaitTermination(120)
    assert engine.stats()["docs"] == n + 1
