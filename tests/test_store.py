"""What a store writes, and what it survives."""

import json
import os
import socket
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from lodestack.functions.vectors import HashEmbedder
from lodestack.operators import retrieval as R
from lodestack.schema import Config, StoreError
from lodestack.sources import store as ST

CONFIG = Config(embedding_dim=8, chunk_tokens=8, overlap_tokens=2)


def batch(spark, texts, mtime="2024-01-01T00:00:00Z"):
    from lodestack.functions import text as X

    d = spark.createDataFrame(list(texts.items()), "path string, text string").withColumn("hash", X.content_hash(F.col("text")))
    none = F.lit(None).cast("string")
    return d.select(X.doc_id(F.col("path"), F.col("hash")).alias("id"), "path", F.lit(mtime).alias("mtime"), F.length("text").cast("long").alias("size"), "hash", none.alias("tag"), none.alias("source"), none.alias("meta"), F.lit(False).alias("deleted"), "text", F.lit("plain").alias("parser"))


def found(store, text):
    return sorted(r["chunk"]["text"] for r in R.lexical(store.corpus(), text, 50).rows.collect())


@pytest.fixture
def store(spark, tmp_path):
    out = ST.Store.create(spark, tmp_path / "s", HashEmbedder(8))
    out.upsert(batch(spark, {f"p/{k}": f"word{k} common" for k in range(6)}), CONFIG)
    return out


def written(store):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(store.path) for f in fs if f.endswith(".parquet")}


def test_a_change_writes_only_what_changed(spark, store):
    before = written(store)
    store.upsert(batch(spark, {"p/1": "changed common", "p/9": "fresh common"}), CONFIG)
    after = written(store)
    assert all(after[f] == t for f, t in before.items())
    assert found(store, "common") == sorted([f"word{k} common" for k in (0, 2, 3, 4, 5)] + ["changed common", "fresh common"])
    assert found(store, "word1") == []
    doc = {(r["path"], r["deleted"]) for r in store.corpus().doc.collect()}
    assert ("p/1", True) in doc and ("p/1", False) in doc and len(doc) == 8
    # the same text again, then one that was there before the change
    store.upsert(batch(spark, {"p/9": "fresh common", "p/1": "word1 common"}), CONFIG)
    assert sum(not r["deleted"] for r in store.corpus().doc.collect()) == 7 and found(store, "word1") == ["word1 common"]
    c = store.corpus()
    assert c.index.count == c.chunk.count() and c.doc.groupBy("id").count().where("count > 1").count() == 0
    assert c.index.average == pytest.approx(c.chunk.agg(F.avg(F.size("terms"))).first()[0])


def test_many_segments_are_folded(spark, store, monkeypatch):
    monkeypatch.setattr(ST, "FOLD", 3)
    for k in range(4):
        store.upsert(batch(spark, {f"q/{k}": f"other{k} common"}), CONFIG)
    assert len(store.manifest()["segments"]) <= 3 and len(found(store, "common")) == 10
    assert store.remove(["p/2"]) == 1 and store.remove(["nothing"]) == 0 and len(found(store, "common")) == 9
    store.compact()
    assert len(store.manifest()["segments"]) == 1 and len(found(store, "common")) == 9 and store.corpus().doc.count() == 9


def test_of_rows_with_one_path_the_latest_counts(spark, store):
    old, new = batch(spark, {"z": "older"}), batch(spark, {"z": "newer"}, "2024-02-01T00:00:00Z")
    assert store.upsert(new.unionByName(old), CONFIG).documents == 1
    assert found(store, "newer OR older") == ["newer"]


def test_the_lock_of_a_dead_writer_is_taken_over(spark, store):
    gone = subprocess.Popen(["true"])
    gone.wait()
    lock = {"owner": "x", "host": socket.gethostname(), "pid": gone.pid, "time": time.time()}
    store.folder.create("writer.lock", json.dumps(lock))
    with store.lock(wait=0.1):
        pass
    # of another machine: only when its lease is over
    store.folder.create("writer.lock", json.dumps(lock | {"host": "elsewhere"}))
    with pytest.raises(StoreError), store.lock(wait=0.1):
        pass
    store.folder.replace("writer.lock", json.dumps(lock | {"host": "elsewhere", "time": time.time() - ST.LEASE - 1}))
    with store.lock(wait=0.1):
        # a writer whose lock was taken over can't commit any more
        store.folder.replace("writer.lock", "{}")
        with pytest.raises(StoreError, match="taken over"):
            store._commit(9, [], [])
    assert store.folder.read("writer.lock") == "{}"


def test_what_a_lost_writer_left_is_no_part_of_the_store(spark, store):
    number = store.manifest()["version"] + 1
    batch(spark, {"half": "half done"}).write.parquet(str(store.path / f"s{number}" / "doc"))
    assert found(store, "half") == []
    store.upsert(batch(spark, {"p/7": "whole"}), CONFIG)
    assert found(store, "half") == [] and found(store, "whole") == ["whole"]


def test_texts_of_a_batch_stay_where_they_are(spark, tmp_path, monkeypatch):
    plans, cut = [], ST.chunk_documents

    def chunked(docs, *args, **options):
        plans.append(docs._jdf.queryExecution().executedPlan().toString())
        return cut(docs, *args, **options)

    monkeypatch.setattr(ST, "chunk_documents", chunked)
    store = ST.Store.create(spark, tmp_path / "s", HashEmbedder(8))
    store.upsert(batch(spark, {f"p/{k}": f"word{k}" for k in range(9)}), CONFIG)
    assert "Exchange" not in plans[0]
    new, newer = batch(spark, {"p/1": "old"}), batch(spark, {"p/1": "newest", "p/2": "two"}, "2024-01-02T00:00:00Z")
    store.upsert(new.union(newer).union(newer), CONFIG)
    assert found(store, "old") == [] and found(store, "newest") == ["newest"] and found(store, "two") == ["two"] and found(store, "word1") == []


def test_names_meet_documents_by_equality(spark, tmp_path, monkeypatch):
    store = ST.Store.create(spark, tmp_path / "s", HashEmbedder(8))
    store.upsert(batch(spark, {f"p/{k}": f"word{k}" for k in range(9)} | {"plain": "word"}), CONFIG)
    plans, segment = [], ST.Store._segment

    def kept(self, number, doc, chunk, marks=None):
        plans.append(marks._jdf.queryExecution().executedPlan().toString())
        return segment(self, number, doc, chunk, marks)

    monkeypatch.setattr(ST.Store, "_segment", kept)
    one = store.corpus().doc.where("path = 'p/3'").first()["id"]
    assert store.remove(["p/1", one, "plain", "p/none", "none", "p/3"]) == 3
    assert "NestedLoop" not in plans[0] and "Cartesian" not in plans[0]


def test_ingestion_bounds_what_workers_hold(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    store = ST.Store.create(spark, tmp_path / "s", HashEmbedder(8))
    store.upsert(batch(spark, {"p/1": "one two"}), CONFIG)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= 16 << 20
