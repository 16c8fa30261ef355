import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.functions.vectors import HashEmbedder, cosine, from_base64, to_base64
from lodestack.operators import chunking as CH


def frame(spark, texts, parser="plain"):
    return spark.createDataFrame([(str(i), t, parser) for i, t in enumerate(texts)], "id string, text string, parser string")


def windows(words, size, overlap):
    out, start = [], 0
    while words:
        end = min(start + size, len(words))
        out.append((start, words[start:end]))
        if end == len(words):
            break
        start = end - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(4, 1), (4, 0), (4, 3), (1, 0)])
def test_windows(spark, size, overlap):
    texts = [" ".join(f"w{k}" for k in range(n)) for n in range(14)] + ["a b　c  d"]
    got = {}
    for r in CH.chunk_documents(frame(spark, texts), size, overlap).collect():
        got.setdefault(r["doc_id"], []).append((r["offset"], r["text"].split(" "), r["tokens"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(str(i), [])) == [(a, w, len(w)) for a, w in windows(t.split(), size, overlap)]


def loop_blocks(kind, lines):
    out, now, fenced = [], [], False
    for line in lines:
        if kind == "markdown":
            if line.startswith("```"):
                if not fenced and now:
                    out.append(now)
                    now = []
                now.append(line)
                fenced = not fenced
                if not fenced:
                    out.append(now)
                    now = []
                continue
            if not fenced and line.startswith("#") and now:
                out.append(now)
                now = []
        else:
            if not line.strip():
                if now:
                    out.append(now)
                now = []
                continue
            if any(line.lstrip().startswith(w) for w in ("fn ", "def ", "class ", "struct ", "enum ", "impl ", "interface ")) and now:
                out.append(now)
                now = []
        now.append(line)
    return [" ".join(b).split() for b in [*out, now] if " ".join(b).split()]


@pytest.mark.parametrize("kind", ["markdown", "code"])
def test_blocks_against_a_loop(spark, kind):
    rng = random.Random(2)
    choice = ["# h", "text one two", "```", "```py", "", "  ", "def f()", "  fn g", "pub fn h", "async def k", "## sub", "class A", "x"]
    texts = ["\n".join(rng.choice(choice) for _ in range(rng.randint(1, 12))) + rng.choice(["", "\n"]) for _ in range(200)]
    got = {}
    for r in CH.blocks(frame(spark, texts, kind)).where(F.size("words") > 0).orderBy("key", "block").collect():
        got.setdefault(int(r["key"]), []).append(list(r["words"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == loop_blocks(kind, t.rstrip("\n").split("\n") if t.endswith("\n") else t.split("\n")), repr(t)


def test_offsets_go_on_over_blocks(spark):
    rows = CH.chunk_documents(frame(spark, ["# a b c\nd e f g h\n## i j"], "markdown"), 4, 1, parser="parser").orderBy("offset").collect()
    assert [(r["offset"], r["text"]) for r in rows] == [(0, "# a b c"), (3, "c d e f"), (6, "f g h"), (9, "## i j")]


def test_ids(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    path, text = "notes/é.txt", "one  two\nthree four five\n"
    d = spark.createDataFrame([(path, text)], "path string, text string").withColumn("hash", X.content_hash(F.col("text"))).withColumn("id", X.doc_id(F.col("path"), F.col("hash")))
    r = d.first()
    assert r["hash"] == sha(text) and r["id"] == sha(path + "\0" + sha(text))
    c = CH.chunk_documents(d, 256, 32).first()
    assert (c["id"], c["offset"], c["tokens"], c["text"]) == (sha(r["id"] + ":0"), 0, 5, "one two three four five")


META = [
    ("---\nStatus: open\nMy Key: a: b\nstatus: done\n---\nbody", {"my_key": "a: b", "status": "done"}),
    ("---\na: 1\n...\nb: 2", {"a": "1"}),
    ("---\na: 1\nb: 2", {"a": "1", "b": "2"}),
    ("# Title\n\nStatus: active\nMilestone: M1\nOwner:\n\nText: no", {"status": "active", "milestone": "M1", "owner": ""}),
    ("\n\nK-1: v\nno colon\nx: y", {"k_1": "v"}),
    ("just text", None),
    ("", None),
    ("# Title only", None),
    ("---\n---\nTop: x", None),
    ("!!: x\nB: y", {"b": "y"}),
]


def test_metadata(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(META)], "i int, t string").select("i", CH.metadata(F.col("t")).alias("m")).collect()
    for r in rows:
        want = META[r["i"]][1]
        assert (json.loads(r["m"]) if r["m"] else None) == want, META[r["i"]][0]
        if want:
            assert list(json.loads(r["m"])) == sorted(want)


def test_parsers(spark):
    paths = {"a.md": "markdown", "a/b.MDX": "markdown", "x.rs": "code", "x.tar.gz": "plain", ".bashrc": "plain", "dir.py/readme": "plain", "a.yaml": "code"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", X.parser_of(F.col("p")).alias("k")).collect()
    assert {r["p"]: r["k"] for r in rows} == paths
    with pytest.raises(ValueError):
        X.parser_of(F.col("p"), "html")


@pytest.mark.parametrize("dim", [16, 100])
def test_hash_embedding(spark, dim):
    e = HashEmbedder(dim)
    texts = ["alpha beta beta gamma", "", "Alpha", "é ü x " * 20]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", e.column(X.tokens(F.col("t"))).alias("v")).collect()
    for r in rows:
        assert r["v"] == pytest.approx(e.query(r["t"]), abs=1e-6)
    v = e.query("alpha beta")
    assert from_base64(to_base64(v)) == v
    got = spark.createDataFrame([(v, [0.0] * dim)], "a array<float>, z array<float>").select(cosine(F.col("a"), v).alias("s"), cosine(F.col("z"), v).alias("z"), cosine(F.slice("a", 1, 3), v).alias("d")).first()
    assert got["s"] == pytest.approx(1.0) and got["z"] is None and got["d"] is None
