"""Filters and full text against the SQLite of Python's standard library."""

import itertools
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestack.functions import fulltext as FT
from lodestack.functions import text as X
from lodestack.plans.filters import Filters, like_pattern, glob_pattern
from lodestack.plans.syntax import parse_filter
from lodestack.schema import QueryError

TEXTS = ["a.txt", "docs/a.txt", "docs/sub/b.TXT", "É", "é", "a\\b", "a%b", "a_b", "5", "5.0", "", "z", "-", "a]b", "x\ny", "ABC", "abc", "[a]", "a-c"]
LIKES = ["%.txt", "A%", "_", "é", "a\\b", "a%b", "%", "", "a_b", "%\n%", "5", "[a]"]
GLOBS = ["*.txt", "**/*.txt", "[a-c]*", "[^a-c]", "?", "a[]]b", "[", "*", "a*c", "[A-Z]*", "5", "[[]a]", "[a-]*", "docs/*"]


def test_like_and_glob(spark):
    db = sqlite3.connect(":memory:")
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for kind, patterns, to in (("LIKE", LIKES, like_pattern), ("GLOB", GLOBS, glob_pattern)):
        got = rows.select("t", *[F.col("t").rlike(to(p)).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
        for r in got:
            for i, p in enumerate(patterns):
                assert r[f"p{i}"] == bool(db.execute(f"select ? {kind} ?", (r["t"], p)).fetchone()[0]), (kind, r["t"], p)


def test_comparisons_by_type(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create table doc (n integer, tag text, meta text)")
    db.execute("create table chunk (n integer, offset integer)")
    tags, metas, offsets = [None, "5", "5.0", "a", "", "10"], [None, '{"k":"5"}', '{"k":5}', '{"k":"a"}', '{"k":7.5}', '{"j":1}', '{"k":true}', '{"k":null}'], [0, 5, 12, 5, 7, 100]
    data = []
    for n, (t, m) in enumerate(itertools.product(tags, metas)):
        o = offsets[n % len(offsets)]
        db.execute("insert into doc values (?,?,?)", (n, t, m))
        db.execute("insert into chunk values (?,?)", (n, o))
        data.append((n, t, m, o))
    rows = spark.createDataFrame(data, "n int, tag string, meta string, offset long")
    f = Filters(lambda table, name: F.col(name))
    checks = []
    for field, op, value in itertools.product(("doc.tag", "doc.meta.k", "chunk.offset"), ("=", "!=", "<", "<=", ">", ">=", "LIKE", "GLOB"), ("5", "abc", 5, 7.5, "10", " 5 ", "")):
        lit = f"'{value}'" if isinstance(value, str) else str(value)
        checks.append((f"{field} {op} {lit}", field, op, value))
    checks += [("doc.tag IN ('a', 5)", None, None, None), ("NOT doc.meta.k IN (5, 'a')", None, None, None), ("chunk.offset IN ('5', 7, 'x')", None, None, None), ("NOT doc.tag = 'a' OR chunk.offset > 6 AND NOT doc.meta.k < '6'", None, None, None)]
    got = rows.select("n", *[f.compile(parse_filter(c[0])).alias(f"c{i}") for i, c in enumerate(checks)]).collect()
    for i, (source, *_rest) in enumerate(checks):
        sql = source.replace("doc.meta.k", "json_extract(doc.meta, '$.k')")
        for number in ("5", "7.5", "7", "6"):  # numbers are bound as reals
            sql = sql.replace(f" {number})", f" {float(number)})").replace(f", {number},", f", {float(number)},").replace(f"({number},", f"({float(number)},")
        if sql.endswith((" 5", " 7.5", " 6")):
            head, _, tail = sql.rpartition(" ")
            sql = f"{head} {float(tail)}"
        want = dict(db.execute(f"select doc.n, {sql} from doc join chunk on doc.n = chunk.n").fetchall())
        for r in got:
            assert r[f"c{i}"] == (None if want[r["n"]] is None else bool(want[r["n"]])), (source, sql, r["n"], data[r["n"]])


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "Café", "naïve", "retry_backoff", "x9", "ß", "über"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", ".", " -"]) for _ in range(rng.randint(0, 14))) for _ in range(150)] + [""]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(text)")
    db.executemany("insert into f(rowid, text) values (?,?)", list(enumerate(texts, 1)))
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "id int, text string").withColumn("terms", X.terms(F.col("text"))).cache()
    return db, rows


QUERIES = [
    "alpha", "alpha beta", "alpha AND beta", "alpha OR beta", "alpha NOT beta", "alpha beta OR gamma delta", "alpha OR beta AND gamma", "alpha NOT beta NOT gamma", "alpha AND beta NOT gamma", "(alpha AND beta) OR gamma",
    '"alpha beta"', "alpha + beta", "alph*", '"alpha b" *', "^alpha", "^alpha beta", "NEAR(alpha beta, 2)", "NEAR(alpha beta)", "NEAR(alpha beta gamma, 3)", 'NEAR("alpha beta" gamma, 1)', "retry_backoff", "CAFE", "naive", "text:alpha", "{text} : alpha", "text : alpha OR beta",
    "or", "alpha or beta", "nosuch", "alpha OR nosuch", "ß", '"alpha alpha"', "(alpha OR beta) AND (gamma OR delta)", "(alpha) NOT (beta OR gamma)", "uber", '"" alpha', 'alpha ""', "x9 OR über NOT beta",
]


def test_full_text_matches_and_scores(spark, corpus):
    db, rows = corpus
    for q in QUERIES:
        want = dict(db.execute("select rowid, bm25(f) from f where f match ?", (q,)).fetchall())
        node = FT.parse(q)
        stats = FT.corpus_stats(rows, node)
        got = {r["id"]: r["s"] for r in rows.where(FT.matches(node, F.col("terms"))).select("id", FT.bm25(node, F.col("terms"), stats).alias("s")).collect()}
        assert set(got) == set(want), q
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-9), (q, k)


def test_full_text_errors(corpus):
    db, _ = corpus
    for q in ["?", "C++", "a,b", "429.5", "doc's", "", "a OR", "NOT foo", "(alpha", "alpha)", "AND", "(alpha OR beta) gamma", "alpha (beta)", "foo-bar", '"open', "foo:alpha", "NEAR(alpha, x)", "^", "alpha +", "*"]:
        with pytest.raises(sqlite3.OperationalError) as e:
            db.execute("select rowid from f where f match ?", (q,)).fetchall()
        with pytest.raises(QueryError) as own:
            FT.parse(q)
        assert isinstance(own.value, FT.FullTextSyntaxError) == ("syntax error" in str(e.value)), (q, str(e.value), own.value)


def test_sanitize():
    assert FT.sanitize("?") == "" and FT.sanitize(" a-b, c_d! é") == "a b c_d é"
