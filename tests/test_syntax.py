import pytest

from lodestack.plans.filters import glob_pattern, like_pattern, number_text, path_glob
from lodestack.plans.syntax import Among, Both, Compare, Either, Field, Not, parse_filter, parse_query
from lodestack.schema import Config, QueryError


def test_both_forms_of_a_query():
    a = parse_query("FROM chunk USING semantic('x'), lexical(\"y\") FILTER doc.tag = 'a' ORDER BY score ASC LIMIT 3 OFFSET 2 SELECT chunk.text, doc.path;")
    b = parse_query("SELECT chunk.text, doc.path FROM CHUNK using lexical('z'), semantic('x'), lexical('y'), FILTER Doc.tag = 'a' order by SCORE asc limit 3.9 offset 2")
    assert a == b
    assert (a.table, a.semantic, a.lexical, a.limit, a.offset, a.order.descending) == ("chunk", "x", "y", 3, 2, False)
    assert a.select == (Field("chunk", "text"), Field("doc", "path"))


def test_order_is_descending_unless_said():
    assert parse_query("FROM doc ORDER BY doc.path SELECT *").order.descending
    assert parse_query("FROM doc ORDER BY doc.path DESC SELECT *").order.descending


def test_precedence():
    c = lambda n: Compare(Field("doc", n), "=", "x")
    assert parse_filter("NOT doc.a = 'x' AND doc.b = 'x' OR doc.c = 'x'") == Either(Both(Not(c("a")), c("b")), c("c"))
    assert parse_filter("doc.a = 'x' AND (doc.b = 'x' OR NOT NOT doc.c = 'x')") == Both(c("a"), Either(c("b"), Not(Not(c("c")))))
    assert parse_filter("doc.meta.k in (1, 'b')") == Among(Field("doc", "meta.k"), (1.0, "b"))


@pytest.mark.parametrize("source", ["FROM docs SELECT *", "FROM doc", "FROM doc SELECT doc.path LIMIT", "FROM doc FILTER doc.a BETWEEN 1 SELECT *", "FROM doc FILTER doc.a-b = 1 SELECT *", "FROM doc FILTER doc.a = doc.b SELECT *", "FROM chunk SELECT offset", "FROM doc LIMIT 1.2.3 SELECT *"])
def test_errors(source):
    with pytest.raises(QueryError):
        parse_query(source)


def test_what_follows_the_end():
    with pytest.raises(QueryError):
        parse_filter("doc.tag = 'a' ORDER BY x")
    assert parse_filter("doc.tag = 'a' ORDER BY x", strict=False) == Compare(Field("doc", "tag"), "=", "a")


def test_strings():
    assert parse_filter(r"doc.tag = 'a\'b\\c'").value == r"a'b\c"
    assert parse_filter("doc.tag = 'open").value == "open"
    assert parse_filter("chunk.offset >= 3.5").value == 3.5


def test_numbers_as_text():
    assert [number_text(x) for x in (5.0, 0.5, 1e20, 123456789.25)] == ["5.0", "0.5", "1.0e+20", "123456789.25"]


def test_patterns_end_where_the_text_does():
    assert like_pattern("a%_b").endswith(r"\z") and glob_pattern("[").startswith("(?!)")
    with pytest.raises(QueryError):
        path_glob("{a,b")


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("chunk_tokens = 10\noverlap_tokens = 10\n")
    assert Config.load(f).overlap_tokens == 0
    assert Config(chunk_tokens=4, overlap_tokens=9).overlap == 3
    f.write_text("no_such = 1")
    with pytest.raises(ValueError):
        Config.load(f)
