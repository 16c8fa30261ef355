"""The command line from an empty folder to an export and back."""

import json

import pytest

from lodestack import cli, output
from lodestack.schema import StoreError, discover


@pytest.fixture
def run(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "settings"))
    (tmp_path / "settings" / "lodestack").mkdir(parents=True)
    (tmp_path / "settings" / "lodestack" / "lodestack.toml").write_text('chunk_tokens = 16\noverlap_tokens = 16\nembedding = " HASH "\nembedding_dim = 16\n')
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "one.txt").write_text("harbour lights\nover calm water\n")
    (tmp_path / "notes" / "two.md").write_text("---\nstatus: open\n---\n# Tides\nwater rises at noon\n")

    def call(*words, fails=False):
        said = []
        assert cli.main([*words, "--json"], spark, said.append) == int(fails)
        answer = json.loads(said[0])
        assert output.problems(answer) == [] and answer["ok"] != fails
        return answer

    return call


def test_a_session(run, spark, tmp_path):
    assert run("stats", fails=True)["error"]["code"] == "store_error"
    run("init")
    assert run("init", fails=True)["error"]["code"] == "store_error"
    assert run("add", "notes", "--tag", "n", "--extract-meta")["stats"] == {"docs": 2, "chunks": 3}  # the front matter is a block of its own
    found = run("search", "water", "--filter", "doc.tag = 'n'", "--explain")
    assert found["query"]["limit"] == 8 and found["stats"]["total_hits"] == found["stats"]["returned"] == 3 and found["explain"]["lexical_hits"] == 2
    assert [r["score"] for r in found["results"]] == sorted((r["score"] for r in found["results"]), reverse=True)
    assert run("search", "water?", "--bm25")["warnings"] and run("search", "a OR", fails=True)["error"]["code"] == "invalid_query"
    page = run("query", "FROM doc FILTER doc.meta.status = 'open' OR doc.tag = 'n' ORDER BY doc.path ASC LIMIT 1 SELECT doc.path")
    assert page["results"] == [{"doc": {"path": "notes/one.txt"}}] and page["next_offset"] == 1
    context = run("context", "harbour", "--budget-tokens", "3")["context"]
    assert context["used_tokens"] == 3 and context["chunks"][0]["path"] == "notes/one.txt"
    assert run("doctor")["diagnostics"] == {"problems": []}
    run("export", "--out", str(tmp_path / "lines"))
    assert run("rm", "notes/one.txt", "--purge")["stats"] == {"docs": 1}
    run("import", str(tmp_path / "lines"))
    run("compact")
    stats = run("stats")["stats"]
    assert stats["docs"] == 2 and stats["parts"]["postings"] > 0 and stats["memory"]["driver_rss_bytes"] > 0
    said = []
    assert cli.main(["search", "water", "--bm25", "--jsonl"], spark, said.append) == 0
    assert [json.loads(x)["type"] for x in said] == ["meta", "result", "result"]
    said.clear()
    assert cli.main(["search", "tides", "--bm25"], spark, said.append) == 0 and said[0].startswith("notes/two.md\t")


def test_settings_have_one_place(run, tmp_path):
    run("init")
    (tmp_path / "notes" / "deep").mkdir()
    config, store = discover(tmp_path / "notes" / "deep")
    assert store == tmp_path / "store" and (config.overlap_tokens, config.embedding, config.embedding_dim) == (0, "hash", 16)
    (tmp_path / "lodestack.toml").write_text("")
    with pytest.raises(StoreError, match="beside"):
        discover(tmp_path)


def test_what_is_wrong_with_an_answer():
    assert output.problems({"ok": True, "schema_version": "2", "results": [{"score": 0.5}], "stats": {"took_ms": 1}}) == []
    assert output.problems({"ok": 1, "stats": {"took_ms": 0.5}, "warnings": ["x", 1], "results": {}, "error": {"code": "x"}}) == ["answer has no schema_version", "answer.error has no message", "answer.ok is int, not bool", "answer.stats.took_ms is float, not int", "answer.warnings[1] is int, not str", "answer.results is no list"]
