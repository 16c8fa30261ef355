"""Results for people and programs: JSON envelope, JSON lines, tab-separated table."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row

from .operators.retrieval import Selection
from .schema import SCHEMA_VERSION


def item(row: Row, chosen: Selection, explain: bool = False) -> dict[str, Any]:
    """One result: score, explain, doc and chunk objects. Absent tag and source are null, absent metadata has no key."""
    out: dict[str, Any] = {}
    if chosen.score and row["score"] is not None:
        out["score"] = row["score"]
    if explain and (parts := {k: row[k] for k in ("lexical", "semantic") if row[k] is not None}):
        out["explain"] = parts
    doc = {f: row["doc"][f] for f in chosen.doc if f != "meta"}
    if "meta" in chosen.doc and row["doc"]["meta"] is not None:
        try:
            doc["meta"] = json.loads(row["doc"]["meta"])
        except ValueError:
            doc["meta"] = row["doc"]["meta"]
    if chosen.meta:
        known = json.loads(row["doc"]["meta"] or "{}")
        doc |= {f"meta.{k}": known.get(k) for k in chosen.meta}
    if doc:
        out["doc"] = doc
    if row["chunk"] is not None and (chunk := {f: row["chunk"][f] for f in chosen.chunk}):
        out["chunk"] = chunk
    return out


def envelope(**parts: Any) -> dict[str, Any]:
    """A complete answer; parts that are None are left out."""
    return {"ok": True, "schema_version": str(SCHEMA_VERSION)} | {k: v for k, v in parts.items() if v is not None}


#: What an answer may hold: the kinds of values of each part. Other parts, and other keys inside, are free.
ANSWER: dict[str, Any] = {
    "ok": bool, "schema_version": str, "results": [{"score": float, "doc": dict, "chunk": dict, "explain": dict}], "context": dict, "explain": dict, "warnings": [str], "actions": [str], "diagnostics": dict, "next_offset": int,
    "query": {"text": str, "query": str, "filters": str, "limit": int, "offset": int, "lexical_mode": str, "snapshot": str},
    "stats": {"took_ms": int, "total_hits": int, "returned": int, "snapshot": str, "docs": int, "chunks": int, "tokens": int, "bytes": int, "parts": dict, "memory": dict},
    "error": {"code": str, "message": str},
}


def problems(answer: Any, want: Any = ANSWER, at: str = "answer") -> list[str]:
    """What is wrong with an answer; nulls are fine but where an error has to be told."""
    if at == "answer":
        missing = [f"{at} has no {k}" for k in ("ok", "schema_version") if k not in answer] + [f"{at}.error has no {k}" for k in ("code", "message") if "error" in answer and not answer["error"].get(k)]
        return missing + [x for k, v in answer.items() if k in want for x in problems(v, want[k], f"{at}.{k}")]
    if answer is None:
        return []
    if isinstance(want, list):
        return [f"{at} is no list"] if not isinstance(answer, list) else [x for k, v in enumerate(answer) for x in problems(v, want[0], f"{at}[{k}]")]
    if isinstance(want, dict):
        return [f"{at} is no object"] if not isinstance(answer, dict) else [x for k, v in answer.items() if k in want for x in problems(v, want[k], f"{at}.{k}")]
    return [] if isinstance(answer, want) and (want is bool or not isinstance(answer, bool)) else [f"{at} is {type(answer).__name__}, not {want.__name__}"]


def failure(error: Exception) -> dict[str, Any]:
    """The answer to what can't be done."""
    code = {"QueryError": "invalid_query", "FullTextSyntaxError": "invalid_query", "StoreError": "store_error"}.get(type(error).__name__, "error")
    return {"ok": False, "schema_version": str(SCHEMA_VERSION), "error": {"code": code, "message": str(error)}}


def json_lines(answer: dict[str, Any]) -> Iterator[str]:
    """A line about the answer, one per result, then the context if there is one."""
    yield json.dumps({"type": "meta"} | {k: v for k, v in answer.items() if k not in ("results", "context")}, ensure_ascii=False)
    for r in answer.get("results", ()):
        yield json.dumps({"type": "result"} | r, ensure_ascii=False)
    if "context" in answer:
        yield json.dumps({"type": "context"} | answer["context"], ensure_ascii=False)


def table(rows: list[Row], explain: bool = False) -> str:
    """Tab-separated lines: path, offset and text of chunks, path and id of documents; scores in front with ``explain``."""
    out = []
    for r in rows:
        cells = [r["doc"]["path"], str(r["chunk"]["offset"]), r["chunk"]["text"]] if r["chunk"] is not None else [r["doc"]["path"], r["doc"]["id"]]
        out.append("\t".join([f"{r['score'] or 0:.3f}", *cells] if explain else cells))
    return "\n".join(out)
