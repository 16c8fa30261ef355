"""Tables, settings and errors of the retrieval engine."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCHEMA_VERSION = 3
#: How the tables of a store are written: texts take a third less room than by default.
DENSE = {"compression": "zstd"}

DOC = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("mtime", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("hash", T.StringType(), False),
        T.StructField("tag", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("meta", T.StringType()),
        T.StructField("deleted", T.BooleanType(), False),
    ]
)
CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("tokens", T.LongType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("terms", T.ArrayType(T.StringType(), False), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
        T.StructField("deleted", T.BooleanType(), False),
    ]
)
#: Fields that queries may name.
DOC_FIELDS = ("id", "path", "mtime", "hash", "tag", "source", "meta")
CHUNK_FIELDS = ("id", "doc_id", "offset", "tokens", "text")
NUMERIC_FIELDS = {("chunk", "offset"), ("chunk", "tokens")}


class QueryError(ValueError):
    """A query, filter or full-text expression that can't be run."""


class StoreError(RuntimeError):
    """A store that is missing, locked or of another kind than asked for."""


@dataclass(frozen=True)
class Config:
    """Settings of a store and of searches over it."""

    store_path: str = "store"
    chunk_tokens: int = 256
    overlap_tokens: int = 32
    embedding: str = "hash"
    embedding_dim: int = 256
    bm25_weight: float = 0.5
    vector_weight: float = 0.5
    max_limit: int = 1000

    def __post_init__(self) -> None:
        if self.chunk_tokens < 1 or self.embedding_dim < 1 or self.max_limit < 0 or self.overlap_tokens < 0:
            raise ValueError("chunk_tokens and embedding_dim must be positive, overlap_tokens and max_limit not negative")

    @property
    def overlap(self) -> int:
        """The overlap that chunks can have: less than a chunk."""
        return min(self.overlap_tokens, self.chunk_tokens - 1)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """Settings of a TOML file; an overlap as long as a chunk becomes none, and unknown keys are an error."""
        with open(path, "rb") as f:
            found = tomllib.load(f)
        if unknown := set(found) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        if "embedding" in found:
            found["embedding"] = str(found["embedding"]).strip().lower()
        out = cls(**found)
        return replace(out, overlap_tokens=0) if out.overlap_tokens >= out.chunk_tokens else out


def config_file() -> Path | None:
    """The one file of settings: lodestack/lodestack.toml in the user's configuration folder."""
    base = os.environ.get("XDG_CONFIG_HOME") or (os.path.join(os.environ["HOME"], ".config") if os.environ.get("HOME") else None)
    return Path(base) / "lodestack" / "lodestack.toml" if base else None


def discover(start: str | Path = ".") -> tuple[Config, Path]:
    """The settings, and the store of a folder or of the nearest of its parents. A settings file beside the store is an error:
    settings have one place."""
    file = config_file()
    config = Config.load(file) if file and file.exists() else Config()
    store = Path(config.store_path) if Path(config.store_path).is_absolute() else find_store(start, config.store_path)
    if store is None or not store.exists():
        raise StoreError("there is no store here; make one with init")
    if (store.parent / "lodestack.toml").exists():
        raise StoreError(f"settings beside a store don't count; move {store.parent / 'lodestack.toml'} to {file}")
    return config, store


def find_store(start: str | Path, name: str) -> Path | None:
    """The store called ``name`` in a folder or the nearest of its parents."""
    here = Path(start).resolve()
    return next((p / name for p in (here, *here.parents) if (p / name).exists()), None)


@dataclass(frozen=True)
class Corpus:
    """The two tables that queries run over, and the index of the second if there is one."""

    doc: DataFrame
    chunk: DataFrame
    index: Any = None
