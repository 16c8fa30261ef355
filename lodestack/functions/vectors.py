"""Embeddings and similarity."""

from __future__ import annotations

import base64
import hashlib
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import release


#: Places of vectors that are summed up at a time.
EMBED_PLACES = 1 << 18


class Embedder(Protocol):
    """Makes vectors of ``dim`` floats from token arrays; ``name`` is kept with the store."""

    name: str
    dim: int

    def column(self, tokens: Column) -> Column: ...

    def query(self, text: str) -> list[float]: ...


def _place(token: str, dim: int) -> tuple[int, int]:
    value = int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "little")
    return value % dim, 1 if value >> 63 else -1


def _unit(vector: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vector)
    return (vector / norm if norm else vector).astype(np.float32)


class HashEmbedder:
    """Signed feature hashing: each token adds +1 or -1 at a place that its SHA-256 tells; vectors have length 1."""

    name = "hash"

    def __init__(self, dim: int = 256) -> None:
        self.dim = dim

    def place(self, token: Column) -> Column:
        """struct(idx, sign) of a token: the hash's first eight bytes, little end first, give both."""
        h = F.sha2(token, 256)
        swapped = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(8))])
        value = F.conv(swapped, 16, 10).cast("decimal(20,0)")
        return F.struct((value % self.dim).cast("int").alias("idx"), F.when(value >= F.lit("9223372036854775808").cast("decimal(20,0)"), 1).otherwise(-1).alias("sign"))

    def column(self, tokens: Column) -> Column:
        """Vectors of token arrays, a batch at a time: built-in functions would copy a vector for every token."""
        dim = self.dim

        def vectors(lists: pa.Array) -> np.ndarray:
            words, size = lists.flatten().dictionary_encode(), lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            places = np.array([_place(t, dim) for t in words.dictionary.to_pylist()], np.int64).reshape(-1, 2)[words.indices.to_numpy()]
            row = np.repeat(np.arange(len(size)), size)
            sums = np.bincount(row * dim + places[:, 0], weights=places[:, 1], minlength=len(size) * dim).reshape(-1, dim)
            norm = np.sqrt(np.square(sums).sum(1, keepdims=True))
            return (sums / np.where(norm > 0, norm, 1)).astype(np.float32)

        @F.arrow_udf("array<float>")
        def embed(lists: pa.Array) -> pa.Array:
            unit = np.zeros((len(lists), dim), np.float32)
            step = max(1, EMBED_PLACES // dim)
            for k in range(0, len(lists), step):
                unit[k : k + step] = vectors(lists.slice(k, step))
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dim), pa.array(unit.reshape(-1)), mask=lists.is_null())
            del lists, unit
            release()
            return out

        return embed(tokens)

    def query(self, text: str) -> list[float]:
        out = np.zeros(self.dim)
        for token in text.split():
            at, sign = _place(token, self.dim)
            out[at] += sign
        return _unit(out).tolist()


def cosine(column: Column, vector: list[float]) -> Column:
    """Cosine similarity to a fixed vector; null for a vector without length, of another dimension, or with a null in it. One
    product of a matrix and a vector for every batch of rows."""
    fixed = np.asarray(vector, np.float64)
    norm, dim = float(np.sqrt(np.square(fixed).sum())), len(fixed)

    @F.arrow_udf("double")
    def similarity(own: pa.Array) -> pa.Array:
        out, good = np.zeros(len(own)), np.zeros(len(own), dtype=bool)
        if dim and norm:
            whole = pc.fill_null(pc.equal(pc.list_value_length(own), dim), False)
            rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            flat = own.filter(whole).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            length = np.sqrt(np.square(flat).sum(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                out[rows] = (flat * fixed).sum(1) / (length * norm)  # row by row, so equal vectors have equal similarities
            good[rows] = length > 0
        return pa.array(out, mask=~good)

    return similarity(column)


def to_base64(vector: list[float]) -> str:
    """Little-endian 32-bit floats in base64, as exported rows carry them."""
    return base64.b64encode(np.asarray(vector, "<f4").tobytes()).decode()


def from_base64(text: str) -> list[float]:
    return [float(x) for x in np.frombuffer(base64.b64decode(text), "<f4")]
