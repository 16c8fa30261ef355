"""Toxicity by a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams it contains. Each is scaled by the log of how much more often it stands
in labelled toxic texts than in others; a logistic regression with an L1 penalty learns weights for the scaled features, so
n-grams that say nothing get none, and a long text of plain prose doesn't drift. Scoring looks up all n-grams of a batch
with NumPy, and only the few with a weight are made distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct, map_text, mix, release, row_slices, text_bytes

#: n-gram sizes, bits of their hash, and the sample that is learned from: rows of each label at most.
SIZES = (3, 4, 5, 6)
BITS = 20
SAMPLE_TOXIC, SAMPLE_OTHER = 1500, 2500
#: Characters of a text that are learned from at most.
SAMPLE_CHARS = 50_000
SCHEMA = "score double"

_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Lower case of every code point; white space, and digits, become one character each."""
    global _fold
    if _fold is None:
        _fold = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isspace():
                _fold[c] = 32
            elif s.isdigit():
                _fold[c] = 48
            elif len(low := s.lower()) == 1:
                _fold[c] = ord(low)
    return _fold


def grams(data: np.ndarray, offsets: np.ndarray):
    """For each n-gram size: the hashed n-gram that begins at each character, and the text of each character (-1 where the
    n-gram would leave its text)."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    codes = fold_table()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    places = np.searchsorted(lead, offsets)
    row = np.repeat(np.arange(len(places) - 1), np.diff(places))
    code = mix(codes.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    rolling = np.zeros(len(codes), np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, max(SIZES) + 1):
        m = max(0, len(codes) - n + 1)
        rolling = rolling[:m] * base + code[n - 1 :]
        if n in SIZES:
            yield (rolling >> np.uint64(64 - BITS)).astype(np.int64), np.where(row[:m] == row[n - 1 :], row[:m], -1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, found = len(offsets) - 1, []
        for gram, row in grams(data, offsets):
            at = np.flatnonzero(self.weights[gram] != 0)
            at = at[row[at] >= 0]
            found.append(row[at] * (1 << BITS) + gram[at])
        keys = distinct(np.concatenate(found))
        total = np.bincount(keys >> BITS, weights=self.weights[keys & ((1 << BITS) - 1)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -700, 700)))


def features(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, n-gram) of all distinct n-grams of each text, some texts at a time."""
    column = pa.array(texts, pa.large_string())
    for begin, end in row_slices(column, most):
        data, offsets = text_bytes(column.slice(begin, end - begin))
        keys = distinct(np.concatenate([(row * (1 << BITS) + gram)[row >= 0] for gram, row in grams(data, offsets)]))
        yield (keys >> BITS) + begin, keys & ((1 << BITS) - 1)


def fit(texts: list[str], labels: np.ndarray, prior: float, penalty: float = 2e-4, rounds: int = 150, least_z: float = 3.0, most: int = 8_000) -> Model:
    """Weights from labelled texts; ``prior`` is the share of toxic ones among all labelled rows, which the intercept is
    set for. With one class only, or no telling n-gram, the score is the prior throughout."""
    labels = np.asarray(labels, float)
    weights = np.zeros(1 << BITS, np.float64)
    n_toxic, n_other = float(labels.sum()), float((1 - labels).sum())
    prior = float(np.clip(prior, 1e-4, 1 - 1e-4))
    base = float(np.log(prior / (1 - prior)))
    if not n_toxic or not n_other:
        return Model(weights.astype(np.float32), base)
    a, total = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for row, gram in features(texts):
        a += np.bincount(gram, weights=labels[row], minlength=1 << BITS)
        total += np.bincount(gram, minlength=1 << BITS)
    b = total - a
    pooled = (a + b + 1) / (n_toxic + n_other + 2)
    z = np.abs(a / n_toxic - b / n_other) / np.sqrt(pooled * (1 - pooled) * (1 / n_toxic + 1 / n_other))
    chosen = np.flatnonzero((a + b >= 3) & (z >= least_z))
    chosen = chosen[np.argsort(-z[chosen], kind="stable")[:most]]
    ratio = np.log((a[chosen] + 1) / (n_toxic + 2)) - np.log((b[chosen] + 1) / (n_other + 2))
    number = np.full(1 << BITS, -1)
    number[chosen] = np.arange(len(chosen))
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row, gram in features(texts):  # a second time, so that only chosen n-grams are ever held
        col = number[gram]
        rows.append(row[col >= 0])
        cols.append(col[col >= 0])
    row, col = np.concatenate(rows), np.concatenate(cols)
    if not len(col):
        return Model(weights.astype(np.float32), base)
    value = ratio[col]
    n = len(labels)
    # accelerated proximal gradient; the step comes from a power iteration for the largest curvature
    w, v, bias, v_bias, t = np.zeros(len(chosen)), np.zeros(len(chosen)), 0.0, 0.0, 1.0
    probe = np.ones(len(chosen))
    for _ in range(8):
        probe /= max(np.linalg.norm(probe), 1e-12)
        probe = np.bincount(col, weights=value * np.bincount(row, weights=value * probe[col], minlength=n)[row], minlength=len(chosen))
    rate = 1 / (0.25 * 1.1 * max(np.linalg.norm(probe), 1.0) / n + 0.25)
    for _ in range(rounds):
        out = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=value * v[col], minlength=n) + v_bias, -50, 50)))
        error = (out - labels) / n
        new = v - rate * np.bincount(col, weights=value * error[row], minlength=len(chosen))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_bias = v_bias - rate * error.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, v_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    weights[chosen] = w * ratio
    return Model(weights.astype(np.float32), float(bias + base - np.log(n_toxic / n_other)))


def learn(df: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = SAMPLE_TOXIC, other: int = SAMPLE_OTHER, chars: int = SAMPLE_CHARS) -> Model:
    """The model of a bounded sample of labelled rows: at most ``toxic`` and ``other`` rows of either label, in order of a
    hash of the id, among ``labels`` rows that are ``usable`` and have a label. The share of toxic ones is counted over all
    of them. A row whose text is null counts as an empty text; of a text, ``chars`` characters are learned from, and of rows
    with one id the least text, so what comes to the driver has a bound."""
    known = labels.where(usable & labels[label_col].isNotNull()).select(labels[id_col].alias("id"), (labels[label_col] > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    ordered = known.orderBy(F.xxhash64(F.col("id").cast("string")), "id")
    chosen = {r["id"]: r["y"] for y, most in ((1, toxic), (0, other)) for r in ordered.where(F.col("y") == y).limit(most).collect()}
    named = df.where(df[id_col].isin(list(chosen))).select(df[id_col].alias("id"), F.substring(F.coalesce(df[text_col].cast("string"), F.lit("")), 1, chars).alias("text"))
    rows = named.groupBy("id").agg(F.min("text").alias("text")).collect() if chosen else []
    rows.sort(key=lambda r: r["id"])
    total = sum(sizes.values())
    model = fit([r["text"] for r in rows], np.array([chosen[r["id"]] for r in rows], float), sizes.get(1, 0) / total if total else 0.0)
    del rows
    release()
    return model


def _worker(shared):
    def make():
        model: Model = shared.value
        return lambda column: {"score": model.score(*text_bytes(column))}

    return make


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.3) -> DataFrame:
    """One row per row of ``df``: id, ``keep`` columns, score and predicted (1 from ``threshold`` on).

    Null and empty texts get the score of a text without n-grams. Repeated rows stay, an empty table gives an empty result,
    other columns are ignored, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = map_text(df, [id_col, *keep], text_col, SCHEMA, _worker(shared))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
