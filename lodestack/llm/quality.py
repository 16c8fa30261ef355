"""Quality rules by weak supervision.

Each rule looks at counts of one text and votes good (1), bad (0) or abstains (-1). Rules have no labels to learn from:
expectation-maximisation over the vote patterns of the whole corpus estimates how often each rule votes what, given a
hidden quality, and the posterior probability of good quality decides. The patterns are counted by Spark, so the fit sees
every document but only as many rows as there are patterns (at most 3 ** rules), however large the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORD, map_text, mix, per_row, rows_of, runs, span_hashes, stored, text_bytes, window_hashes

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_digits long, n_stops long"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:0xF5] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOPS = "a and are as be by for from in is it of on that the this to was with der die das und den von zu ist mit im für als auf de la le les des et en un une du que el los las y se del por para est qui dans".split()


def _times(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs."""
    order = np.argsort(keys)
    ranked = keys[order]
    edge = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True])))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(np.diff(edge), np.diff(edge))
    return out


def _counter():
    stop_table = None

    def work(column: pa.Array) -> dict:
        nonlocal stop_table
        if stop_table is None:
            words = [w.encode() for w in _STOPS]
            raw = np.frombuffer(b"".join(words), np.uint8)
            ends = np.cumsum([len(w) for w in words])
            stop_table = np.sort(span_hashes(raw, np.concatenate(([0], ends[:-1])), ends))
        data, offsets = text_bytes(column)
        is_word = SPACE_WORD[data]
        starts, ends, first = runs(is_word, offsets)
        row = rows_of(first)
        n = np.diff(first)
        lead = (data & 0xC0) != 0x80
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum(is_word & lead, out=chars[1:])
        byte_sum = lambda mask: per_row(mask, offsets)
        hashes = span_hashes(data, starts, ends)
        where = np.minimum(np.searchsorted(stop_table, hashes), len(stop_table) - 1)
        salt = mix(np.arange(1, len(n) + 1, dtype=np.uint64))
        repeated = np.zeros(len(hashes), dtype=bool)
        windows = window_hashes(hashes, 3)
        at = np.flatnonzero(row[:-2] == row[2:]) if len(windows) else np.zeros(0, np.int64)
        if len(at):
            twice = at[_times(windows[at] ^ salt[row[at]]) > 1]
            repeated[twice] = repeated[twice + 1] = repeated[twice + 2] = True
        line_starts, line_ends, line_first = runs(data != 10, offsets)
        words_before = np.searchsorted(starts, line_starts)
        with_word = np.searchsorted(starts, line_ends) > words_before
        line_row = rows_of(line_first)[with_word]
        keys = span_hashes(data, line_starts[with_word], line_ends[with_word]) ^ salt[line_row]
        order = np.argsort(keys, kind="stable")
        again = np.zeros(len(keys), dtype=bool)
        if len(keys):
            again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
        count = lambda rows: np.bincount(rows, minlength=len(n)).astype(np.int64)
        return {
            "n_words": n.astype(np.int64), "word_chars": chars[offsets[1:]] - chars[offsets[:-1]], "n_symbols": byte_sum(_SYMBOL[data]),
            "n_dup_lines": count(line_row[again]), "n_repeat_words": per_row(repeated, first), "n_lines": count(line_row),
            "n_upper": byte_sum(_UPPER[data]), "n_letters": byte_sum(_LETTER[data]), "n_digits": byte_sum(_DIGIT[data]), "n_stops": per_row(stop_table[where] == hashes, first),
        }

    return work


def text_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the counts that the rules look at. A null or empty text has zeros everywhere."""
    return map_text(df, [id_col], text_col, COUNTS, _counter)


def rule_votes() -> dict[str, Column]:
    """Rule name -> vote: 1 good, 0 bad, -1 abstains. A text without words gets a bad vote for length only."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda name: F.col(name) / n

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1)

    some = F.col("n_words") > 0
    return {
        "length": vote(F.col("n_words").between(80, 50_000), F.col("n_words") < 50),
        "word_length": vote(some & (F.col("word_chars") / n).between(3, 8), some & ~(F.col("word_chars") / n).between(2, 12)),
        "symbols": vote(some & (share("n_symbols") < 0.02), share("n_symbols") > 0.3),
        "repeated_lines": vote(some & (F.col("n_dup_lines") == 0), F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        "repeated_words": vote(some & (share("n_repeat_words") < 0.1), share("n_repeat_words") > 0.3),
        "capitals": vote(some & (F.col("n_upper") < 0.1 * F.col("n_letters")), F.col("n_upper") > 0.4 * F.col("n_letters")),
        "stop_words": vote(share("n_stops") > 0.1, some & (share("n_stops") < 0.03)),
        "digits": vote(some & (share("n_digits") < 0.3), share("n_digits") > 2.0),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.8, rounds: int = 100, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: posterior of each pattern, P(vote | quality), P(good).

    ``patterns`` is m x rules of {-1, 0, 1}; ``counts`` says how many documents show each. It starts from the majority
    vote, so that "good" keeps its meaning. Without any document, the prior is returned.
    """
    m, rules = patterns.shape
    votes = patterns + 1
    good = (patterns == 1).sum(1) - 2.0 * (patterns == 0).sum(1)
    posterior = 1 / (1 + np.exp(-good))
    table = np.full((rules, 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        prior = float((weight[1].sum() + 8) / (counts.sum() + 10)) if m else prior
        for j in range(rules):
            for quality in (0, 1):
                seen = np.bincount(votes[:, j], weights=weight[quality], minlength=3) + [1, 1 + (quality == 0), 1 + (quality == 1)]
                table[j, quality] = seen / seen.sum()
        chance = np.log([1 - prior, prior])[:, None] + sum((np.log(table[j][:, votes[:, j]]) for j in range(rules)), np.zeros((2, m)))
        new = 1 / (1 + np.exp(np.clip(chance[0] - chance[1], -700, 700)))
        if m == 0 or np.abs(new - posterior).max() < tolerance:
            return new, table, prior
        posterior = new
    return posterior, table, prior


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """One row per row of ``df``: id, counts, base_failed, posterior (``quality``) and kept.

    Null and empty texts have zero words and fail the base rule. Rows with equal text get equal results; repeated rows
    stay. An empty table gives an empty result. Other columns of ``df`` are ignored, whatever their names.
    """
    rules = rule_votes()
    counted = stored(text_counts(df, id_col, text_col).withColumn("votes", F.concat_ws(",", *[r.cast("string") for r in rules.values()])))
    seen = counted.groupBy("votes").count().collect()  # at most 3 ** 8 rows
    patterns = np.array([[int(x) for x in r["votes"].split(",")] for r in seen], dtype=np.int64).reshape(len(seen), len(rules))
    posterior, _, _ = fit_votes(patterns, np.array([r["count"] for r in seen], dtype=float))
    spark: SparkSession = df.sparkSession
    table = spark.createDataFrame([(r["votes"], float(p)) for r, p in zip(seen, posterior)], "votes string, quality double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    names = [x.split()[0] for x in COUNTS.split(", ")]
    return (
        counted.join(F.broadcast(table), "votes")
        .select(id_col, *names[:5], failed.alias("base_failed"), "quality")
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )
