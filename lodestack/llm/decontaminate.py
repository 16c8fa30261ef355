"""Benchmark decontamination with an FM-index for each shard of the training text.

A shard is one slice of an Arrow batch. Its words become numbers of the benchmark's vocabulary; a word that no test phrase
has can't be inside an occurrence, so runs of such words shrink to one separator, and stretches between separators that are
shorter than the shortest phrase go too. Over what is left, a suffix array gives the Burrows-Wheeler transform, stored as a
wavelet matrix. All test phrases are searched backwards at once through its ranks, and rows are turned into places by
walking to the next sampled suffix position. Occurrences then merge into removal spans. The text never leaves its task.

Test phrases go to the executors in blocks of bounded size; a benchmark larger than a block is searched block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import HashTable
from .common import ALNUM_WORD, distinct, map_text, rows_of, runs, span_hashes, stored, text_bytes

#: Words in a test phrase.
WINDOW = 10
#: Bytes of benchmark text that are collected and broadcast at once.
BLOCK_BYTES = 16 << 20
#: Bytes of text in one shard.
SHARD_BYTES = 2 << 20
#: Every so many text positions of a suffix array are kept.
SAMPLE = 8
SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers by prefix doubling."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, np.int64)
    ranked = text[order]
    rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
    step = 1
    while n and rank[order[-1]] < n - 1:
        ahead = np.zeros(n, np.int64)
        if step < n:
            ahead[:-step] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        # only suffixes that still share their rank are sorted again
        count = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(count[rank[order]] > 1)
        part = order[open_]
        part = part[np.argsort(key[part], kind="stable")]
        order[open_] = part
        ranked = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, one level for each bit."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.bits)):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.first = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            before = ones[at]
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + before, at - before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.first[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before that place."""
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            before = ones[at]
            bit = ones[at + 1] - before
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + before, at - before)
        return symbol, at - self.first[symbol]


class FMIndex:
    """Backward search and location in a text of symbols 1..symbols-1; 0 separates stretches and is never matched."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE) -> None:
        # separators differ from each other, so no comparison of suffixes runs past one
        apart = text == 0
        n_apart = int(apart.sum())
        order = suffix_array(np.where(apart, np.cumsum(apart) - 1, text + n_apart))
        before = text[order - 1]  # the text ends with a separator, which thereby precedes its first position
        self.tree = WaveletMatrix(before, symbols)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))[:-1]
        kept = (order % sample == 0) | (before == 0)
        self.kept_before = np.concatenate(([0], np.cumsum(kept)))
        self.kept = order[kept]
        self.n = len(text)

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases, given right-aligned in rows of symbols; empty ones have low >= high."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(1, phrases.shape[1] + 1):
            live = live[(sizes[live] >= j) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, -j]
            low[live] = self.less[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, rows = np.zeros(len(rows), np.int64), rows.copy()
        live, steps = np.arange(len(rows)), 0
        while len(live):
            at = rows[live]
            here = self.kept_before[at + 1] > self.kept_before[at]
            out[live[here]] = self.kept[self.kept_before[at[here]]] + steps
            live = live[~here]
            symbol, rank = self.tree.access(rows[live])
            rows[live] = self.less[symbol] + rank
            steps += 1
        return out


class Phrases:
    """Test phrases of some items: distinct windows in numbers of their own vocabulary, and the items of each."""

    def __init__(self, names: list[str], texts: list[str | None], window: int = WINDOW) -> None:
        data, offsets = text_bytes(pa.array(texts, pa.string()), lower=True)
        starts, ends, first = runs(ALNUM_WORD[data], offsets)
        vocabulary, number = np.unique(span_hashes(data, starts, ends), return_inverse=True)
        self.hashes = vocabulary
        self.symbols = len(vocabulary) + 1
        self.names = sorted(set(names))
        number_of = {name: k for k, name in enumerate(self.names)}
        seen: dict[tuple[int, ...], set[int]] = {}
        for item in range(len(names)):
            own = (number[first[item] : first[item + 1]] + 1).tolist()
            for k in range(max(1, len(own) - window + 1)) if own else ():
                seen.setdefault(tuple(own[k : k + window]), set()).add(number_of[names[item]])
        self.sizes = np.array([len(w) for w in seen], np.int64)
        self.windows = np.zeros((len(seen), window), np.int64)
        for k, w in enumerate(seen):
            self.windows[k, window - len(w) :] = w
        self.shortest = int(self.sizes.min()) if len(seen) else 0
        self.owners = np.array([i for w in seen.values() for i in sorted(w)], np.int64)
        self.owner_first = np.concatenate(([0], np.cumsum([len(w) for w in seen.values()]))).astype(np.int64)

    def table(self) -> HashTable:
        out = HashTable(max(8, (4 * len(self.hashes)).bit_length()))
        out.add(self.hashes, np.arange(1, len(self.hashes) + 1, dtype=np.int32))
        return out


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    size = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(size)), size)
    return low[owner] + np.arange(len(owner)) - (np.cumsum(size) - size)[owner], owner


def find_windows(symbol: np.ndarray, row: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word position, window) of every occurrence. ``symbol`` is 0 for words outside the vocabulary; ``row`` is the text
    of each word."""
    none = np.zeros(0, np.int64)
    if not len(symbol) or not len(phrases.windows):
        return none, none
    known = symbol > 0
    joined = np.zeros(len(symbol), dtype=bool)
    joined[1:] = known[1:] & known[:-1] & (row[1:] == row[:-1])
    begin = np.flatnonzero(known & ~joined)
    follows = np.zeros(len(symbol), dtype=bool)
    follows[:-1] = joined[1:]
    end = np.flatnonzero(known & ~follows) + 1
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return none, none
    where, stretch = _expand(begin, end)
    place = np.arange(len(where)) + stretch  # one separator after each stretch
    text = np.zeros(len(where) + len(begin), np.int64)
    text[place] = symbol[where]
    origin = np.zeros(len(text), np.int64)
    origin[place] = where
    index = FMIndex(text, phrases.symbols)
    low, high = index.search(phrases.windows, phrases.sizes)
    rows, window = _expand(low, high)
    return origin[index.locate(rows)], window


def _finder(shared, window: int):
    def make():
        phrases: Phrases = shared.value
        table = phrases.table()
        names = np.array(phrases.names, dtype=object)

        def work(column: pa.Array) -> dict:
            data, offsets = text_bytes(column, lower=True)
            starts, ends, first = runs(ALNUM_WORD[data], offsets)
            n, row = len(offsets) - 1, rows_of(first)
            symbol = np.maximum(table.find(span_hashes(data, starts, ends)), 0).astype(np.int64)
            place, which = find_windows(symbol, row, phrases)
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + phrases.sizes[which], -1)
            hit = np.cumsum(edge)[:-1] > 0
            # items of each text
            at, owner = _expand(phrases.owner_first[which], phrases.owner_first[which + 1])
            pairs = distinct(row[place[owner]] * len(names) + phrases.owners[at]) if len(at) else np.zeros(0, np.int64)
            item_row, item = (pairs // len(names), pairs % len(names)) if len(pairs) else (pairs, pairs)
            labels = names[item]
            order = np.lexsort((labels.astype(str), item_row)) if len(pairs) else np.zeros(0, np.int64)
            item_first = np.searchsorted(item_row, np.arange(n + 1))
            # spans: runs of hit words of one text
            new = np.zeros(len(hit), dtype=bool)
            new[:1] = True
            new[1:] = ~hit[:-1] | (row[1:] != row[:-1])
            last = np.ones(len(hit), dtype=bool)
            last[:-1] = ~hit[1:] | (row[1:] != row[:-1])
            begin, end = np.flatnonzero(hit & new), np.flatnonzero(hit & last)
            if len(begin):
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                base = chars[offsets[row[begin]]]
                spans = pa.StructArray.from_arrays([pa.array(chars[starts[begin]] - base), pa.array(chars[ends[end]] - base)], names=["begin", "end"])
            else:
                spans = pa.StructArray.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], names=["begin", "end"])
            span_first = np.searchsorted(row[begin], np.arange(n + 1))
            return {
                "n_words": np.diff(first).astype(np.int64),
                "n_hit": np.bincount(row[hit], minlength=n).astype(np.int64),
                "items": pa.ListArray.from_arrays(pa.array(item_first, pa.int32()), pa.array(labels[order].tolist(), pa.string())),
                "spans": pa.ListArray.from_arrays(pa.array(span_first, pa.int32()), spans),
            }

        return work

    return make


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``df``: id, ``keep`` columns, n_words, n_hit, the names of items found (distinct, sorted) and removal spans.

    Spans are half-open code point ranges of the text, in order, disjoint. Null and empty texts have no words; a null or
    empty benchmark text gives no phrase; a null item id is named "null". Repeated rows stay, an empty table gives an
    empty result, an empty benchmark no hits. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    items = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("null")).alias("name"), F.coalesce(benchmark[item_text_col].cast("string"), F.lit("")).alias("item_text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("item_text") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    parts = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("name", "item_text"), F.lit(blocks)) == k).collect()  # about block_bytes
        shared = spark.sparkContext.broadcast(Phrases([r["name"] for r in rows], [r["item_text"] for r in rows], window))
        columns = [id_col, *keep] if blocks == 1 else list(dict.fromkeys([id_col, *keep, text_col]))
        parts.append(map_text(df, columns, text_col, SCHEMA, _finder(shared, window), SHARD_BYTES))
    if blocks == 1:
        return parts[0]
    # equal rows give equal results, so rows are grouped by what they hold and then repeated as often as they came
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    same = list(dict.fromkeys([id_col, *keep, text_col]))
    merged = stored(
        every.withColumn("__key", F.sha2(F.to_json(F.struct(*same), {"ignoreNullFields": "false"}), 256))
        .groupBy("__key").agg(*[F.first(c).alias(c) for c in [*same, "n_words"]], (F.count("*") / blocks).cast("int").alias("__copies"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("__spans"))
    )
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    joined = F.aggregate(
        "__spans",
        F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)"),
        lambda out, s: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= s["begin"]), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(out, F.lit(-1))["begin"].alias("begin"), F.greatest(F.try_element_at(out, F.lit(-1))["end"], s["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s))),
    )
    inside = lambda s: F.size(F.regexp_extract_all(F.lower(F.substring(F.col(text_col), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))), F.lit(words), F.lit(0)))
    return (
        merged.withColumn("spans", joined)
        .withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + inside(s)))
        .withColumn("items", F.array_sort("items"))
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .select(id_col, *keep, "n_words", "n_hit", "items", "spans")
    )


def without_spans(text: str, spans: str = "spans") -> Column:
    """The text column with its spans cut out."""
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(
        F.concat(
            F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), lambda a, s: F.struct(F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (s["begin"] - a["at"]).cast("int"))).alias("out"), s["end"].alias("at")))["out"],
            F.substring(F.col(text), (F.element_at(spans, -1)["end"] + 1).cast("int"), F.length(text)),
        )
    )
