"""N-gram Jaccard join with PartEnum signatures.

A document's set holds its distinct 5-word shingles. Equal sets form one class, and classes are what is joined. Two sets of
similarity 0.8 or more have sizes of one band or of neighbouring bands, and differ in at most k shingles, k fixed by the
band. The shingle domain is hashed into n > k partitions; at least n - k of them hold the same part of both sets, so similar
sets share the signatures of so many partitions. A partition that is empty in both says nothing; n leaves room for these,
and a set with more empty partitions than that is signed once more under another hash, so no pair is lost.

Signatures only propose candidates: sets that share fewer signatures than similar ones must are sieved out, and those that
meet in one are linked to the least of them, never pairwise. Short texts around one phrase connect to very large sets of
candidates; these are connected anew by the rarest shingles of each set, of which similar sets share one. Within a connected
set of candidates, all pairs are decided exactly by counting common shingles, in blocks of bounded size, after turning every
set into its difference from the majority set, which makes near copies of one text cheap. Blocks of a very large one meet in
several passes, so that what is on disk at a time keeps to the size of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, bound_batches, discard, map_text, mix, pack, release, row_slices, rows_of, runs, span_hashes, stored, text_bytes, unpack, window_hashes
from .graph import components, forest

SHINGLE = 5
#: Similarity as a fraction: 100 * common >= 80 * union.
PERCENT = 80
ROUNDS = 4
#: Classes and shingles in one block of exact counting.
BLOCK_SETS, BLOCK_SHINGLES = 1500, 1_500_000
#: Shingles of which every task is told how many sets have them: the most frequent ones, if more than ``RARE`` sets do.
FREQUENT, RARE = 200_000, 8
#: Rows that may be broadcast to pick out documents.
BROADCAST_ROWS = 1_000_000
#: Bytes of input for each part of the signature space (what one task sorts at once), and of text in one slice that is signed.
#: Less takes less memory in a worker, and more bytes in the shuffle.
PART_BYTES, SLICE = 8 << 20, 4 << 20
_SALTS = [np.uint64(int(x)) for x in np.random.default_rng(7).integers(1, 2**63, 2 * ROUNDS)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the places at which texts begin in them. The bytes are lower-case."""
    starts, ends, first = runs(SPACE_WORD[data], offsets)
    words, n = span_hashes(data, starts, ends), len(offsets) - 1
    count = np.diff(first)
    out = np.zeros(len(words), np.uint64)
    place = np.maximum(count - size + 1, np.minimum(count, 1))
    begin = np.concatenate(([0], np.cumsum(place)))
    windows = window_hashes(words, size)
    row = rows_of(first)
    whole = np.flatnonzero(row[: len(windows)] == row[size - 1 :][: len(windows)])
    full = count >= size
    target = np.zeros(int(begin[-1]), dtype=bool)
    for r in np.flatnonzero((count > 0) & ~full):
        k = int(count[r])
        out[begin[r]] = mix(window_hashes(words[first[r] : first[r] + k], k) + np.uint64(k))[0]
        target[begin[r]] = True
    out = out[: begin[-1]]
    out[~target] = windows[whole]
    for r in range(n):
        out[begin[r] : begin[r + 1]].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][begin[:-1] < len(out)]] = True
    return out[new], np.concatenate(([0], np.cumsum(new)))[begin]


def set_keys(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, 0 for the empty one."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets ^ _SALTS[0]))))
    size = np.diff(first).astype(np.uint64)
    return np.where(size > 0, mix(total[first[1:]] - total[first[:-1]] + size) | np.uint64(1), np.uint64(0)).view(np.int64)


@lru_cache(maxsize=4)
def bands(most: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least sizes of the size bands up to ``most``; for the group of each band and the next: partitions, room for empty
    ones, and how many signatures a pair shares at least. A group covers pairs within its band and pairs of a set of its
    band with one of the next."""
    low, parts, room, need = [], [], [], []
    a = 1
    while a <= most or len(low) < 2:
        b = a * 100 // percent
        # sizes x <= b and y <= x * 100 / percent differ in at most (x + y) * (100 - percent) / (100 + percent) shingles
        k = b * (100 - percent) // percent
        share = 1 + k // 6
        spare, n = 0, k + share
        for _ in range(4 if k else 0):
            empty = n * (1 - 1 / n) ** a
            spare = int(np.ceil(empty + 1.5 * empty**0.5))
            n = k + share + spare
        low.append(a)
        parts.append(n)
        room.append(spare)
        need.append(share)
        a = b + 1
    return np.array(low), np.array(parts), np.array(room), np.array(need)


def signatures(sets: np.ndarray, first: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number, turn) of all signatures of all sets, in order of sets. A turn is a group and a hash: turn
    ``group * ROUNDS + hash``."""
    size = np.diff(first)
    low, parts, room, _ = bands(int(max(1, size.max(initial=1))), percent)
    band = np.searchsorted(low, size, "right") - 1
    out_sig, out_set, out_turn = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for back in (0, 1):
        group = band - back
        todo = np.flatnonzero((size > 0) & (group >= 0))
        for turn in range(ROUNDS):
            if not len(todo):
                break
            n = parts[group[todo]]
            base = np.concatenate(([0], np.cumsum(n)))
            where = np.repeat(first[todo] - np.concatenate(([0], np.cumsum(size[todo])))[:-1], size[todo]) + np.arange(int(size[todo].sum()))
            h = mix(sets[where] ^ _SALTS[2 * turn])
            owner = np.repeat(np.arange(len(todo)), size[todo])
            part = base[owner] + (((h >> np.uint64(32)) * n[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            g = mix(h + _SALTS[2 * turn + 1])
            # sums of 64-bit hashes, exact in two halves of floating point
            a = np.bincount(part, weights=(g & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=base[-1]).astype(np.uint64)
            b = np.bincount(part, weights=(g >> np.uint64(32)).astype(np.float64), minlength=base[-1]).astype(np.uint64)
            owner = np.repeat(np.arange(len(todo)), n)
            slot = np.arange(base[-1]) - base[owner]
            own_turn = group[todo] * ROUNDS + turn
            empty = (a == 0) & (b == 0)
            sig = mix(a + (b << np.uint64(32)) + mix((own_turn[owner].astype(np.uint64) << np.uint64(32)) + slot.astype(np.uint64)))
            more = np.bincount(owner[empty], minlength=len(todo)) > room[group[todo]]
            keep = ~empty
            if turn == ROUNDS - 1:
                keep |= more[owner]
            out_sig.append(sig[keep])
            out_set.append(todo[owner[keep]])
            out_turn.append(own_turn[owner[keep]])
            todo = todo[more]
    sig, owner, turn = np.concatenate(out_sig), np.concatenate(out_set), np.concatenate(out_turn)
    order = np.argsort(owner, kind="stable")
    return sig[order], owner[order], turn[order]


def _describe():
    def work(column: pa.Array) -> dict:
        sets, first = shingle_sets(*text_bytes(column, lower=True))
        key = set_keys(sets, first)
        return {"n_shingles": np.diff(first), "set_key": pa.array(key, mask=key == 0)}

    return work


def _meetings(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry: whether it is the first one of its signature's least node, that node, and whether different nodes
    have the signature."""
    order = np.argsort(sig)
    ranked, who = sig[order], node[order]
    fresh = np.ones(len(sig), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, len(sig)))
    least = np.repeat(np.minimum.reduceat(who, begin), count) if len(sig) else who
    most = np.repeat(np.maximum.reduceat(who, begin), count) if len(sig) else who
    heads = np.flatnonzero(who == least)
    group = np.repeat(np.arange(len(begin)), count)
    heads = heads[np.concatenate(([True], group[heads][1:] != group[heads][:-1]))] if len(heads) else heads
    head, lead, shared = np.zeros(len(sig), dtype=bool), np.empty_like(node), np.empty(len(sig), dtype=bool)
    head[order[heads]] = True
    lead[order], shared[order] = least, most != least
    return head, lead, shared


def _codes(sig: np.ndarray, turn: np.ndarray, parts: int) -> np.ndarray:
    """Signatures as they travel: the part of the signature space (24 bits), the turn (10 bits) and 30 bits of the hash.
    Signatures of one code by chance only propose more candidates."""
    part = ((sig >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return (part << np.uint64(40)) | (turn.astype(np.uint64) << np.uint64(30)) | (sig & np.uint64((1 << 30) - 1))


def _turns(code: np.ndarray) -> np.ndarray:
    return ((code >> np.uint64(30)) & np.uint64(1023)).astype(np.int64)


def _entries(code: np.ndarray, node: np.ndarray, edges: bool = False) -> pa.RecordBatch | None:
    """Rows for the parts of the signature space: each signature with its least node only. Entries of signatures that several
    nodes have here go along in even shares with all the rows, so that no part gets more of them than others. A share goes to
    any part, where nodes of one signature don't meet again, so to be linked they go as ``edges``: least node and node.

    Entries of a part are in order of signatures, of which the differences are sent: few bytes each, however many parts."""
    if not len(code):
        return None
    head, lead, shared = _meetings(code, node)
    if edges:
        link_code, link_node = forest(lead[node != lead], node[node != lead])
        link_code, link_node = link_node.astype(np.uint64), link_code
    else:
        link_code, link_node = code[shared], node[shared]
    order = np.lexsort((link_code, link_node))
    link_code, link_node = link_code[order], link_node[order]
    order = np.flatnonzero(head)
    order = order[np.argsort(code[order])]
    code, node = code[order], node[order]
    part = code >> np.uint64(40)
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    step = code.copy()
    step[1:] -= code[:-1]
    step[cut[:-1]] = code[cut[:-1]] & np.uint64((1 << 40) - 1)
    share = np.linspace(0, len(link_code), len(cut)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pack(step, cut, 5, True), pack(node, cut, 6), pack(link_code, share, 8), pack(link_node, share, 6)], names=["part", "codes", "nodes", "link_codes", "link_nodes"])


ENTRIES = "part int, codes binary, nodes binary, link_codes binary, link_nodes binary"
SHARED = "node long, turn int, n int, need int, codes binary"
#: Nodes are set keys of 48 bits; sets of one node by chance only propose more candidates.
NODE_BITS = 48


def _different(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different sets of a slice of texts, but the empty one, the n+1 offsets of theirs, and their nodes."""
    sets, first = shingle_sets(*text_bytes(column, lower=True))
    key = set_keys(sets, first)
    _, pick = np.unique(key, return_index=True)
    pick = np.sort(pick[key[pick] != 0])
    size = np.diff(first)[pick]
    own = np.concatenate(([0], np.cumsum(size)))
    return sets[np.repeat(first[pick] - own[:-1], size) + np.arange(int(own[-1]))], own, key[pick] & ((1 << NODE_BITS) - 1)


def _sign(parts: int, percent: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for begin, end in row_slices(column, most):
                sets, first, node = _different(column.slice(begin, end - begin))
                sig, owner, turn = signatures(sets, first, percent)
                if (rows := _entries(_codes(sig, turn, parts), node[owner])) is not None:
                    yield rows
            sets = sig = owner = turn = rows = None  # else the last slice's memory can't be given back
            del batch, column
            release()

    return run


def _count(parts: int, most: int):
    """Shingles by part, and how many sets of a slice have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for begin, end in row_slices(column, most):
                shingle, times = np.unique(_different(column.slice(begin, end - begin))[0], return_counts=True)
                if not len(shingle):
                    continue
                part = ((shingle >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
                yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pack(shingle, cut, 8), pack(times, cut, 4)], names=["part", "shingles", "times"])
            del batch, column
            release()

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent shingles of a part, and how many sets have them."""
    cols: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
    for batch in batches:
        for k, width in ((0, 8), (1, 4)):
            cols[k].append(unpack(batch.column(k + 1), width)[0])
    shingle, at = np.unique(np.concatenate(cols[0]), return_inverse=True)
    times = np.bincount(at, weights=np.concatenate(cols[1]).astype(np.float64), minlength=len(shingle)).astype(np.int64)
    top = np.argsort(-times, kind="stable")[:FREQUENT]
    top = top[times[top] > RARE]
    for k in range(0, len(top), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(shingle[top[k : k + 100_000]].view(np.int64)), pa.array(times[top[k : k + 100_000]])], names=["shingle", "times"])
    del cols, shingle, at, times, top
    release()


def prefixes(sets: np.ndarray, first: np.ndarray, frequent: np.ndarray, times: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number, turn) of the rarest shingles of every set, as many as leave less than a similar set shares at
    least: two similar sets have one of these in common, whatever the order, as long as it is the same for all sets.
    ``frequent`` holds shingles, sorted, with the ``times`` by which they are ordered; others come before them."""
    size = np.diff(first)
    owner = rows_of(first)
    low, *_ = bands(int(max(1, size.max(initial=1))), percent)
    band = np.searchsorted(low, size, "right") - 1
    often = np.zeros(len(sets), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, sets), len(frequent) - 1)
        often = np.where(frequent[at] == sets, times[at], 0)
    order = np.lexsort((sets, often, owner))
    take = size + percent * -size // 100 + 1  # the least number that similar sets share is rounded up
    kept = order[np.arange(len(sets)) - first[:-1][owner] < take[owner]]
    out = []
    for back in (0, 1):
        own = kept[band[owner[kept]] >= back]
        turn = (band[owner[own]] - back) * ROUNDS
        out.append((mix(sets[own] + mix(turn.astype(np.uint64))), owner[own], turn))
    return tuple(np.concatenate(x) for x in zip(*out))


def _sign_prefixes(parts: int, percent: int, most: int, frequent: np.ndarray, times: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for begin, end in row_slices(column, most):
                sets, first, node = _different(column.slice(begin, end - begin))
                sig, owner, turn = prefixes(sets, first, frequent, times, percent)
                if (rows := _entries(_codes(sig, turn, parts), node[owner], True)) is not None:
                    yield rows
            sets = sig = owner = turn = rows = None
            del batch, column
            release()

    return run


def _resign(edges: bool):
    """Entries again, of the signatures that nodes still share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, cut = unpack(batch.column(1), 8)
            if (rows := _entries(code, np.repeat(batch.column(0).to_numpy(), np.diff(cut)), edges)) is not None:
                yield rows
            release()

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and nodes of a part, and those that were found shared before."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
    for batch in batches:
        step, cut = unpack(batch.column(1), 5, True)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(step)))
        base = batch.column(0).to_numpy().astype(np.uint64) << np.uint64(40)
        out[0].append(total[1:] + np.repeat(base - total[cut[:-1]], np.diff(cut)))
        for k, width in ((1, 6), (2, 8), (3, 6)):
            x, _ = unpack(batch.column(k + 1), width)
            out[k].append(x.astype(out[k][0].dtype))
    return tuple(np.concatenate(x) for x in out)


def _meet(percent: int):
    """Signatures that several nodes share, by node and turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, node, link_code, link_node = _gather(batches)
        _, _, shared = _meetings(code, node)
        code, node = np.concatenate([code[shared], link_code]), np.concatenate([node[shared], link_node])
        order = np.lexsort((code, _turns(code), node))
        code, node = code[order], node[order]
        new = np.ones(len(code), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (node[1:] != node[:-1])
        code, node = code[new], node[new]
        turn = _turns(code)
        cut = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (turn[1:] != turn[:-1]), [True]))) if len(code) else np.zeros(1, np.int64)
        need, size = [], 1
        while len(need) <= int(turn.max(initial=0)) // ROUNDS:
            need, size = bands(size, percent)[3], size * 2
        for k in range(0, len(cut) - 1, 50_000):
            own = cut[k : k + 50_001]
            a = own[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(turn[a], pa.int32()), pa.array(np.diff(own), pa.int32()), pa.array(need[turn[a] // ROUNDS], pa.int32()), pack(code[own[0] : own[-1]], own - own[0], 8)], names=["node", "turn", "n", "need", "codes"])
        del code, node, turn, link_code, link_node, shared, order, new
        release()

    return run


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest that links nodes of one signature."""
    code, node, link_lead, link_node = _gather(batches)
    _, lead, _ = _meetings(code, node)
    x, y = forest(np.concatenate([lead[node != lead], link_lead.astype(np.int64)]), np.concatenate([node[node != lead], link_node]))
    for k in range(0, len(x), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]), pa.array(y[k : k + 100_000])], names=["a", "b"])
    del code, node, link_lead, link_node, lead, x, y
    release()


def candidates(texts: DataFrame, parts: int, percent: int = PERCENT, peels: int = 2, slice_bytes: int = SLICE) -> DataFrame:
    """Edges (a, b) of set keys that connect all pairs of similar sets of a one-column table of texts.

    A similar pair shares at least ``need`` signatures of one turn, so a set that shares fewer than that with all others
    together has no partner in this turn. Its signatures there are dropped, which may leave others with too few, so the
    sieve is applied ``peels`` times. What is left is linked to the least set of each signature. Signatures of many sets are
    made one in every task before they travel, so no part gathers more of one signature than there are tasks' slices.
    """
    if parts >= 1 << 24:
        raise ValueError("the signature space has 2**24 parts at most: make them larger")
    bound_batches(texts.sparkSession)
    shared = stored(texts.mapInArrow(_sign(parts, percent, slice_bytes), ENTRIES).repartitionById(parts, "part").mapInArrow(_meet(percent), SHARED))
    for peel in range(peels):
        enough = shared.groupBy("node", "turn").agg(F.sum("n").alias("total"), F.max("need").alias("need")).where(F.col("total") >= F.col("need")).select("node", "turn")
        left = shared.join(enough, ["node", "turn"], "left_semi").select("node", "codes")
        again = left.mapInArrow(_resign(peel == peels - 1), ENTRIES).repartitionById(parts, "part")
        last, shared = shared, stored(again.mapInArrow(_meet(percent), SHARED) if peel < peels - 1 else again.mapInArrow(_link, "a long, b long"))
        discard(last)
    return shared


def rare_candidates(texts: DataFrame, parts: int, percent: int = PERCENT, slice_bytes: int = SLICE) -> DataFrame:
    """Edges like those of ``candidates``, by the rarest shingles of every set. Phrases that very many texts have in common,
    which signatures of small sets may consist of, come last in the order of shingles and link no texts here."""
    bound_batches(texts.sparkSession)
    counted = texts.mapInArrow(_count(parts, slice_bytes), "part int, shingles binary, times binary").repartitionById(parts, "part").mapInArrow(_add_up, "shingle long, times long")
    top = counted.orderBy(F.desc("times"), "shingle").limit(FREQUENT).toArrow()
    frequent, times = top["shingle"].to_numpy().astype(np.int64).view(np.uint64), top["times"].to_numpy().astype(np.int64)
    order = np.argsort(frequent)
    signed = texts.mapInArrow(_sign_prefixes(parts, percent, slice_bytes, frequent[order], times[order]), ENTRIES)
    return stored(signed.repartitionById(parts, "part").mapInArrow(_link, "a long, b long"))


def _part_count(df: DataFrame, text_col: str, each: int) -> int:
    """Shuffle partitions so that each holds about ``each`` bytes of the input, at least the session's number. A table whose
    plan doesn't know its size, as one not read from files, is measured."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 55:
        size = df.agg(F.coalesce(F.sum(F.octet_length(df[text_col].cast("string"))), F.lit(0))).first()[0]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def links_within(sets: np.ndarray, first: np.ndarray, cut: int | None = None, percent: int = PERCENT) -> np.ndarray:
    """Symmetric matrix of linked sets; with ``cut``, only between those before and those from it on."""
    m, size = len(first) - 1, np.diff(first)
    value, col = np.unique(sets, return_inverse=True)
    row = np.repeat(np.arange(m), size)
    times = np.bincount(col, minlength=len(value))
    flip = np.flatnonzero(times * 2 > m)
    if m > 8 and len(flip):
        # difference from the majority set: its shingles count for the sets that lack them
        has = np.zeros((m, len(flip)), dtype=bool)
        number = np.full(len(value), -1)
        number[flip] = np.arange(len(flip))
        inside = number[col] >= 0
        has[row[inside], number[col[inside]]] = True
        lack_row, lack = np.nonzero(~has)
        row, col = np.concatenate([row[~inside], lack_row]), np.concatenate([col[~inside], flip[lack]])
    weight = np.bincount(row, minlength=m)
    times = np.bincount(col, minlength=len(value))
    shared = times[col] > 1
    row, col = row[shared], col[shared]
    order = np.argsort(col, kind="stable")
    by_col = row[order]
    start = np.concatenate(([0], np.cumsum(np.bincount(col, minlength=len(value)))))
    order = np.argsort(row, kind="stable")
    by_row = col[order]
    row_start = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=m))))
    out = np.zeros((m, m), dtype=bool)
    for i in range(m if cut is None else cut):
        own = by_row[row_start[i] : row_start[i + 1]]
        length = start[own + 1] - start[own]
        at = np.repeat(start[own] - np.concatenate(([0], np.cumsum(length)))[:-1], length) + np.arange(int(length.sum()))
        common = np.bincount(by_col[at], minlength=m)
        apart = weight[i] + weight - 2 * common
        both = size[i] + size
        # common = (both - apart) / 2 and union = (both + apart) / 2
        out[i] = 100 * (both - apart) >= percent * (both + apart)
    if cut is not None:
        out[:, :cut] = False
        out[cut:] = False
    np.fill_diagonal(out, False)
    return out | out.T


def _verify(percent: int):
    def decide(group: list[tuple[int, int, int, str]], same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        group = list({g[0]: g for g in group}.values())
        group.sort(key=lambda g: (g[2], g[0]))
        key = np.array([g[0] for g in group], np.int64)
        copies = np.array([g[1] for g in group], np.int64)
        cut = None if same else sum(g[2] == 0 for g in group)
        linked = links_within(*shingle_sets(*text_bytes(pa.array([g[3] for g in group], pa.large_string()), lower=True)), cut, percent)
        seen = np.zeros(len(key), dtype=bool)
        child, parent = [], []
        for r in np.argsort(key):
            if seen[r]:
                continue
            seen[r] = True
            front = np.array([r])
            while len(front):
                front = np.flatnonzero(linked[front].any(0) & ~seen)
                seen[front] = True
                child.extend(key[front].tolist())
                parent.extend([int(key[r])] * len(front))
        return key, linked @ copies, np.array(child, np.int64), np.array(parent, np.int64)

    def emit(out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, n = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
        child, parent = np.concatenate([x[2] for x in out]), np.concatenate([x[3] for x in out])
        of_key = np.arange(len(key) + len(child)) < len(key)  # a class and its links, then the forest of links
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, child])), pa.array(np.concatenate([n, 0 * child])), pa.array(np.concatenate([key, parent]), mask=of_key)], names=["set_key", "links", "up"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out, held = None, [], [], 0
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(7)]
            for root, i, j, side, key, copies, text in zip(*cols):
                if (root, i, j) != now:
                    if len(group) > 1:
                        out.append(decide(group, now[1] == now[2]))
                        held += len(group)
                        if held > 20_000:
                            yield emit(out)
                            out, held = [], 0
                    now, group = (root, i, j), []
                group.append((key, copies, side, text))
        if len(group) > 1:
            out.append(decide(group, now[1] == now[2]))
        if out:
            yield emit(out)
        del out, group
        release()

    return run


def pick_rows(df: DataFrame, picked: DataFrame, on: list[str] | Column, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` joined with picked rows; these are broadcast if they are at most ``most``, else both sides are shuffled."""
    few = picked.limit(most + 1).count() <= most
    return df.join(F.broadcast(picked) if few else picked.hint("shuffle_merge"), on, how)


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, n_similar, component_id.

    Every row is a document, so a repeated row is linked with its copies, and rows of one id with different texts are as many
    documents. Null texts, and texts without words, have empty sets: no links, and their own id as component. component_id is
    the least id that links lead to (a null id is never the least). An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    return _similar(df, id_col, text_col, percent).select(F.col("id").alias(id_col), "n_shingles", "n_similar", F.col("component").alias("component_id"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, part_bytes: int = PART_BYTES, slice_bytes: int = SLICE) -> DataFrame:
    """``df`` with one document of each component: the one with the least id.

    Documents without words all stay. Every row is a document. Of a component's rows with its least id, those of one text
    stay, made one. Rows without an id go if a document with an id is in their component; else those of one text are kept.
    """
    found = stored(_similar(df, id_col, text_col, percent, part_bytes, slice_bytes).where(F.col("n_shingles") > 0).select("id", "alt", "component", "component_alt"))
    stays = F.col("id").eqNullSafe(F.col("component")) & (F.col("alt") == F.col("component_alt"))
    gone = found.where(~stays).select(F.col("id").alias("__gone"), F.col("alt").alias("__alt")).distinct()
    again = found.where(stays).groupBy("id", "alt").count().where(F.col("count") > 1).limit(1).count()
    rest = pick_rows(df, gone, F.col(id_col).eqNullSafe(F.col("__gone")) & (_text_number(df[text_col]) == F.col("__alt")), "left_anti")
    return rest.dropDuplicates([id_col, text_col]) if again else rest


def _text_number(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(text.cast("string"))


def _passes(candidate: DataFrame, classes: DataFrame) -> list[tuple[int, int]]:
    """Ranges of distances between blocks, each of which sends about as much text as there is. With a distance d, block b of B
    meets block b + d, counted round, so distances go up to B / 2."""
    sizes = [(r["blocks"], r["n"]) for r in candidate.groupBy("blocks").agg(F.sum("n").alias("n")).collect()]
    most = classes.agg(F.sum("n")).first()[0] or 0
    cut, sent = [0], 0
    for d in range(max([b for b, _ in sizes], default=0) // 2 + 1):
        now = sum(n * (1 if d in (0, b / 2) else 2) for b, n in sizes if 2 * d <= b)
        if sent and sent + now > most:
            cut.append(d)
            sent = 0
        sent += now
    return list(zip(cut, [*cut[1:], d + 1]))


def _decide(texts: DataFrame, begin: int, end: int, parts: int, percent: int) -> DataFrame:
    """What ``_verify`` finds in all pairs of blocks whose distance is in a range."""
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks").cast("long")).cast("int")
    apart = F.sequence(F.lit(begin), F.least(F.lit(end - 1), F.floor(F.col("blocks") / 2).cast("int")))
    meets = F.array_distinct(F.concat(F.transform("apart", lambda d: F.pmod(F.col("own") + d, F.col("blocks"))), F.transform("apart", lambda d: F.pmod(F.col("own") - d, F.col("blocks")))))
    met = texts.where(F.col("blocks") >= 2 * begin).withColumn("own", own).withColumn("apart", apart).withColumn("other", F.explode(meets))
    spread = met.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "set_key", "copies", "text")
    return stored(spread.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verify(percent), "set_key long, links long, up long"))


def _similar(df: DataFrame, id_col: str, text_col: str, percent: int, part_bytes: int = PART_BYTES, slice_bytes: int = SLICE) -> DataFrame:
    """id, alt (a number of the text), n_shingles, n_similar, component and component_alt (of the first row of a component)
    of every row."""
    text = df[text_col].cast("string")
    docs = df.select(df[id_col].alias("id"), _text_number(text).alias("alt"), text.alias("text"))
    found = stored(map_text(docs, ["id", "alt"], "text", "n_shingles long, set_key long", lambda: _describe()))
    # the first row of a class: ids before none
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "alt")).alias("first")
    classes = stored(found.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.count("*").alias("copies"), first, F.first("n_shingles").alias("n")))
    parts = _part_count(df, text_col, part_bytes)
    near = candidates(docs.select("text"), parts, percent, slice_bytes=slice_bytes)
    # candidates: classes that signatures connect, with the blocks that their component is cut into
    nodes = components(near)
    by_node = classes.withColumn("node", F.col("set_key").bitwiseAND(F.lit((1 << NODE_BITS) - 1)))
    candidate = stored(nodes.join(by_node, "node").select("node", "root", F.col("first.id").alias("one"), F.col("first.alt").alias("one_alt"), "set_key", "copies", "n"))
    discard(near, nodes)
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    texts_of = lambda picked: pick_rows(docs, picked, F.col("id").eqNullSafe(F.col("one")) & (F.col("alt") == F.col("one_alt")))
    large = stored(candidate.groupBy("root").agg(blocks.alias("blocks")).where(F.col("blocks") > 1).select("root"))
    if large.limit(1).count():
        # components of several blocks are connected anew, by their rarest shingles
        again = texts_of(candidate.join(large, "root", "left_semi")).select("text")
        near = rare_candidates(again, parts, percent, slice_bytes)
        nodes = components(near)
        last = candidate
        small = last.join(large, "root", "left_anti").select(*last.columns)
        candidate = stored(small.unionByName(last.join(large, "root", "left_semi").drop("root").join(nodes, "node")))
        discard(last, near, nodes)
    volume = candidate.groupBy("root").agg(blocks.alias("blocks"))
    last, candidate = candidate, stored(candidate.join(volume, "root").select("one", "one_alt", "root", "set_key", "copies", "n", "blocks"))
    discard(last, large)
    decided = [_decide(texts_of(candidate), begin, end, parts, percent) for begin, end in _passes(candidate, classes)]
    every, decided = decided, reduce(DataFrame.unionByName, decided)
    links = decided.groupBy("set_key").agg(F.sum("links").alias("links"))
    roots = components(decided.where(F.col("up").isNotNull()).select(F.col("set_key").alias("a"), F.col("up").alias("b")))
    whole = roots.withColumnRenamed("node", "set_key").join(classes.select("set_key", "first"), "set_key")
    least = whole.groupBy("root").agg(F.min("first").alias("component"))
    by_class = classes.join(links, "set_key", "left").join(whole.select("set_key", "root").join(least, "root").select("set_key", "component"), "set_key", "left")
    by_class = stored(by_class.select("set_key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), F.coalesce("component", "first").alias("component")))
    discard(classes, candidate, *every, roots)
    lone = F.col("set_key").isNull()
    own, own_alt = F.when(lone, F.col("id")).otherwise(F.col("component.id")), F.when(lone, F.col("alt")).otherwise(F.col("component.alt"))
    return found.join(by_class, "set_key", "left").select("id", "alt", "n_shingles", F.coalesce("n_similar", F.lit(0).cast("long")).alias("n_similar"), own.alias("component"), own_alt.alias("component_alt"))
