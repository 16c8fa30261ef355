"""Byte-level BPE encoding and decoding by speculation and verification.

An Aho-Corasick automaton over the vocabulary proposes the greedy longest match of each new word. A token sequence is the
BPE encoding of its word exactly if every token encodes to itself and every adjacent pair is compatible, that is, no merge
of lower rank reaches across the pair's border; all pairs are tested at once by walking down the merge tree with NumPy. Only
words that fail are merged exactly. Words are cut out, hashed, looked up and put together again without Python objects, and
the decoded bytes of every document are compared with its text, so a collision of hashes can't pass: such a document is
encoded again word by word.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text, span_hashes, text_bytes

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
EXTRAS = {"ids": "array<int>", "decoded": "string"}
#: Bytes above which a word is merged with a heap.
LONG_WORD = 256
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_TAILS = ((1, "s"), (1, "t"), (1, "m"), (1, "d"), (2, "re"), (2, "ve"), (2, "ll"))


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def char_classes() -> np.ndarray:
    r"""Class of every code point: \p{L}, \p{N}, other, \s."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[0xD800:0xE000] = OTHER
    return out


def word_starts(codes: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which characters begin a word of the byte-level pre-tokeniser; ``offsets`` cut the characters into texts."""
    n = len(codes)
    start = np.zeros(n, dtype=bool)
    if not n:
        return start
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    kind = kinds[codes]
    space = kind == SPACE
    blank = codes == 32
    fresh = np.empty(n, dtype=bool)
    fresh[0] = True
    fresh[1:] = kind[1:] != kind[:-1]
    fresh |= first[:-1]
    led = np.zeros(n, dtype=bool)  # a single blank before it belongs to the word
    led[1:] = blank[:-1]
    led &= ~first[:-1]
    before_word = np.zeros(n, dtype=bool)
    before_word[:-1] = ~space[1:]
    before_word &= ~first[1:]
    start = np.where(space, fresh | before_word, fresh & ~led)
    quote = np.flatnonzero((codes == 39) & start)
    if len(quote):
        last = offsets[np.searchsorted(offsets, quote, "right")]
        ahead = lambda k: np.where(quote + k < last, codes[np.minimum(quote + k, n - 1)], 0)
        one, two = ahead(1), ahead(2)
        size = np.zeros(len(quote), np.int64)
        for k, tail in _TAILS:
            size[(size == 0) & (one == ord(tail[0])) & ((two == ord(tail[1])) if k == 2 else True)] = k
        for k in (1, 2):
            at = quote[size == k]
            for j in range(1, k + 1):
                start[at + j] = False
            stop = at + k + 1
            start[stop[stop < last[size == k]]] = True
    return start


class HashTable:
    """Open addressing from 64-bit hashes to numbers, with vectorised probes."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        self.count = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys & self.mask).astype(np.int64)
        have = self.keys[slot]
        out = np.where(have == keys, self.values[slot], -1)
        more = np.flatnonzero((have != keys) & (have != 0))
        while len(more):
            slot[more] = (slot[more] + 1) & int(self.mask)
            have = self.keys[slot[more]]
            hit = have == keys[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (have != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't in yet."""
        slot = (keys & self.mask).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = keys[free]
            mine = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[mine]] = values[mine]
            done = np.zeros(len(keys), dtype=bool)
            done[mine] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & int(self.mask)
        self.count += len(keys)


class Codec:
    """Encoder and decoder of one vocabulary file; words met before are kept, ``most`` of them."""

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, decoder = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or decoder.get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary without normaliser and prefix space is needed")
        to_byte = byte_chars()
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # ranks: 0-255 the bytes, then the merges in order
        names = [c for c, _ in sorted(to_byte.items(), key=lambda x: x[1])] + [a + b for a, b in merges]
        if len(set(names)) != len(names):
            raise ValueError("two merges give one token")
        rank = {t: r for r, t in enumerate(names)}
        self.ids = np.array([vocab[t] for t in names], np.int64)
        self.left = np.arange(len(names), dtype=np.int64)
        self.right = self.left.copy()
        self.left[256:] = [rank[a] for a, _ in merges]
        self.right[256:] = [rank[b] for _, b in merges]
        self.raw = [bytes(map(to_byte.__getitem__, t)) for t in names]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        keys = (self.left[256:] << 20) | self.right[256:]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order + 256
        self.merged = dict(zip(keys.tolist(), range(256, len(names))))
        top = max(int(self.ids.max()), *self.special.values(), 0) + 1
        self.sizes = np.zeros(top, np.int64)
        self.sizes[self.ids] = [len(x) for x in self.raw]
        by_id = [b""] * top
        for r, i in enumerate(self.ids):
            by_id[i] = self.raw[r]
        for text, i in self.special.items():
            by_id[i] = text.encode()
            self.sizes[i] = len(by_id[i])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        whole = np.arange(256, len(names))
        self.sound = np.ones(len(names), dtype=bool)
        self.sound[whole] = self.compatible(self.left[whole], self.right[whole], whole)
        for r in range(256, len(names)):
            self.sound[r] &= self.sound[self.left[r]] and self.sound[self.right[r]]
        self.seeds = ahocorasick.Automaton()
        for r, raw in enumerate(self.raw):
            self.seeds.add_word(raw.decode("latin-1"), r)
        self.seeds.make_automaton()
        self.lengths = np.array([len(x) for x in self.raw], np.int64)
        self.kinds = char_classes()
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.table = HashTable(max(12, (2 * self.most - 1).bit_length()))
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(self.most + 1, np.int64)
        self.checked = self.failed = 0

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b, or a number above all ranks."""
        keys = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge of a rank below ``below`` reaches across the border of tokens a and b while they are built.

        Undoing the later of the two last merges goes back in time step by step; in between, the parts that touch the
        border are a and b of that moment, and their merge would have happened if it came before the merge undone last.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 39) if below is None else below.copy()
        out = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            bad = self.merge_rank(x, y) < limit[live]
            out[live[bad]] = False
            more = ~bad & (np.maximum(x, y) >= 256)
            live, x, y = live[more], x[more], y[more]
            undo_left = x > y
            # of equal ranks, the left one was merged first, so the right one is undone first
            limit[live] = np.where(undo_left, x, y + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return out

    def merge_word(self, raw: bytes) -> list[int]:
        """Exact merging of one word: the lowest rank first, from the left."""
        if len(raw) > LONG_WORD:
            return self.merge_long(np.frombuffer(raw, np.uint8))
        parts = list(raw)
        get = self.merged.get
        while len(parts) > 1:
            best, at = min((get(parts[i] << 20 | parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best == 1 << 40:
                break
            pair, new, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    new.append(best)
                    i += 2
                else:
                    new.append(parts[i])
                    i += 1
            parts = new
        return parts

    def merge_long(self, raw: np.ndarray) -> list[int]:
        """Exact merging of one long word: a heap of merges, the lowest rank first, from the left, over linked tokens."""
        import heapq

        token = raw.astype(np.int64)
        rank = self.merge_rank(token[:-1], token[1:])
        heap = ((rank << 40) | np.arange(len(rank)))[rank < 1 << 40].tolist()
        heapq.heapify(heap)
        parts, n, get = token.tolist(), len(token), self.merged.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = heapq.heappop(heap)
            new, i = x >> 40, x & ((1 << 40) - 1)
            j = after[i]
            if parts[i] < 0 or j >= n or get(parts[i] << 20 | parts[j]) != new:
                continue  # one of the two has been merged since
            parts[i], parts[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(new << 20 | parts[k])) is not None:
                    heapq.heappush(heap, r << 40 | i)
            if (k := before[i]) >= 0 and (r := get(parts[k] << 20 | new)) is not None:
                heapq.heappush(heap, r << 40 | k)
        return [x for x in parts if x >= 0]

    def merge_words(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words in step: each round does the lowest merge of every word that still has one. Words of
        more than ``LONG_WORD`` bytes are merged one by one, as every round costs their length."""
        size = ends - begins
        done_token, done_word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for w in np.flatnonzero(size > LONG_WORD).tolist():
            done_token.append(np.array(self.merge_long(data[begins[w] : ends[w]]), np.int64))
            done_word.append(np.full(len(done_token[-1]), w))
        begins = np.where(size > LONG_WORD, ends, begins)
        size = ends - begins
        token = data[np.repeat(begins - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(int(size.sum()))].astype(np.int64)
        word = np.repeat(np.arange(len(size)), size)
        while len(token):
            rank = np.full(len(token), 1 << 40)
            near = np.flatnonzero(word[1:] == word[:-1])
            rank[near] = self.merge_rank(token[near], token[near + 1])
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            count = np.diff(np.append(first, len(token)))
            least = np.minimum.reduceat(rank, first)
            over = np.repeat(least == 1 << 40, count)
            done_token.append(token[over])
            done_word.append(word[over])
            hit = (rank == np.repeat(least, count)) & ~over
            at = np.flatnonzero(hit)
            fresh = np.concatenate(([True], np.diff(at) > 1)) if len(at) else np.zeros(0, dtype=bool)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]  # of "aaa", the first two merge
            token[at] = rank[at]
            keep = ~over
            keep[at + 1] = False
            token, word = token[keep], word[keep]
        token, word = np.concatenate(done_token), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return token[order], word[order]

    def words(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all given words, and how many each word has."""
        size = ends - begins
        total = int(size.sum())
        first = np.concatenate(([0], np.cumsum(size + 1)))
        text = np.full(total + len(size), 256, np.uint16)
        inside = np.ones(len(text), dtype=bool)
        inside[first[1:] - 1] = False
        text[inside] = data[np.repeat(begins - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(total)]
        found = list(self.seeds.iter_long(text.tobytes().decode("utf-16-le")))
        last = np.fromiter((x[0] for x in found), np.int64, len(found))
        token = np.fromiter((x[1] for x in found), np.int64, len(found))
        word = np.searchsorted(first, last, "right") - 1
        wrong = np.zeros(len(size), dtype=bool)
        covered = np.bincount(word, weights=self.lengths[token], minlength=len(size)) == size
        wrong |= ~covered
        wrong[word[~self.sound[token]]] = True
        near = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique((token[near] << 20) | token[near + 1], return_inverse=True)
        good = self.compatible(pairs >> 20, pairs & ((1 << 20) - 1))[back]
        wrong[word[near[~good]]] = True
        count = np.bincount(word, minlength=len(size)).astype(np.int64)
        self.checked += len(size)
        self.failed += int(wrong.sum())
        if wrong.any():
            failing = np.flatnonzero(wrong)
            exact, owner = self.merge_words(data, begins[failing], ends[failing])
            keep = ~wrong[word]
            owner = np.concatenate([word[keep], failing[owner]])
            token = np.concatenate([token[keep], exact])
            token = token[np.argsort(owner, kind="stable")]
            count = np.bincount(owner, minlength=len(size)).astype(np.int64)
        return token, count

    def learn(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        token, count = self.words(data, begins, ends)
        while self.used + len(token) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
        self.flat[self.used : self.used + len(token)] = self.ids[token]
        n = self.table.count
        self.start[n : n + len(count) + 1] = self.used + np.concatenate(([0], np.cumsum(count)))
        self.used += len(token)
        self.table.add(keys, np.arange(n, n + len(count), dtype=np.int32))

    def borders(self, raw: bytes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the words, and the id of those that are special tokens (else -1)."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        cuts, specials = [np.searchsorted(lead, offsets)], []
        for text, i in self.special.items():
            name = text.encode()
            at = raw.find(name)
            while at >= 0:
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(name) - 1, "right"):
                    specials.append((at, at + len(name), i))
                at = raw.find(name, at + (len(name) if specials and specials[-1][0] == at else 1))
        specials.sort()
        if specials:
            cuts.append(np.searchsorted(lead, np.array([x[:2] for x in specials]).ravel()))
        cut = np.unique(np.concatenate(cuts))
        begin = word_starts(codes, self.kinds, cut)
        for a, b, _ in specials:
            begin[np.searchsorted(lead, a) + 1 : np.searchsorted(lead, b)] = False
        starts = lead[begin]
        ends = np.append(starts[1:], len(data))
        kind = np.full(len(starts), -1, np.int64)
        for a, _, i in specials:
            kind[np.searchsorted(starts, a)] = i
        return starts, ends, kind

    def encode(self, data: np.ndarray, offsets: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the n+1 places at which texts begin in them. The bytes must be valid UTF-8."""
        starts, ends, special = self.borders(data.tobytes(), data, offsets)
        if exact:
            parts = [[int(special[w])] if special[w] >= 0 else self.ids[self.merge_word(data[starts[w] : ends[w]].tobytes())] for w in range(len(starts))]
            count = np.array([len(x) for x in parts], np.int64)
            ids = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        else:
            keys = span_hashes(data, starts, ends) | np.uint64(1 << 63)
            at = self.table.find(keys)
            new = np.flatnonzero((at < 0) & (special < 0))
            if len(new):
                _, pick = np.unique(keys[new], return_index=True)
                pick = new[pick]
                if self.table.count + len(pick) > self.most:
                    self.forget()
                    pick = np.flatnonzero(special < 0)
                    pick = pick[np.unique(keys[pick], return_index=True)[1]]
                    if len(pick) > self.most:
                        self.most = 2 * len(pick)
                        self.forget()
                self.learn(data, starts[pick], ends[pick], keys[pick])
                at = self.table.find(keys)
            safe = np.maximum(at, 0)
            count = np.where(special < 0, self.start[safe + 1] - self.start[safe], 1)
            first = np.concatenate(([0], np.cumsum(count)))
            ids = self.flat[np.repeat(self.start[safe] - first[:-1], count) + np.arange(first[-1])].astype(np.int64)
            if (special >= 0).any():
                ids[first[:-1][special >= 0]] = special[special >= 0]
        first = np.concatenate(([0], np.cumsum(count)))
        return ids, first[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and the places at which texts begin in them."""
        size = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        return self.bytes[np.repeat(self.begins[ids] - ends[:-1], size) + np.arange(ends[-1])], ends[first]

    def check(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """encode and decode; a text whose bytes don't come back is encoded by exact merging alone."""
        ids, first = self.encode(data, offsets)
        back, places = self.decode(ids, first)
        if len(back) != len(data) or not np.array_equal(back, data):
            parts = []
            for k in range(len(offsets) - 1):
                own = data[offsets[k] : offsets[k + 1]]
                got = back[places[k] : places[k + 1]]
                if len(own) == len(got) and np.array_equal(own, got):
                    parts.append(ids[first[k] : first[k + 1]])
                else:
                    parts.append(self.encode(own, np.array([0, len(own)]), exact=True)[0])
            first = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
            ids = np.concatenate(parts) if parts else ids
            back, places = self.decode(ids, first)
        return ids, first, back, places


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, made once per Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _worker(path: str, extras: tuple[str, ...]):
    def make():
        c = codec(path)

        def work(column: pa.Array) -> dict:
            data, offsets = text_bytes(column)
            ids, first, back, places = c.check(data, offsets)
            small = ids.astype("<u4").tobytes()
            raw = back.tobytes()
            sha = hashlib.sha256
            n = len(offsets) - 1
            out = {
                "n_tokens": np.diff(first).astype(np.int64),
                "ids_sha256": pa.array([sha(small[4 * first[k] : 4 * first[k + 1]]).hexdigest() for k in range(n)], pa.string()),
                "decoded_sha256": pa.array([sha(raw[places[k] : places[k + 1]]).hexdigest() for k in range(n)], pa.string()),
            }
            if "ids" in extras:
                out["ids"] = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
            if "decoded" in extras:
                out["decoded"] = pa.array([raw[places[k] : places[k + 1]].decode("utf-8", "replace") for k in range(n)], pa.string())
            return out

        return work

    return make


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", extras: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per row of ``df``: id, number of tokens and digests; as ``extras``, ids and the decoded text.

    Null is encoded as the empty text: no tokens, digests of nothing. Repeated rows stay, an empty table gives an empty
    result, other columns are ignored, whatever their names. ``path`` is the vocabulary file, on every executor.
    """
    schema = ", ".join([SCHEMA, *[f"{x} {EXTRAS[x]}" for x in extras]])
    return map_text(df, [id_col], text_col, schema, _worker(path, extras))
