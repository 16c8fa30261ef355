"""Language identification by cross-parsing entropy.

From labelled text of each language, a suffix automaton is built. A text is cut greedily into the longest pieces that occur
in a language's labelled text (plus one unseen letter, where no piece starts); the fewer pieces, the better the language
explains the text. Piece counts are normalised by the entropy that each language's sample allows for, and the language with
the fewest normalised pieces wins. All texts of a batch are parsed in step with NumPy: one transition per character, texts
and languages side by side. Long texts are cut into stretches that are parsed in step as well; one that isn't begun as it should
be is mended up to the place where both parses agree, so the result is that of one parse of the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_text, text_bytes

#: Labelled documents for each language at most, and characters kept of their normalised text at most.
SAMPLE_DOCS = 64
SAMPLE_CHARS = 24_000
#: Stretches that are mended one by one, character by character, if there are no more.
FEW = 32
#: Characters of a stretch, and of the text before it that its parse begins with; stretches that are parsed in step.
STRETCH, WARM, STRETCHES = 512, 64, 2048
SCHEMA = "lang_pred string, score double"


class Alphabet:
    """Lower-case letters of the samples get numbers from 2; 1 is every run of other characters, 0 other letters."""

    def __init__(self, letters: str) -> None:
        self.size = len(letters) + 2
        self.table = np.zeros(0x110000, np.uint8 if self.size < 256 else np.int32)
        is_letter = letter_table()
        self.table[~is_letter] = 1
        for k, c in enumerate(letters):
            self.table[ord(c)] = k + 2
            upper = c.upper()
            if len(upper) == 1:
                self.table[ord(upper)] = k + 2

    def codes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts with runs of non-letters made one, and the places at which texts begin."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        places = np.searchsorted(lead, offsets)
        out = self.table[points]
        keep = np.ones(len(out), dtype=bool)
        keep[1:] = (out[1:] != 1) | (out[:-1] != 1)
        keep[places[places < len(out)]] = True
        return out[keep], np.concatenate(([0], np.cumsum(keep)))[places]


_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def suffix_automaton(codes: np.ndarray, size: int) -> np.ndarray:
    """Transitions (state x symbol -> state, 0 for none) of the suffix automaton; state 1 is the start."""
    step: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in codes.tolist():
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out = np.zeros((len(step), size), np.int32)
    for state, own in enumerate(step):
        for c, to in own.items():
            out[state, c] = to
    return out


class Parser:
    """Automata of all languages in one table of transitions."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        text = {k: normal(v) for k, v in samples.items()}
        letters = "".join(sorted({c for v in text.values() for c in v if c != " "}))
        self.alphabet = Alphabet(letters)
        number = {c: k + 2 for k, c in enumerate(letters)} | {" ": 1}
        tables, roots, at = [], [], 0
        for lang in self.langs:
            own = suffix_automaton(np.array([number[c] for c in text[lang]], np.int64), self.alphabet.size)
            own = np.where(own > 0, own + at, 0)
            tables.append(own)
            roots.append(at + 1)
            at += len(own)
        width = self.alphabet.size
        table = np.concatenate(tables) if tables else np.zeros((2, width), np.int32)
        self.step = np.ascontiguousarray(table.astype(np.int32) * width).ravel()  # states times symbols: one addition less
        self.roots = np.array(roots, np.int32) * width
        # a piece covers about log(sample size) characters of its own language
        self.norm = np.array([np.log(max(3, len(text[lang]))) for lang in self.langs])

    def pieces(self, codes: np.ndarray, first: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """Pieces of each text in each language's text: texts x languages. ``stretch`` and ``STRETCHES`` only say how much is
        parsed in step."""
        n, langs = len(first) - 1, len(self.langs)
        parts = -(-np.diff(first) // stretch)
        owner = np.repeat(np.arange(n), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = first[owner] + number * stretch
        length = np.minimum(stretch, first[owner + 1] - begin)
        ends = number == parts[owner] - 1
        out, carry = np.zeros((n, langs)), self.roots
        for low in range(0, len(owner), STRETCHES):
            own = slice(low, low + STRETCHES)
            count, state = self._stretches(codes, begin[own], length[own], number[own] > 0, carry, min(WARM, stretch))
            carry = state[:, -1]
            count = count + ((state != self.roots[:, None]) & ends[own])  # the piece that is still open
            for j in range(langs):
                out[:, j] += np.bincount(owner[own], weights=count[j], minlength=n)
        return out

    def _stretches(self, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, follows: np.ndarray, carry: np.ndarray, warm: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that end in each stretch, and the states in which it is left: languages x stretches. A stretch that follows
        another begins in the state in which that is left, the first one in ``carry``.

        The parse of a stretch begins ``warm`` characters earlier, as if a text began there, which mostly leads to the state
        it is to begin in. Those that begin in another are parsed again, up to the place where both parses are in one state,
        from which on they are the same."""
        langs, size = len(self.langs), len(begin)
        early = np.where(follows, warm, 0)
        order = np.argsort(-(length + early), kind="stable")
        early = early[order]
        at, longest = begin[order] - early, length[order] + early
        most = int(longest.max(initial=0))
        roots = self.roots[:, None]
        state = np.tile(roots, (1, size))
        begun = state.copy()  # the state in which each begins
        count = np.zeros((langs, size), np.int32)
        states = np.zeros((most, langs, size), np.int32)
        stops = np.zeros((most, langs, size), dtype=bool)
        live = np.searchsorted(-longest, -np.arange(1, most + 1), "right")
        for k in range(most):
            m = int(live[k])
            c = codes[at[:m] + k].astype(np.int32)
            to = self.step[state[:, :m] + c]
            stop = to == 0
            again = self.step[roots + c]
            state[:, :m] = np.where(stop, np.where(again == 0, roots, again), to)
            count[:, :m] += stop & (k >= early[:m]) if k < warm else stop
            states[k, :, :m], stops[k, :, :m] = state[:, :m], stop
            if k + 1 == warm:
                begun = np.where(early > 0, state, begun)
        place = np.empty(size, np.int64)
        place[order] = np.arange(size)
        begun = begun[:, place]  # in order of the text
        while True:
            want = begun.copy()
            left = state[:, place]
            want[:, 1:] = np.where(follows[1:], left[:, :-1], begun[:, 1:])
            if size and follows[0]:
                want[:, 0] = carry
            lang, col = np.nonzero(want != begun)
            if not len(lang):
                return count[:, place], left
            now, begun, col = want[lang, col], want, place[col]
            k = early[col]
            new, old = np.zeros(len(lang), np.int32), np.zeros(len(lang), np.int32)
            while len(lang):
                if len(lang) <= FEW:
                    for j, i, x, y, more in zip(lang.tolist(), col.tolist(), k.tolist(), now.tolist(), (new - old).tolist()):
                        most_left, changed = self._again(codes[at[i] + x : at[i] + longest[i]], j, y, states[x:, j, i], stops[x:, j, i])
                        count[j, i] += more + changed
                        if most_left is not None:
                            state[j, i] = most_left
                    break
                c = codes[at[col] + k].astype(np.int32)
                root = self.roots[lang]
                to = self.step[now + c]
                stop = to == 0
                again = self.step[root + c]
                now = np.where(stop, np.where(again == 0, root, again), to)
                new += stop
                old += stops[k, lang, col]
                met = now == states[k, lang, col]
                states[k, lang, col], stops[k, lang, col] = now, stop
                k = k + 1
                over = met | (longest[col] == k)
                if over.any():
                    count[lang[over], col[over]] += new[over] - old[over]
                    last = over & ~met
                    state[lang[last], col[last]] = now[last]
                    lang, col, now, new, old, k = lang[~over], col[~over], now[~over], new[~over], old[~over], k[~over]

    def _again(self, codes: np.ndarray, lang: int, now: int, states: np.ndarray, stops: np.ndarray) -> tuple[int | None, int]:
        """Parse the rest of a stretch from another state, up to the place where both parses are in one state: the state at
        the end if there is no such place, and how many pieces more there are. ``states`` and ``stops`` are brought up to date."""
        step, root, more = self.step.item, int(self.roots[lang]), 0
        old_states, old_stops = states[: len(codes)].tolist(), stops[: len(codes)].tolist()
        for k, c in enumerate(codes.tolist()):
            to = step(now + c)
            stop = not to
            now = to or step(root + c) or root
            more += stop - old_stops[k]
            if now == old_states[k]:
                stops[k] = stop
                return None, more
            states[k], stops[k] = now, stop
        return now, more

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        codes, first = self.alphabet.codes(data, offsets)
        letters = np.concatenate(([0], np.cumsum(codes != 1)))
        none = letters[first[1:]] == letters[first[:-1]]
        if not self.langs:
            return ["und"] * len(none), np.zeros(len(none))
        cost = self.pieces(codes, first) * self.norm
        best = cost.argmin(1)
        least = cost[np.arange(len(best)), best]
        rest = cost.copy()
        rest[np.arange(len(best)), best] = np.inf
        second = rest.min(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(none | (least <= 0), 0.0, np.where(np.isinf(second), 1.0, 1 - least / np.maximum(second, 1e-9)))
        names = np.array(self.langs, dtype=object)[best]
        names[none] = "und"
        return names.tolist(), np.clip(score, 0, 1)


def normal(text: str) -> str:
    """Lower-case letters with one space for each run of other characters; letters whose lower case isn't one letter stay."""
    out = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    return " ".join(out.split())


def learn(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Parser:
    """The parser of a bounded sample: of the rows that are ``usable`` and have a label and text, ``docs`` per language in
    order of a hash of the id; of their normalised text, joined in that order, ``chars`` characters per language. Documents
    share these evenly: what short ones leave goes to the others, so no long one stands for its language.

    The sample is chosen without its text; then only its rows' texts come to the driver, ``4 * chars`` characters of each at
    most, and of rows with one id and label the least text. The number of languages is taken to be that of a language
    inventory (thousands at most).
    """
    order = F.xxhash64(df[id_col].cast("string"))
    labelled = df.where(usable & df[lang_col].isNotNull() & df[text_col].isNotNull() & (F.length(df[text_col]) > 0))
    chosen = labelled.select(df[id_col].alias("id"), df[lang_col].cast("string").alias("lang"), order.alias("o"))
    chosen = chosen.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("o", "id"))).where(F.col("n") <= docs)
    ids = [r["id"] for r in chosen.select("id").collect()]
    named = labelled.where(df[id_col].isin(ids)).select(df[lang_col].cast("string").alias("lang"), order.alias("o"), df[id_col].alias("id"), F.substring(df[text_col].cast("string"), 1, 4 * chars).alias("text"))
    rows = named.groupBy("lang", "o", "id").agg(F.min("text").alias("text")).collect() if ids else []
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["o"], str(r["id"]))):
        if text := normal(r["text"]):
            samples.setdefault(r["lang"], []).append(text)
    return Parser({k: " ".join(shared_out(v, chars)) for k, v in samples.items()})


def shared_out(texts: list[str], chars: int) -> list[str]:
    """The beginnings of texts so that they and the spaces between them have at most ``chars`` characters, as even as can be."""
    left, share, size = chars - len(texts) + 1, {}, sorted(range(len(texts)), key=lambda k: len(texts[k]))
    for done, k in enumerate(size):
        share[k] = min(len(texts[k]), max(0, left) // (len(size) - done))
        left -= share[k]
    return [text[: share[k]] for k, text in enumerate(texts) if share[k]]


def _worker(shared) -> Callable:
    def make():
        parser: Parser = shared.value

        def work(column: pa.Array) -> dict:
            names, score = parser.predict(*text_bytes(column))
            return {"lang_pred": pa.array(names, pa.string()), "score": score}

        return work

    return make


def identify(df: DataFrame, parser: Parser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, lang_pred and score.

    A null text, or one without a letter, is "und" with score 0; so is everything if nothing was learned. Equal costs go
    to the language that comes first in alphabetical order. Repeated rows stay; an empty table gives an empty result;
    other columns are ignored, whatever their names. The score is how much fewer normalised pieces the best language
    needs than the next best.
    """
    return map_text(df, [id_col], text_col, SCHEMA, _worker(df.sparkSession.sparkContext.broadcast(parser)))
