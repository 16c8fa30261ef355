"""License scans: exact phrases of the base list, and fuzzy short notices.

A notice may differ from its template in a few letters. Split into k+1 pieces, at least one piece of a template survives
k edits (pigeonhole), so an Aho-Corasick automaton over all pieces finds every candidate place in one pass over the text;
around each candidate the ``regex`` library's bounded-error matching verifies the edits and gives the span.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM_WORD, map_text, per_row, runs, text_bytes

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices that the method looks for, in words of the base tokenisation, with their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license": "apache",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under a creative commons attribution": "cc-by",
    "creative commons noncommercial": "cc-nc",
    "all rights reserved": "all-rights-reserved",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 10


def notice_pieces(notices: dict[str, str], per_edit: int = CHARS_PER_EDIT) -> list[tuple[str, str, int, list[tuple[int, str]]]]:
    """(template, label, k edits, k+1 (offset, piece)): pieces of almost equal length that make up the template."""
    out = []
    for text, label in notices.items():
        k = len(text) // per_edit
        cut = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
        out.append((text, label, k, [(cut[i], text[cut[i] : cut[i + 1]]) for i in range(k + 1)]))
    return out


class NoticeSearch:
    """Fuzzy search for notices in text of lower-case words joined by one space."""

    def __init__(self, notices: dict[str, str] = NOTICES, per_edit: int = CHARS_PER_EDIT) -> None:
        import ahocorasick
        import regex

        self.parts = notice_pieces(notices, per_edit)
        self.patterns = [regex.compile(rf"(?<![^ ])(?:{regex.escape(text)}){{e<={k}}}(?![^ ])", regex.BESTMATCH) for text, _, k, _ in self.parts]
        self.seeds = ahocorasick.Automaton()
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for number, (_, _, _, pieces) in enumerate(self.parts):
            for offset, piece in pieces:
                by_piece.setdefault(piece, []).append((number, offset))
        for piece, owners in by_piece.items():
            self.seeds.add_word(piece, (len(piece), owners))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, begin, end, edits) of verified notices, in order of begin; overlapping ones of a template count once,
        and of overlapping notices only those with the fewest edits stay."""
        near: dict[int, list[list[int]]] = {}
        for last, (size, owners) in self.seeds.iter(text):
            for number, offset in owners:
                template, _, k, _ = self.parts[number]
                begin = last + 1 - size - offset - k - 1
                end = begin + len(template) + 2 * k + 2
                spans = near.setdefault(number, [])
                if spans and begin <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                    spans[-1][0] = min(spans[-1][0], begin)
                else:
                    spans.append([begin, end])
        found = []
        for number, spans in near.items():
            label, at = self.parts[number][1], -1
            for begin, end in spans:
                for m in self.patterns[number].finditer(text, max(0, begin, at), min(len(text), end)):
                    found.append((label, m.start(), m.end(), sum(m.fuzzy_counts)))
                    at = m.end()
        found.sort(key=lambda x: (x[1], x[2], x[0]))
        begins, longest = [x[1] for x in found], max((x[2] - x[1] for x in found), default=0)
        # a notice is no longer than its template and its edits, so those that overlap one are near it
        near_by = lambda x: found[bisect_right(begins, x[1] - longest) : bisect_left(begins, x[2])]
        return [x for x in found if not any(y[3] < x[3] and x[1] < y[2] for y in near_by(x))]


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,begin:long,end:long,edits:int>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))


def _scanner(notices: dict[str, str]):
    def make():
        import re

        search = NoticeSearch(notices)
        phrase = re.compile("(?<= )(?=(" + "|".join(re.escape(p) for p in sorted(BASE, key=len, reverse=True)) + ") )")

        def work(column: pa.Array) -> dict:
            data, offsets = text_bytes(column, lower=True)
            mask = ALNUM_WORD[data]
            starts, ends, first = runs(mask, offsets)
            # one text of all rows, words apart by one space; rows are told apart by their sizes
            gap = ~mask
            drop = np.zeros(len(data), dtype=bool)
            drop[1:] = gap[1:] & gap[:-1]
            sizes = per_row(~drop, offsets)
            flat = np.where(gap, np.uint8(32), data)[~drop].tobytes()
            out = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            at = 0
            for length in sizes.tolist():
                raw = flat[at : at + length]
                at += length
                text = raw.decode("utf-8", "replace").strip(" ")
                padded = f" {text} "
                base, places = set(), []
                if " license " in padded:
                    for m in phrase.finditer(padded):
                        base.add(BASE[m[1]])
                        places.append(m.start())
                spans = search.find(text)
                labels = base | {s[0] for s in spans}
                out["n_base"].append(len(places))
                out["first_word"].append(padded.count(" ", 0, places[0]) - 1 if places else None)
                out["last_word"].append(padded.count(" ", 0, places[-1]) - 1 if places else None)
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(labels)))
                out["score"].append(1.0 if base else max((1 - s[3] / max(1, s[2] - s[1]) for s in spans), default=0.0))
                out["spans"].append([{"label": a, "begin": b, "end": c, "edits": d} for a, b, c, d in spans])
            for k in ("n_base", "first_word", "last_word"):
                out[k] = pa.array(out[k], pa.int64())
            for k in ("base_labels", "labels"):
                out[k] = pa.array(out[k], pa.string())
            out["score"] = pa.array(out["score"], pa.float64())
            out["spans"] = pa.array(out["spans"], _SPAN)
            return {"n_words": np.diff(first).astype(np.int64)} | out

        return work

    return make


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per row of ``df``: counts and places of base phrases, labels, score and spans of verified notices.

    Spans are code points of the text after lower-casing A-Z, with each run of non-word characters made one space and
    both ends trimmed. Null and empty texts have no words, no labels, score 0 and null places. Labels are sorted and
    distinct; repeated rows stay; an empty table gives an empty result; other columns are ignored, whatever their names.
    The score is 1 with a base phrase, else the share of letters that agree in the best notice.
    """
    return map_text(df, [id_col], text_col, SCHEMA, _scanner(notices))
