"""Brute-force versions of what the operators compute."""

import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


#: Texts that are null, empty, blank, short, long, repeated, or full of unusual characters.
ODD = [
    None, "", " \n\t", "a", "A b", "one two three four", "one two three four five", "ONE two three four five", "one two three four five six " * 400, "x\x00y \x0bz", "é ü ß 日本語 😀 ﬁ", "word " * 3000,
    "a|b|c # * $ % & < >", "line one\nline two\nline one\n\nline one\n", "released under the MIT License.", "a" * 20000, "    x", "1 2 3 4 5 6 7 8 9 10 11 12", "Don't 'll <|endoftext|> x's", "é" * 3000,
]


def odd_table(spark, extra=True):
    """ODD twice, some without an id, with columns that are called like the operators' own."""
    rows = [(i if i != 5 else None, t, "en" if i % 3 else None, "s", 1, 0.5, True, "k") for i, t in enumerate(ODD * 2)]
    rows += [rows[8], rows[8]]
    schema = "doc_id long, text string, lang string, source string, n_words long, score double, kept boolean, id string"
    out = spark.createDataFrame(rows, schema).repartition(3)
    return out if extra else out.select("doc_id", "text")


def windows(words, n):
    return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]


def repeated_words(words):
    seen, out = Counter(windows(words, 3)), set()
    for k, w in enumerate(windows(words, 3)):
        if seen[w] > 1:
            out |= {k, k + 1, k + 2}
    return len(out)


def shingles(text):
    words = SPACED.findall(lower(text))
    return frozenset(windows(words, 5) if len(words) >= 5 else [tuple(words)] if words else [])


def linked(sets):
    """Symmetric adjacency of {key: set} by 100 * common >= 80 * union, among non-empty sets."""
    keys, out = list(sets), {k: set() for k in sets}
    owners = {}
    for k in keys:
        for s in sets[k]:
            owners.setdefault(s, []).append(k)
    for k in keys:
        for j, n in Counter(j for s in sets[k] for j in owners[s] if j != k).items():
            if 100 * n >= 80 * (len(sets[k]) + len(sets[j]) - n):
                out[k].add(j)
    return out


def component_of(links):
    out = {}
    for k in sorted(links):
        if k not in out:
            todo = [k]
            out[k] = k
            while todo:
                for j in links[todo.pop()]:
                    if j not in out:
                        out[j] = k
                        todo.append(j)
    return out
