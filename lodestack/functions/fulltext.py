"""Full-text queries: their syntax, the rows they match, and BM25.

A query becomes Columns over an array of search terms. Phrases next to each other must all match; NOT binds more than AND,
and AND more than OR. A phrase may be a word, a string, phrases joined by +, a prefix (word*), or stand at the start (^word);
NEAR(a b, n) wants phrases within n terms of each other.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import QueryError
from .text import let, query_terms

K1, B = 1.2, 0.75


class FullTextSyntaxError(QueryError):
    """A query that isn't well formed; other errors are plain QueryErrors."""


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Without:
    left: Node
    right: Node


Node = Phrase | Near | And | Or | Without


def _lex(text: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c in " \t\r\n":
            i += 1
        elif c in "(){}:,+*-^":
            out.append((c, c))
            i += 1
        elif c == '"':
            part, i = [], i + 1
            while True:
                if i >= len(text):
                    raise QueryError("unterminated string")
                if text[i] == '"':
                    if text[i + 1 : i + 2] != '"':
                        break
                    i += 1
                part.append(text[i])
                i += 1
            out.append(("string", "".join(part)))
            i += 1
        elif c.isascii() and (c.isalnum() or c in "_\x1a") or not c.isascii():
            j = i
            while j < len(text) and (not text[j].isascii() or text[j].isalnum() or text[j] in "_\x1a"):
                j += 1
            word = text[i:j]
            out.append((word if word in ("AND", "OR", "NOT") else "word", word))
            i = j
        else:
            raise FullTextSyntaxError(f'syntax error near "{c}"')
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str) -> None:
        self.all, self.at = _lex(text), 0

    def kind(self, ahead: int = 0) -> str:
        return self.all[min(self.at + ahead, len(self.all) - 1)][0]

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.all[self.at - 1]

    def fail(self) -> FullTextSyntaxError:
        return FullTextSyntaxError(f'syntax error near "{self.all[min(self.at, len(self.all) - 1)][1]}"')

    def parse(self) -> Node:
        out = self.either()
        if self.kind() != "end":
            raise self.fail()
        return out

    def either(self) -> Node:
        out = self.both()
        while self.kind() == "OR":
            self.take()
            out = Or(out, self.both())
        return out

    def both(self) -> Node:
        out = self.without()
        while self.kind() == "AND":
            self.take()
            out = And(out, self.without())
        return out

    def without(self) -> Node:
        out = self.unit()
        while self.kind() == "NOT":
            self.take()
            out = Without(out, self.unit())
        return out

    def unit(self) -> Node:
        self.column()
        if self.kind() == "(":
            self.take()
            out = self.either()
            if self.kind() != ")":
                raise self.fail()
            self.take()
            if self.kind() in ("word", "string", "(", "^"):
                raise self.fail()
            return out
        out = self.near()
        while self.kind() in ("word", "string", "^", "{", "-"):
            self.column()
            right = self.near()
            empty = lambda n: isinstance(n, Phrase) and not n.terms
            out = out if empty(right) else right if empty(out) else And(out, right)
        if self.kind() == "(":
            raise self.fail()
        return out

    def column(self) -> None:
        """A column filter: only ``text`` is a column."""
        if self.kind() == "-" and self.kind(1) == "word":
            raise QueryError(f"no such column: {self.all[self.at + 1][1]}")
        if self.kind() == "{":
            self.take()
            names = []
            while self.kind() in ("word", "string"):
                names.append(self.take()[1])
            if self.kind() != "}" or self.kind(1) != ":" or not names:
                raise self.fail()
            self.take()
            self.take()
        elif self.kind() in ("word", "string") and self.kind(1) == ":":
            names = [self.take()[1]]
            self.take()
        else:
            return
        for name in names:
            if name.lower() != "text":
                raise QueryError(f"no such column: {name}")

    def near(self) -> Node:
        first = False
        if self.kind() == "^":
            self.take()
            first = True
        if self.kind() == "word" and self.all[self.at][1] == "NEAR" and self.kind(1) == "(" and not first:
            self.take()
            self.take()
            phrases, distance = [], 10
            while self.kind() in ("word", "string"):
                phrases.append(self.phrase(False))
            if self.kind() == ",":
                self.take()
                word = self.take()
                if word[0] != "word" or not word[1].isdigit():
                    raise QueryError(f'expected integer, got "{word[1]}"')
                distance = int(word[1])
            if self.kind() != ")" or not phrases:
                raise self.fail()
            self.take()
            phrases = [p for p in phrases if p.terms]
            return phrases[0] if len(phrases) == 1 else Near(tuple(phrases), distance) if phrases else Phrase(())
        return self.phrase(first)

    def phrase(self, first: bool) -> Phrase:
        terms: list[str] = []
        while True:
            if self.kind() not in ("word", "string"):
                raise self.fail()
            terms += query_terms(self.take()[1])
            if self.kind() != "+":
                break
            self.take()
        prefix = self.kind() == "*"
        if prefix:
            self.take()
        return Phrase(tuple(terms), prefix, first)


def parse(text: str) -> Node:
    """The tree of a full-text query."""
    if text.startswith("*"):
        raise QueryError(f"unknown special query: {text[1:]}")
    return _Parser(text).parse()


def sanitize(text: str) -> str:
    """Letters, digits and underscores of a text, with one blank for everything else."""
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in text).split())


def phrases(node: Node) -> list[Phrase]:
    """All phrases of a tree, from the left."""
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    return phrases(node.left) + phrases(node.right)


class Terms:
    """The search terms of a row, as an array of all of them."""

    def __init__(self, terms: Column) -> None:
        self.terms = terms

    def length(self) -> Column:
        return F.size(self.terms)

    def starts(self, p: Phrase) -> Column:
        """Places (from 0) at which a phrase stands."""
        if not p.terms:
            return F.expr("cast(array() as array<int>)")
        last = p.terms[-1]
        same = lambda x, t, k: x.startswith(t) if p.prefix and k == len(p.terms) - 1 else x == t
        n = len(p.terms)
        if n == 1:
            hits = F.filter(F.transform(self.terms, lambda x, i: F.when(same(x, last, 0), i)), lambda i: i.isNotNull())
        else:

            def at(i: Column) -> Column:
                checks = [same(F.get(self.terms, i + k), t, k) for k, t in enumerate(p.terms)]
                return functools.reduce(lambda a, b: a & b, checks)

            places = F.when(F.size(self.terms) >= n, F.sequence(F.lit(0), F.size(self.terms) - n)).otherwise(F.expr("cast(array() as array<int>)"))
            hits = F.filter(places, at)
        return F.filter(hits, lambda i: i == 0) if p.first else hits

    def count(self, p: Phrase) -> Column:
        """How often a phrase occurs; occurrences may overlap."""
        if not p.terms:
            return F.lit(0)
        if len(p.terms) == 1 and not p.first:
            return F.size(F.filter(self.terms, lambda x: x.startswith(p.terms[0]) if p.prefix else x == p.terms[0]))
        # terms hold letters and digits only, so the text they make up can be searched as it is
        pattern = f"{chr(92)}A" * p.first + f"(?= {' '.join(p.terms)}{'' if p.prefix else ' '})"
        return F.regexp_count(F.concat(F.lit(" "), F.array_join(self.terms, " "), F.lit(" ")), F.lit(pattern))

    def has(self, p: Phrase) -> Column:
        if len(p.terms) == 1 and not p.first:
            return F.exists(self.terms, lambda x: x.startswith(p.terms[0])) if p.prefix else F.array_contains(self.terms, p.terms[0])
        return self.count(p) > 0

    def once(self, body: Callable[[Terms], Column]) -> Column:
        """``body`` of terms that are computed once."""
        return let(self.terms, lambda t: body(Terms(t)))


def _near(terms: Terms, node: Near) -> Column:
    """An array with, for each phrase of a NEAR, the number of its places that are part of some close group."""
    inside = lambda i, m, p: (i <= m) & (i >= m - len(p.terms) - node.distance)

    def counts(places: Column) -> Column:
        own = [places[f"p{k}"] for k in range(len(node.phrases))]
        close = lambda m: functools.reduce(lambda a, b: a & b, [F.exists(x, (lambda p: lambda i: inside(i, m, p))(p)) for x, p in zip(own, node.phrases)])
        good = F.filter(functools.reduce(F.concat, own), close)
        return let(good, lambda g: F.array(*[F.size(F.filter(x, (lambda p: lambda i: F.exists(g, lambda m: inside(i, m, p)))(p))) for x, p in zip(own, node.phrases)]))

    return terms.once(lambda t: let(F.struct(*[t.starts(p).alias(f"p{k}") for k, p in enumerate(node.phrases)]), counts))


def _of(terms: Terms | Column) -> Terms:
    return terms if isinstance(terms, Terms) else Terms(terms)


def matches(node: Node, terms: Terms | Column) -> Column:
    """Whether the search terms of a row match."""
    terms = _of(terms)
    if isinstance(node, Phrase):
        return terms.has(node)
    if isinstance(node, Near):
        return F.get(_near(terms, node), F.lit(0)) > 0
    if isinstance(node, And):
        return matches(node.left, terms) & matches(node.right, terms)
    if isinstance(node, Or):
        return matches(node.left, terms) | matches(node.right, terms)
    return matches(node.left, terms) & ~matches(node.right, terms)


@dataclass(frozen=True)
class Stats:
    """Rows, their average number of terms, and how many rows each phrase is in."""

    rows: int
    average: float
    having: tuple[int, ...]


def corpus_stats(rows: DataFrame, node: Node, terms: str = "terms") -> Stats:
    """One pass over the table for all phrases of a query."""
    own = [F.sum(matches(Phrase(p.terms, p.prefix, p.first), F.col(terms)).cast("long")).alias(f"n{i}") for i, p in enumerate(phrases(node))]
    r = rows.agg(F.count("*").alias("rows"), F.avg(F.size(terms)).alias("average"), *own).first()
    return Stats(r["rows"], r["average"] or 0.0, tuple(r[f"n{i}"] or 0 for i in range(len(own))))


def bm25(node: Node, terms: Terms | Column, stats: Stats) -> Column:
    """BM25 of rows, negated so that the best is least. A phrase counts where its own part of the query matches."""
    number, terms = iter(range(len(stats.having))), _of(terms)

    def part(times: Column) -> Column:
        n = stats.having[next(number)]
        idf = math.log((stats.rows - n + 0.5) / (n + 0.5)) if stats.rows else 0.0
        idf = idf if idf > 0 else 1e-6
        tf = times.cast("double")
        length = terms.length() / F.lit(float(stats.average or 1.0))
        return F.lit(idf) * (tf * (K1 + 1)) / (tf + K1 * (F.lit(1 - B) + B * length))

    def score(n: Node) -> Column:
        if isinstance(n, Phrase):
            return part(terms.count(n))
        if isinstance(n, Near):
            found = _near(terms, n)
            return functools.reduce(lambda a, b: a + b, [part(F.get(found, F.lit(k))) for k in range(len(n.phrases))])
        left = score(n.left)
        if isinstance(n, Or):
            return left + score(n.right)
        right = score(n.right)
        return F.when(matches(n, terms), left + right if isinstance(n, And) else left).otherwise(0.0)

    return -score(node)
