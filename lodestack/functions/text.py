"""Text functions as Columns: tokens, search terms, identities, metadata keys."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    accented, plain = [], []
    for c in map(chr, range(0xC0, 0x250)):
        parts = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(parts) == 2 and unicodedata.combining(parts[1]):
            accented.append(c)
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _plain_letters()
_TO_PLAIN = str.maketrans(ACCENTED, PLAIN)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it, also inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def terms(text: Column) -> Column:
    """Search terms: runs of letters and digits in lower case, without diacritics."""
    return F.filter(F.split(F.translate(F.lower(text), ACCENTED, PLAIN), r"[^\p{L}\p{N}\p{Co}]+"), lambda x: x != "")


def query_terms(text: str) -> list[str]:
    """What ``terms`` gives, for a string of a query."""
    low = text.lower().translate(_TO_PLAIN)
    return "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in low).split()


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def doc_id(path: Column, content: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("\x00"), content), 256)


def chunk_id(doc: Column, offset: Column) -> Column:
    return F.sha2(F.concat(doc, F.lit(":"), offset.cast("string")), 256)


def meta_key(raw: Column) -> Column:
    """A metadata key in one form: lower case, words joined by one underscore, other characters dropped."""
    joined = F.regexp_replace(F.regexp_replace(F.trim(raw), r"[^A-Za-z0-9 _-]", ""), r"[ _-]+", "_")
    return F.lower(F.regexp_replace(joined, r"\A_+|_+\z", ""))


_CODE = "rs py js ts go java c cc cpp h hpp cs rb php swift kt scala sh bash zsh toml yaml yml json".split()


def parser_of(path: Column, hint: str | None = None) -> Column:
    """plain, markdown or code: the hint if there is one, else by the path's extension."""
    if hint:
        if hint not in ("plain", "markdown", "code"):
            raise ValueError(f"no such parser: {hint}")
        return F.lit(hint)
    extension = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)\z", 1))
    return F.when(extension.isin("md", "markdown", "mdx"), "markdown").when(extension.isin(*_CODE), "code").otherwise("plain")
