"""Documents into blocks, and blocks into overlapping chunks of tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrow import bound_batches, release


def lines(text: Column) -> Column:
    """Lines of a text, without line ends; a last line end begins no line of its own."""
    return F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n", "\n"), r"\n\z", ""), "\n")


_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANK, _INDENT, _WORD = re.compile(rf"{_SPACE}*\Z"), re.compile(rf"{_SPACE}*(?:fn|def|class|struct|enum|impl|interface) "), re.compile(_SPACE.replace("[", "[^") + "+")


def cut_blocks(text: str, parser: str) -> list[list[str]]:
    """Lines of each block of a text.

    A Markdown block begins at a heading outside a code fence, at an opening fence and after a closing one. A code block
    begins at a line with a definition and after a blank line, which belongs to none. A plain text is one block.
    """
    if parser == "plain":
        return [[text]]
    own = text.replace("\r\n", "\n").removesuffix("\n").split("\n")
    out: list[list[str]] = [[]]
    if parser == "markdown":
        inside = closed = False
        for line in own:
            fence = line.startswith("```")
            if closed or (fence and not inside) or (line.startswith("#") and not fence and not inside):
                out.append([])
            closed = fence and inside
            inside ^= fence
            out[-1].append(line)
    else:
        after_blank = False
        for line in own:
            blank = _BLANK.match(line) is not None
            if after_blank or _INDENT.match(line):
                out.append([])
            if not blank:
                out[-1].append(line)
            after_blank = blank
    return out


def _words(text: str | None, parser: str) -> Iterator[tuple[int, int, list[str]]]:
    """(block, tokens of the text before it, its own tokens) of each block that has any."""
    base = 0
    for k, own in enumerate(cut_blocks(text, parser) if text else ()):
        if words := _WORD.findall("\n".join(own)):
            yield k, base, words
            base += len(words)


def _mapped(make, names: list[str], kinds: list[pa.DataType], most: int = 8 << 20):
    """A function of Arrow batches (key, parser, text): rows of the key and of what ``make(text, parser)`` gives, together
    with their size in bytes; batches of about ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, out, held = batch.column(0), [], [[] for _ in names], 0

            def emit() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), *(pa.array(x, kind) for x, kind in zip(out, kinds))], names=["key", *names])

            for row, (parser, text) in enumerate(zip(batch.column(1), batch.column(2))):
                for size, values in make(text.as_py(), parser.as_py()):
                    rows.append(row)
                    for x, value in zip(out, values):
                        x.append(value)
                    held += size
                    if held > most:
                        yield emit()
                        rows, out, held = [], [[] for _ in names], 0
            yield emit()
            del batch, keys, emit
            rows = out = None
            release()

    return run


def _in_rows(docs: DataFrame, key: str, text: str, parser: str | None, make, columns: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    own = docs.select(F.col(key).alias("key"), (F.col(parser) if parser else F.lit("plain")).alias("parser"), F.col(text).alias("text"))
    schema = ", ".join([f"key {own.schema['key'].dataType.simpleString()}", *(f"`{c}` {kind}" for c, (kind, _) in columns.items())])
    bound_batches(docs.sparkSession)
    return own.mapInArrow(_mapped(make, list(columns), [x for _, x in columns.values()]), schema)


def blocks(docs: DataFrame, key: str = "id", text: str = "text", parser: str = "parser") -> DataFrame:
    """One row per block with tokens: key, block (in order), tokens of the document before it, and its own. No row leaves its
    task: lines of a text are numbered where they are, not by a shuffle."""
    make = lambda text, parser: ((16 * len(words), (k, base, words)) for k, base, words in _words(text, parser))
    return _in_rows(docs, key, text, parser, make, {"block": ("long", pa.int64()), "base": ("long", pa.int64()), "words": ("array<string>", pa.list_(pa.string()))})


def chunks(docs: DataFrame, size: int, overlap: int, key: str = "id", text: str = "text", parser: str | None = None) -> DataFrame:
    """One row per chunk: doc_id, offset (in tokens of the document, without overlaps), tokens, text.

    ``parser`` names the column that tells how each text is cut, else all are plain. Blocks without tokens give none, and
    chunks never span blocks. Texts are cut where they are: a chunk is made of its own tokens only.
    """
    overlap = min(overlap, size - 1)

    def make(text: str | None, parser: str):
        for _, base, words in _words(text, parser):
            for start in range(0, max(0, len(words) - overlap - 1) + 1, size - overlap):
                own = " ".join(words[start : start + size])
                yield len(own) + 24, (base + start, min(size, len(words) - start), own)

    return _in_rows(docs, key, text, parser, make, {"offset": ("long", pa.int64()), "tokens": ("long", pa.int64()), "text": ("string", pa.string())}).withColumnRenamed("key", "doc_id")


def finish_chunks(cut: DataFrame, embedder=None) -> DataFrame:
    """Chunks with ids, search terms and, given an embedder, vectors: rows of the chunk table."""
    vector = embedder.column(F.split("text", " ")) if embedder else F.lit(None).cast("array<float>")
    return cut.select(X.chunk_id(F.col("doc_id"), F.col("offset")).alias("id"), "doc_id", "offset", "tokens", "text", X.terms(F.col("text")).alias("terms"), vector.alias("embedding"), F.lit(False).alias("deleted"))


def chunk_documents(docs: DataFrame, size: int, overlap: int, embedder=None, key: str = "id", text: str = "text", parser: str | None = None) -> DataFrame:
    """The chunk table of documents; ``parser`` names the column that tells how each is cut, else all are plain."""
    return finish_chunks(chunks(docs, size, overlap, key, text, parser), embedder)


def _pairs(own: Column) -> Column:
    """Map of normalised key to value of "key: value" lines; the last of equal keys counts, lines without a key don't."""

    def pair(l: Column) -> Column:
        key = F.substring_index(l, ":", 1)
        return F.struct(X.meta_key(key).alias("k"), F.trim(F.substring(l, F.length(key) + 2, F.length(l))).alias("v"))

    found = F.filter(F.transform(F.filter(own, lambda l: F.contains(l, F.lit(":"))), pair), lambda p: p["k"] != "")
    last = X.let(found, lambda f: F.filter(f, lambda p, i: ~F.exists(F.slice(f, i + 2, F.greatest(F.size(f), F.lit(1))), lambda q: q["k"] == p["k"])))
    return F.map_from_entries(F.array_sort(last))


def _first(own: Column, test) -> Column:
    """The least place at which a test of (line, place) holds; null if there is none."""
    return F.array_min(F.filter(F.transform(own, lambda l, i: F.when(test(l, i), i)), lambda i: i.isNotNull()))


def _from(own: Column, place: Column) -> Column:
    """The lines from a place on; none for a null place."""
    return F.slice(own, F.coalesce(place, F.size(own)) + 1, F.greatest(F.size(own), F.lit(1)))


def front_matter(text: Column) -> Column:
    """Map of the metadata between a first line of --- and the next --- or ...; empty without the first."""

    def inside(own: Column) -> Column:
        closes = _first(own, lambda l, i: (i > 0) & F.trim(l).isin("---", "..."))
        body = F.slice(own, 2, F.coalesce(closes - 1, F.size(own)))
        return F.when(F.trim(F.get(own, F.lit(0))) == "---", body).otherwise(F.slice(own, 1, 0))

    return _pairs(X.let(lines(text), inside))


def header_lines(text: Column) -> Column:
    """Map of the "key: value" lines at the top, after blank lines and at most one # line, up to a line of another kind."""
    skip_blank = lambda own: _from(own, _first(own, lambda l, i: l != ""))

    def below_title(top: Column) -> Column:
        return F.when(F.get(top, F.lit(0)).startswith("#"), X.let(_from(top, F.lit(1)), skip_blank)).otherwise(top)

    def header(top: Column) -> Column:
        return F.slice(top, 1, F.coalesce(_first(top, lambda l, i: (l == "") | ~F.contains(l, F.lit(":"))), F.size(top)))

    own = F.transform(lines(text), lambda l: F.trim(l))
    return _pairs(X.let(X.let(X.let(own, skip_blank), below_title), header))


def metadata(text: Column) -> Column:
    """JSON of a text's metadata with sorted keys: its front matter, else its header lines, else null."""
    json = lambda found: F.when(F.size(found) > 0, F.to_json(found))
    return F.coalesce(X.let(front_matter(text), json), X.let(header_lines(text), json))
