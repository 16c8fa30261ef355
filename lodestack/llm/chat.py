"""Chat transcripts: roles by a hidden Markov model, then canonical turns.

Every line of a transcript is in one of six states: the first or a later line of a system, user or assistant turn. What a
line shows (a speaker marker, its length, a question, a blank line before it) depends on its state, and states follow each
other as turns do. Both are counted over a labelled conversation table; Viterbi decoding then finds the most likely states, so
a missing or misleading marker is outvoted by its neighbours. Markers are cut off and turns are rendered in one form.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text

ROLES = ("system", "user", "assistant")
_NAMES = {"system": "system", "instruction": "system", "instructions": "system", "user": "user", "human": "user", "question": "user", "customer": "user", "q": "user", "prompter": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant", "response": "assistant", "model": "assistant", "gpt": "assistant", "agent": "assistant"}
_NAME = "|".join(sorted(_NAMES, key=len, reverse=True))
_MARKER = re.compile(rf"\s*(?:<\|(?:im_start\|>)?\s*(?P<a>{_NAME})\s*(?:\|>)?|(?:\#{{1,4}}\s*|\*\*|\[)?(?P<b>{_NAME})(?:\*\*|\])?\s*:(?:\*\*)?)\s*", re.I)
#: Chances that the first line of a turn has no marker: transcripts keep all, most or few of them, and each is decoded under
#: the habit that explains it best. A wrong marker has the chance ``OTHER``.
HABITS, OTHER = (0.002, 0.2, 0.6), 0.01
#: Consecutive turns that are decoded together when a conversation is read from a table of turns.
BLOCK_TURNS = 256
SCHEMA = "turns array<struct<role:string,text:string>>, rendered string, n_lines int"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def role_of(name: str | None) -> str | None:
    """The canonical role of a speaker's name, if it has one."""
    return _NAMES.get((name or "").strip().lower())


def marker(line: str) -> tuple[str | None, str]:
    """(role that the line's marker names, line without it)."""
    m = _MARKER.match(line)
    return (role_of(m["a"] or m["b"]), line[m.end() :]) if m else (None, line)


def shape(line: str, after_blank: bool) -> int:
    """What a line shows besides its marker: length class, question or not, blank line before or not."""
    size = len(line)
    return (0 if size < 60 else 1 if size < 200 else 2) * 4 + 2 * line.rstrip().endswith("?") + after_blank


SHAPES = 12


class Model:
    """Log chances of the six states: ``2 * role`` begins a turn, ``2 * role + 1`` goes on with it."""

    def __init__(self, lines: dict[tuple[str, bool, int], int] | None = None, follows: dict[tuple[str | None, str], int] | None = None) -> None:
        lines, follows = lines or {}, follows or {}
        self.show = []
        for role in ROLES:
            for first in (True, False):
                own = [lines.get((role, first, s), 0) + 1 for s in range(SHAPES)]
                self.show.append([math.log(x / sum(own)) for x in own])
        self.enter = self._shares([follows.get((None, r), 0) for r in ROLES])
        self.next = [self._shares([follows.get((r, s), 0) for s in ROLES], r) for r in ROLES]
        self.stay, self.leave = [], []
        for role in ROLES:
            begun = sum(lines.get((role, True, s), 0) for s in range(SHAPES)) + 1
            more = sum(lines.get((role, False, s), 0) for s in range(SHAPES)) + 1
            self.stay.append(math.log(more / (begun + more)))
            self.leave.append(math.log(begun / (begun + more)))
        self.marks = []
        for none in HABITS:
            mark = {}
            for seen in (None, *ROLES):
                row = []
                for role in ROLES:
                    row.append(math.log(none if seen is None else 1 - none - OTHER if seen == role else OTHER / 2))
                    row.append(math.log(0.995 if seen is None else 0.005 / 3))
                mark[seen] = row
            self.marks.append(mark)

    @staticmethod
    def _shares(counts: list[int], role: str | None = None) -> list[float]:
        own = [c + (0.5 if r == role else 1.0) for c, r in zip(counts, ROLES)]
        return [math.log(x / sum(own)) for x in own]

    def decode(self, seen: list[tuple[str | None, int]]) -> list[int]:
        """The most likely states of the lines, each given as marker and shape; of equal paths, the one of lower states."""
        return max((self._viterbi(seen, marks) for marks in self.marks), key=lambda x: x[0])[1] if seen else []

    def _viterbi(self, seen: list[tuple[str | None, int]], marks: dict[str | None, list[float]]) -> tuple[float, list[int]]:
        mark, what = seen[0]
        best = [self.enter[s // 2] + marks[mark][s] + self.show[s][what] if s % 2 == 0 else -1e30 for s in range(6)]
        back = []
        for mark, what in seen[1:]:
            ends = [max((best[2 * r], best[2 * r + 1])) + self.leave[r] for r in range(3)]
            new, own = [], []
            for s in range(6):
                r = s // 2
                if s % 2 == 0:
                    q = max(range(3), key=lambda q: ends[q] + self.next[q][r])
                    value, come = ends[q] + self.next[q][r], 2 * q if best[2 * q] >= best[2 * q + 1] else 2 * q + 1
                else:
                    come = s - 1 if best[s - 1] >= best[s] else s
                    value = best[come] + self.stay[r]
                new.append(value + marks[mark][s] + self.show[s][what])
                own.append(come)
            best = new
            back.append(own)
        state = max(range(6), key=lambda s: best[s])
        path = [state]
        for own in reversed(back):
            state = own[state]
            path.append(state)
        return best[path[0]], path[::-1]

    def parse(self, transcript: str | None) -> tuple[list[tuple[str, str]], int]:
        """Turns of a transcript, and its number of lines with text. Blank lines inside a turn stay in it."""
        lines, blank = [], False
        for raw in (transcript or "").split("\n"):
            if not raw.strip():
                blank = True
                continue
            role, rest = marker(raw)
            lines.append((role, rest, shape(rest, blank), raw, blank))
            blank = False
        turns: list[list] = []
        for state, (_, rest, _, raw, blank) in zip(self.decode([(x[0], x[2]) for x in lines]), lines):
            if state % 2 == 0:
                turns.append([ROLES[state // 2], [rest]])
            else:
                turns[-1][1] += [""] * blank + [raw]
        return [(role, "\n".join(text).strip()) for role, text in turns], len(lines)


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form: a line that names the role, the text, a line that ends the turn."""
    return "\n".join(f"<|{role}|>\n{text}\n<|end|>" for role, text in turns)


def learn(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Model:
    """The model of a table of labelled turns: counts over all its rows, of which only sums come to the driver.

    Rows without a known role, or with a null turn, aren't counted. A turn is followed by the row of the same conversation
    whose number is one higher.
    """
    known = turns.select(turns[id_col].alias("id"), turns[turn_col].cast("long").alias("turn"), turns[role_col].cast("string").alias("role"), turns[text_col].cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bool, int], int] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                role, first, blank = role_of(name), True, False
                for line in (text or "").split("\n") if role else ():
                    if not line.strip():
                        blank = True
                        continue
                    key = (role, first, shape(line, blank))
                    seen[key] = seen.get(key, 0) + 1
                    first, blank = False, False
        rows = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int32()), pa.array([seen[r] for r in rows], pa.int64())], names=["role", "first", "shape", "n"])

    lines = known.select("role", "text").mapInArrow(count, "role string, first boolean, shape int, n long").groupBy("role", "first", "shape").agg(F.sum("n").alias("n"))
    name = F.lower(F.trim("role"))
    roles = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    numbered = known.where(F.col("turn").isNotNull() & F.col("id").isNotNull()).select("id", "turn", F.try_element_at(roles, name).alias("role"))
    one = numbered.groupBy("id", "turn").agg(F.min("role").alias("role"))
    before = one.select("id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
    pairs = one.join(before, ["id", "turn"], "left").where(F.col("role").isNotNull() & (F.col("before").isNotNull() | (F.col("turn") == 0))).groupBy("before", "role").count()
    return Model({(r["role"], r["first"], r["shape"]): r["n"] for r in lines.collect()}, {(r["before"], r["role"]): r["count"] for r in pairs.collect()})


def transcripts(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK_TURNS) -> DataFrame:
    """(id, block, transcript): turns of each conversation in order, each behind its speaker's name, ``block`` numbers a piece.

    A very long conversation is several rows, so none is gathered whole. A null role gives no marker, a null text an empty
    one; turns without a number are one block, of their own (null), in order of role and text.
    """
    number = turns[turn_col].cast("long")
    role, text = turns[role_col].cast("string"), F.coalesce(turns[text_col].cast("string"), F.lit(""))
    line = F.when(role.isNull() | (F.trim(role) == ""), text).otherwise(F.concat(F.initcap(role), F.lit(": "), text))
    rows = turns.select(turns[id_col].alias(id_col), F.floor(number / block).alias("block"), F.struct(number.alias("turn"), role.alias("role"), line.alias("line")).alias("one"))
    return rows.groupBy(id_col, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["line"]), "\n").alias("transcript"))


def _worker(shared):
    def make():
        model: Model = shared.value

        def work(column: pa.Array) -> dict:
            found = [model.parse(x) for x in column.to_pylist()]
            return {
                "turns": pa.array([[{"role": r, "text": t} for r, t in turns] for turns, _ in found], _TURNS),
                "rendered": pa.array([render(turns) for turns, _ in found], pa.string()),
                "n_lines": pa.array([n for _, n in found], pa.int32()),
            }

        return work

    return make


def format_chats(df: DataFrame, model: Model, keep: tuple[str, ...] = ("conv_id", "block"), text_col: str = "transcript") -> DataFrame:
    """One row per row of ``df``: ``keep`` columns, turns, rendered and n_lines.

    A null or blank transcript has no turns and renders empty. Consecutive turns of one role stay apart. Repeated rows stay,
    an empty table gives an empty result; other columns are ignored.
    """
    return map_text(df, list(keep), text_col, SCHEMA, _worker(df.sparkSession.sparkContext.broadcast(model)))


def roles_of(turns: str = "turns") -> Column:
    """The roles of a turns column, comma-joined."""
    return F.array_join(F.transform(F.col(turns), lambda t: t["role"]), ",")
