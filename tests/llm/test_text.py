import random
import re

import numpy as np
import pyarrow as pa

from helpers import ALNUM, ODD, SPACED, lower
from lodestack.llm import common as C


def test_words_are_those_of_the_expressions():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "Z", " ", "\t", "\n", "\x0b", "\x1f", "é", "日", "9", "_", "-", "\x85"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for column in (pa.array(texts, pa.string()), pa.array(["skip", *texts], pa.large_string()).slice(1)):
        for table, pattern in ((C.SPACE_WORD, SPACED), (C.ALNUM_WORD, ALNUM)):
            got = []
            for a, b in C.row_slices(column, 500):
                data, offsets = C.text_bytes(column.slice(a, b - a), lower=True)
                starts, ends, first = C.runs(table[data], offsets)
                raw = data.tobytes()
                got += [[raw[starts[k] : ends[k]].decode() for k in range(first[r], first[r + 1])] for r in range(len(offsets) - 1)]
            assert got == [pattern.findall(lower(t)) for t in texts]


def test_hashes_depend_on_bytes_only():
    data = np.frombuffer(b"abc abd abc  abc" * 50, np.uint8)
    starts, ends, _ = C.runs(C.SPACE_WORD[data], np.array([0, len(data)]))
    words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    by = {}
    for w, h in zip(words, C.span_hashes(data, starts, ends)):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    assert len(C.window_hashes(np.arange(3, dtype=np.uint64), 5)) == 0


def test_hashes_of_structured_spans_differ():
    for n in (10, 12):
        bits = np.array([bin(k).count("1") & 1 for k in range(1 << n)], np.uint8)  # sums of powers modulo 2**64 can't tell these apart
        data = np.concatenate([bits + 97, 98 - bits, bits + 97])
        at = np.arange(3) << n
        a, b, c = C.span_hashes(data, at, at + (1 << n))
        assert a != b and a == c


def test_hashes_of_all_lengths():
    rng = np.random.default_rng(5)
    data = np.tile(rng.integers(0, 256, 150).astype(np.uint8), 2)
    for size in range(150):
        a, b, c = C.span_hashes(data, np.array([0, 150, 1]), np.array([size, 150 + size, 1 + size]))
        assert a == b and (a != c or size == 0)
    some = [(i, j) for i in range(40) for j in range(i, 120)]
    begin, end = np.array(some).T
    assert len(set(C.span_hashes(data, begin, end).tolist())) == len({data[i:j].tobytes() for i, j in some})


def test_slices_cover_all_rows():
    column = pa.array(["x" * n for n in (0, 5, 0, 100, 1, 1)])
    assert [b - a for a, b in C.row_slices(column, 6)] and sum(b - a for a, b in C.row_slices(column, 6)) == 6
    assert list(C.row_slices(pa.array([], pa.string()))) == []


def test_work_dir_is_refused_on_a_cluster_without_a_folder():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://x"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    try:
        C.work_dir(Session())
        raise AssertionError("no error")
    except ValueError as e:
        assert re.search("checkpoint", str(e))
