"""Operators that compare documents: against brute force, and over odd tables."""

import hashlib
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import ALNUM, ODD, SPACED, component_of, linked, lower, odd_table, shingles, windows
from lodestack.llm import common, decontaminate, graph, passages, registry, similar

SF = "/root/testdata/sf0.001"


def words_of(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


# components


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((200, 190),):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(900 + k, 901 + k) for k in range(9)] + [(7, None), (None, 7)]
        adjacent = {}
        for a, b in edges:
            if a is not None and b is not None:
                adjacent.setdefault(a, set()).add(b)
                adjacent.setdefault(b, set()).add(a)
        got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == component_of(adjacent)
        a, b = zip(*[e for e in edges if None not in e])
        child, root = graph.forest(np.array(a), np.array(b))
        assert {c: r for c, r in zip(child.tolist(), root.tolist())} == {k: v for k, v in component_of(adjacent).items() if k != v}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Jaccard join


def check_similar(spark, texts, blocks=None):
    t = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["n_similar"], r["component_id"]) for r in similar.similar(t).collect()}
    sets = {k: shingles(v) for k, v in texts.items()}
    links = linked({k: s for k, s in sets.items() if s})
    root = component_of(links)
    assert got == {k: (len(sets[k]), len(links.get(k, ())), root.get(k, k)) for k in texts}


def test_similar_against_brute_force(spark):
    rng = random.Random(3)
    texts, n = {}, 0
    for size in (1, 3, 4, 5, 6, 7, 9, 12, 20, 40, 80, 150, 400):
        for _ in range(4):
            base = words_of(rng, size)
            for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.1):
                texts[n] = " ".join(edited(rng, base, share)[rng.randrange(2) :])
                n += 1
    shared = " ".join(words_of(rng, 13))
    for _ in range(60):  # passages that many documents share
        texts[n] = shared + " " + " ".join(words_of(rng, rng.choice([3, 20, 60]), 10**6)) + " " + shared
        n += 1
    check_similar(spark, texts | {n + k: t for k, t in enumerate(ODD)})


def test_similar_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_SETS", 7)
    rng = random.Random(4)
    base = words_of(rng, 120)
    check_similar(spark, {k: " ".join(edited(rng, base, rng.choice([0, 0.004, 0.012, 0.03]))) for k in range(60)})


def test_a_phrase_of_many_short_texts_makes_no_large_component(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_SETS", 20)
    monkeypatch.setattr(similar, "RARE", 3)
    sent, passes = [], similar._passes
    monkeypatch.setattr(similar, "_passes", lambda candidate, classes: sent.append(candidate.select(F.sum("blocks"), F.count("*")).first()) or passes(candidate, classes))
    rng = random.Random(6)
    phrase, texts = words_of(rng, 13), {}
    for k in range(150):
        own = words_of(rng, 6, 10**6)
        texts[2 * k] = " ".join(phrase + own[: 3 + k % 4])
        texts[2 * k + 1] = " ".join(words_of(rng, 3, 10**6)[: k % 3] + phrase + own[: 3 + k % 4]) if k % 5 == 0 else " ".join(words_of(rng, 9, 10**6))
    check_similar(spark, texts)
    blocks, n = sent[0]
    assert n and blocks <= 2 * n  # a text goes to as many pairs of blocks as its component has blocks


def test_similar_sets_share_a_rare_shingle():
    rng = np.random.default_rng(8)
    for size in (1, 2, 4, 5, 6, 9, 24, 25, 26, 60, 131):
        common = -(-80 * size // 100)
        universe = rng.integers(0, 2**64, 400, dtype=np.uint64)
        base = universe[:size]
        for less in {0, size - common}:
            for more in {0, (size - less) * 100 // 80 - size, size // 4}:
                other = np.concatenate([base[: size - less], universe[300 : 300 + more]])
                if 100 * (size - less) < 80 * (size + more):
                    continue
                known = np.sort(rng.choice(universe, 50, replace=False))
                sets = np.concatenate([np.sort(base), np.sort(other)])
                sig, owner, turn = similar.prefixes(sets, np.array([0, size, len(sets)]), known, rng.integers(1, 9, 50))
                own = [set(zip(sig[owner == k].tolist(), turn[owner == k].tolist())) for k in (0, 1)]
                assert own[0] & own[1]


def test_nodes_of_a_signature_are_linked_wherever_its_entries_go():
    rng = np.random.default_rng(9)
    parts = 32
    sig = np.repeat(rng.integers(0, 2**64, 40, dtype=np.uint64), 60)
    code, node = similar._codes(sig, np.full(len(sig), 4), parts), np.arange(len(sig))
    slices = [similar._entries(code[k::2], node[k::2], True) for k in (0, 1)]
    edges = []
    for part in range(parts):
        mine = [rows.slice(r, 1) for rows in slices for r in range(rows.num_rows) if rows.column(0)[r].as_py() == part]
        for rows in similar._link(iter(mine)):
            edges += list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
    adjacent = {}
    for a, b in edges:
        adjacent.setdefault(a, set()).add(b)
        adjacent.setdefault(b, set()).add(a)
    root = component_of(adjacent)
    assert all(root[k] == k // 60 * 60 for k in range(len(sig)))


def test_shuffle_files_go_with_the_table_they_made(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    files = lambda: manager.diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    had, before = spark.conf.get(common.SHUFFLE_CLEANUP), files()
    kept = common.stored(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(20):
        if files() > before:
            time.sleep(0.1)
    assert files() <= before and spark.conf.get(common.SHUFFLE_CLEANUP) == had and kept.count() == 7


def test_stored_tables_have_no_files_besides_their_own(spark):
    kept = common.stored(spark.range(0, 100, 1, 3))
    files = os.listdir(kept._lodestack_path.removeprefix("file:"))
    assert len(files) == 3 and all(f.startswith("part-") for f in files) and kept.count() == 100


def test_keys_meet_in_as_many_parts_as_asked_for(spark):
    rows = [(k, d, d % 3 == 0) for d in range(12) for k in range(40) if (k + d) % 4 == 0]
    met = passages.met_by_key(spark.createDataFrame(rows, "key long, doc long, short boolean"), 7)
    want = sorted((d, e) for k, d, short in rows for j, e, _ in rows if k == j and d > e and not short)
    assert met.rdd.getNumPartitions() == 7 and sorted(map(tuple, met.collect())) == want


def test_links_within_by_any_means():
    rng = random.Random(5)
    base = [rng.randrange(10**9) for _ in range(60)]
    sets = [np.array(sorted({x if rng.random() > 0.1 else rng.randrange(10**9) for x in base[rng.randrange(3) :]}), np.uint64) for _ in range(25)]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    got = similar.links_within(np.concatenate(sets), first)
    want = linked({k: {int(x) for x in s} for k, s in enumerate(sets)})
    assert {k: set(np.flatnonzero(got[k]).tolist()) for k in want} == want
    cut = similar.links_within(np.concatenate(sets), first, 10)
    assert not cut[:10, :10].any() and not cut[10:, 10:].any() and np.array_equal(cut[:10, 10:], got[:10, 10:])


def test_a_similar_pair_shares_enough_signatures():
    rng = np.random.default_rng(0)
    for size in (1, 2, 4, 5, 8, 11, 17, 30, 64, 200, 900):
        low, parts, room, need = similar.bands(2 * size + 5)
        for _ in range(30):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            drop = int(rng.integers(0, size // 9 + 1))
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)]) if rng.random() < 0.5 else a[: size - size // 5]
            if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
                continue
            sig, owner, turn = similar.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]))
            both = set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())
            by_turn = {}
            for s in both:
                by_turn.setdefault(int(turn[sig == s][0]), []).append(s)
            assert any(len(v) >= need[t // similar.ROUNDS] for t, v in by_turn.items()), (size, len(both))


def test_similar_odd(spark):
    t = odd_table(spark)
    rows = similar.similar(t).collect()
    assert len(rows) == t.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert all(r["n_similar"] == 0 and r["component_id"] == r["doc_id"] for r in by_id[0])
    assert by_id[6][0]["component_id"] == 6 and by_id[len(ODD) + 6][0]["component_id"] == 6
    assert len(by_id[8]) == 3 and all(r["n_similar"] == 3 for r in by_id[8])
    assert similar.similar(t.limit(0)).count() == 0
    kept = similar.deduplicate(t).collect()
    with_words = [r["text"] for r in kept if SPACED.search(r["text"] or "")]
    assert len({lower(x) for x in with_words}) == len(with_words) and set(kept[0].asDict()) == set(t.columns)
    assert {lower(x).split()[0] for x in with_words} == {lower(r["text"]).split()[0] for r in t.collect() if SPACED.search(r["text"] or "")}
    assert sum(not SPACED.search(r["text"] or "") for r in kept) == sum(not SPACED.search(r["text"] or "") for r in t.collect())


def test_rows_without_ids(spark):
    t = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (None, "x y"), (5, "A b c d e f g")], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["n_similar"], r["component_id"]) for r in similar.similar(t).collect()), key=str)
    assert rows == sorted([(None, 2, 5), (None, 2, 5), (None, 0, None), (5, 2, 5)], key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in similar.deduplicate(t).collect()), key=str) == sorted([(None, "x y"), (5, "A b c d e f g")], key=str)


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(21)
    a, b = words_of(rng, 40, 10**6), words_of(rng, 40, 10**6)
    rows = [(5, a), (5, b), (6, [*a, "x"]), (7, [*b, "y"]), (8, words_of(rng, 40, 10**6)), (5, [*a, "z"])]
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_similar"], r["component_id"]) for r in similar.similar(t).collect())
    assert got == [(5, 1, 5), (5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 1, 5), (8, 0, 8)]
    kept = sorted((r["doc_id"], r["text"].split()[0]) for r in similar.deduplicate(t).collect())
    assert kept == sorted([(5, a[0]), (5, b[0]), (8, rows[4][1][0])])


def test_packed_integers():
    rng = np.random.default_rng(2)
    for planes in (False, True):
        for width in (5, 6, 8):
            x = rng.integers(0, 1 << 8 * width - 1, 100).astype(np.uint64)
            cut = np.array([0, 3, 3, 40, 100])
            got, at = common.unpack(common.pack(x, cut, width, planes).slice(1, 3), width, planes)
            assert np.array_equal(got, x[3:]) and np.array_equal(at, cut[1:] - 3)
    assert len(common.unpack(common.pack(x[:0], np.array([0, 0]), 5, True), 5, True)[0]) == 0


def test_entries_spread_evenly():
    rng = np.random.default_rng(3)
    hot = np.repeat(rng.integers(0, 2**64, 400, dtype=np.uint64), 60)  # signatures that sixty nodes of the slice have
    sig, node = np.concatenate([hot, rng.integers(0, 2**64, 9000, dtype=np.uint64)]), np.concatenate([np.tile(np.arange(60), 400), rng.integers(0, 2**40, 9000)])
    turn = np.full(len(sig), 7)
    rows = similar._entries(similar._codes(sig, turn, 32), node)
    size = np.array([sum(len(rows.column(k)[r].as_py()) for k in range(1, 5)) for r in range(rows.num_rows)])
    assert rows.num_rows == 32 and size.max() <= 2 * np.median(size)
    code, who, link_code, link_node = similar._gather([rows])
    shared = np.isin(sig, hot)
    assert len(link_code) == shared.sum() and set(zip(link_node.tolist(), link_code.tolist())) == set(zip(node[shared].tolist(), similar._codes(sig, turn, 32)[shared].tolist()))
    assert sorted(code.tolist()) == sorted(set(similar._codes(sig, turn, 32).tolist())) and (similar._turns(code) == 7).all()


# substring dedup


def test_minimizers_by_definition():
    rng = np.random.default_rng(1)
    kmers = rng.integers(1, 50, 300).astype(np.uint64)
    row = np.repeat(np.arange(6), 50)
    want = set()
    for r in range(6):
        for a in range(r * 50, r * 50 + 50 - passages.WINDOW + 1):
            own = kmers[a : a + passages.WINDOW]
            want |= {a + int(k) for k in np.flatnonzero(own == own.min())}
    assert set(passages.minimizers(kmers, row).tolist()) == want


def test_chains_are_the_best_ones():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 7)
        segs = np.array([[a, a + (m := rng.randint(1, 6)), c, c + m] for a, c in ((rng.randint(0, 30), rng.randint(0, 30)) for _ in range(n))])

        def best(i):
            own = segs[i][1] - segs[i][0]
            before = [best(j) - passages.GAP_COST * (segs[i][0] - segs[j][1] + segs[i][2] - segs[j][3]) for j in range(n) if segs[j][1] <= segs[i][0] and segs[j][3] <= segs[i][2]]
            return own + max([0, *before])

        top = passages.chains(segs)
        assert sorted(x for c in top for x in c) == list(range(n))
        first = top[0]
        score = sum(segs[i][1] - segs[i][0] for i in first) - sum(passages.GAP_COST * (segs[b][0] - segs[a][1] + segs[b][2] - segs[a][3]) for a, b in zip(first, first[1:]))
        assert score == pytest.approx(max(best(i) for i in range(n)))


def test_longest_common_subsequence():
    assert passages._equal(np.array([1, 2, 3, 4]), np.array([2, 9, 3, 1, 4])) == 3
    assert passages._equal(np.array([], np.int64), np.array([1])) == 0


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], set()).update(range(r["begin_word"], r["end_word"]))
    return out


def test_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(9)
    exact, fuzzy = words_of(rng, 60, 10**6), words_of(rng, 90, 10**6)
    docs, want = {}, {}
    for k in range(80):
        docs[k] = words_of(rng, rng.randint(0, 150), 10**6)
    for k in range(0, 40, 2):
        at = rng.randint(0, len(docs[k]))
        docs[k][at:at] = exact
        want[k] = range(at, at + 60)
    for k in range(41, 70, 4):
        at = rng.randint(0, len(docs[k]))
        part = edited(rng, fuzzy, 0.03 if k > 41 else 0)
        del part[50:52]
        docs[k][at:at] = part
        want[k] = range(at, at + len(part))
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string").repartition(4)
    rows = passages.repeated_passages(t).collect()
    got = covered(rows)
    assert set(got) == set(want) - {0, 41} and all(r["source_doc_id"] < r["doc_id"] for r in rows)
    for k in got:
        assert len(got[k] & set(want[k])) >= 0.9 * len(want[k]) and len(got[k] - set(want[k])) <= 3, (k, len(got[k] & set(want[k])), len(want[k]))
    cut = {r["doc_id"]: r["text"].split() for r in passages.without_passages(t, passages.repeated_passages(t)).collect()}
    assert set(cut) == set(docs)
    for k in docs:
        assert cut[k] == [w for i, w in enumerate(docs[k]) if i not in got.get(k, ())]


def test_passages_of_the_tables(spark):
    texts = {r["doc_id"]: SPACED.findall(lower(r["text"])) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    got, seen, missed, total = covered(registry.op7_substring_dedup(spark, "/root/testdata/sf0.01").collect()), {}, 0, 0
    for k in sorted(texts):
        need = set()
        for i, w in enumerate(windows(texts[k], 50)):
            if seen.setdefault(w, k) != k:
                need |= set(range(i, i + 50))
        total += len(need)
        missed += len(need - got.get(k, set()))
    assert total and missed <= 0.01 * total


def test_passages_odd(spark):
    t = odd_table(spark)
    found = passages.repeated_passages(t)
    rows = found.collect()
    assert all(r["doc_id"] is None or r["doc_id"] >= len(ODD) for r in rows)
    assert passages.without_passages(t, found).count() == t.count() and passages.without_passages(t, found).columns == t.columns
    assert passages.repeated_passages(t.limit(0)).count() == 0


def test_every_copy_in_the_leader_of_a_slice_is_found(spark):
    rng = random.Random(13)
    passage = words_of(rng, 60, 10**6)
    copies = [w for _ in range(3) for w in words_of(rng, 30, 10**6) + passage]
    # each batch is a slice of its own, so document 2 leads its slice
    t = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(copies))], "doc_id long, text string").repartition(2, "doc_id")
    assert t.select(F.spark_partition_id()).distinct().count() == 2
    got = covered(passages.repeated_passages(t).collect())
    assert set(got) == {2} and all(set(range(at, at + 60)) <= got[2] for at in (30, 120, 210))


def test_repetitive_passages_are_found(spark):
    rng = random.Random(14)
    runs = [["word"] * 290, ["one", "short", "line", "again"] * 30, words_of(rng, 19, 10**6) * 6]
    fresh = lambda n: words_of(rng, n, 10**6)
    docs = {1: [w for r in runs for w in fresh(20) + r], 2: [w for r in runs for w in fresh(33) + r], 3: fresh(10) + runs[0] + fresh(40) + runs[0] + fresh(7) + runs[0]}
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string").repartition(2)
    got = covered(passages.repeated_passages(t).collect())
    for k in (2, 3):
        need = {i for i, w in enumerate(docs[k]) if any(w in r for r in runs)}
        assert need <= got[k] and len(got[k] - need) <= 3


def test_passages_that_others_hold_in_parts_are_found(spark):
    rng = random.Random(15)
    fresh = lambda n: words_of(rng, n, 10**6)
    passage = fresh(60)
    docs = {1: fresh(25) + passage[:30] + fresh(9), 2: fresh(14) + passage[30:] + fresh(20), 3: fresh(31) + passage + fresh(8), 4: fresh(12) + passage + fresh(40), 5: passage[7:52] + fresh(3)}
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string").repartition(3)
    rows = passages.repeated_passages(t).collect()
    got = covered(rows)
    assert set(got) == {4, 5} and set(range(12, 72)) <= got[4] and set(range(45)) <= got[5]
    assert {(r["source_doc_id"], r["source_begin"] - r["begin_word"]) for r in rows} == {(3, 19), (3, 38)}


def test_every_two_holders_of_a_fuzzy_passage_are_linked(spark):
    rng = random.Random(20)
    fresh = lambda n: words_of(rng, n, 10**6)
    few, many = fresh(60), fresh(60)
    # earlier documents hold parts of a passage, too short to count
    docs = {1: fresh(25) + few[:30] + fresh(9), 2: fresh(14) + few[30:] + fresh(20)}
    for k in (3, 4, 5):
        docs[k] = fresh(10 * k) + [f"x{k}" if i in (17 + k, 39 + k) else w for i, w in enumerate(few)] + fresh(12)
    # its seeds have more holders than are paired by one of them
    held = range(10, 10 + passages.FREQUENT + 12)
    for k in held:
        docs[k] = fresh(k % 7) + [f"y{k}" if i in (19 + k % 3, 39 + k % 4) else w for i, w in enumerate(many)] + fresh(5)
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string").repartition(3)
    rows = passages.repeated_passages(t).collect()
    at = {k: 10 * k if k < 10 else k % 7 for k in docs}
    want = {(4, 3), (5, 3), (5, 4)} | {(a, b) for a in held for b in held if a > b}
    assert {(r["doc_id"], r["source_doc_id"]) for r in rows} == want
    whole = {(r["doc_id"], r["source_doc_id"]) for r in rows if r["begin_word"] <= at[r["doc_id"]] and r["end_word"] >= at[r["doc_id"]] + 60 and r["source_begin"] <= at[r["source_doc_id"]] and r["source_end"] >= at[r["source_doc_id"]] + 60}
    assert whole == want


def test_every_exact_repeat_is_decided(spark):
    rng = random.Random(16)
    docs = {k: [w for _ in range(rng.randint(0, 6)) for w in rng.choice([words_of(rng, rng.randint(1, 9), 3), ["a"] * rng.randint(1, 30), list("bcdefgh")])] for k in range(60)}
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string").repartition(4)
    rows = passages.exact_passages(t.withColumnRenamed("doc_id", "doc"), 3, 9).collect()
    seen, want = {}, set()
    for k, words in docs.items():
        want |= {(k, i) for i, w in enumerate(windows(words, 9)) if seen.setdefault(w, k) != k}
    assert {(r["doc_id"], i) for r in rows for i in range(r["begin_word"], r["end_word"] - 8)} == want and len(want) > 100
    assert all(docs[r["doc_id"]][r["begin_word"] : r["end_word"]] == docs[r["source_doc_id"]][r["source_begin"] : r["source_end"]] and r["source_doc_id"] < r["doc_id"] for r in rows)


def test_turns_are_those_of_spark(spark):
    docs = [0, 1, -1, 7, 2**40 + 3, -(2**61) - 5, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(d,) for d in docs], "doc long")
    for turns in (1, 3, 16):
        assert [r[0] for r in rows.select(passages._turn(turns)).collect()] == passages.turn_of(np.array(docs), turns).tolist()


def test_passes_hold_their_share_of_matches_and_pairs(spark, monkeypatch):
    rng = random.Random(11)
    base = words_of(rng, 70, 5000)
    rows = [(k, " ".join(words_of(rng, 5, 5000) + edited(rng, base, 0.02) + words_of(rng, 5, 5000))) for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, passages.repeated_passages(docs).collect()))
    plain, held = passages._aligned, {"matches": [], "pairs": []}

    def counted(docs, matches, *rest):
        held["matches"].append(matches.count())
        return plain(docs, matches, *rest)

    pairs = passages.frequent_pairs

    def paired(*args):
        out = pairs(*args)
        held["pairs"].append(out.count())
        return out

    monkeypatch.setattr(passages, "PASS_MATCHES", 10_000)
    monkeypatch.setattr(passages, "PASS_BYTES", 10**6)
    monkeypatch.setattr(passages, "_aligned", counted)
    monkeypatch.setattr(passages, "frequent_pairs", paired)
    assert sorted(map(tuple, passages.repeated_passages(docs).collect())) == whole
    assert len(held["matches"]) > 3 and max(held["matches"]) < sum(held["matches"]) / 2
    assert max(held["pairs"]) < sum(held["pairs"]) / 2
    covered = lambda spans: {(d, w) for d, a, b in spans for w in range(a, b)}
    assert covered(map(tuple, passages.repeated_words(docs).collect())) == covered((r[0], r[2], r[3]) for r in whole)


def test_passages_are_cut_from_rows_without_ids(spark):
    rng = random.Random(17)
    passage = words_of(rng, 60, 10**6)
    own = [words_of(rng, 20 + k, 10**6) for k in range(4)]
    t = spark.createDataFrame([(i, " ".join(w + passage)) for i, w in zip((None, None, None, 7), own)], "doc_id long, text string").repartition(2)
    rows = corpus_pipeline.cut_repeated_passages(spark, t, SF).collect()
    left = {r["text"].split()[0]: len(r["text"].split()) for r in rows}
    assert [r["doc_id"] for r in rows].count(None) == 3
    assert sorted(left[w[0]] - len(w) for w in own) == [0, 0, 0, 60] and left[own[3][0]] == len(own[3])


def test_passages_of_an_id_with_several_texts(spark):
    rng = random.Random(18)
    passage = words_of(rng, 60, 10**6)
    own = [words_of(rng, n, 10**6) for n in (100, 30, 4, 10)]
    rows = [(1, passage), (2, own[0] + passage), (2, own[1] + passage), (2, own[2]), (None, own[3]), (2, own[0] + passage)]
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string").repartition(3)
    found = passages.repeated_passages(t)
    spans = {(r["doc_id"], r["begin_word"], r["end_word"]) for r in found.collect()}
    # a text of id 2 that isn't named by it comes first, so it may be document 1 that gets cut
    assert len(spans) == 2 and {k for k, *_ in spans} <= {1, 2} and all(b - a == 60 for _, a, b in spans)
    cut = [(r["doc_id"], len(r["text"].split())) for r in passages.without_passages(t, found).collect()]
    assert len(cut) == 6 and (2, 4) in cut and (None, 10) in cut
    assert sum(n for _, n in set(cut)) == sum(map(len, own)) + 60
    assert corpus_pipeline.cut_repeated_passages(spark, t, SF).where("doc_id = 2").count() >= 3


def test_a_passage_reaches_far_beyond_its_seeds(spark):
    rng = random.Random(19)
    fresh = lambda n: words_of(rng, n, 10**6)
    # every tenth word differs at the ends, so no seed lies there, but the stretch goes on
    whole = fresh(700)
    other = [f"x{i}" if i % 8 == 3 and not 300 <= i < 400 else w for i, w in enumerate(whole)]
    t = spark.createDataFrame([(1, " ".join(fresh(50) + whole)), (2, " ".join(fresh(20) + other))], "doc_id long, text string")
    got = covered(passages.repeated_passages(t).collect())
    assert len(got[2] & set(range(20, 720))) >= 690


# decontamination


def test_suffix_array_and_search():
    rng = random.Random(2)
    for _ in range(60):
        text = np.array([rng.randrange(4) for _ in range(rng.randint(1, 60))] + [0])
        assert decontaminate.suffix_array(np.append(text[:-1] + 1, 0)).tolist() == sorted(range(len(text)), key=lambda i: (text[:-1] + 1).tolist()[i:] + [0])
        index = decontaminate.FMIndex(text, 4)
        stretches = text.tolist()
        phrases = [[rng.randrange(1, 4) for _ in range(rng.randint(1, 5))] for _ in range(30)]
        table = np.array([[0] * (5 - len(p)) + p for p in phrases])
        low, high = index.search(table, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(text)) if stretches[i : i + len(p)] == p]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def brute_decontamination(texts, items):
    at = {}
    for name, text in items:
        w = ALNUM.findall(lower(text))
        for k in range(max(1, len(w) - 9)) if w else ():
            at.setdefault(tuple(w[k : k + 10]), set()).add(str(name) if name is not None else "null")
    out = []
    for text in texts:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for n in {len(k) for k in at}:
            for i, x in enumerate(windows(w, n)):
                if x in at:
                    hit |= set(range(i, i + n))
                    found |= at[x]
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_decontamination([r["text"] for r in docs], items)
    got = {r["doc_id"]: r for r in registry.op9_benchmark_decontamination(spark, SF).collect()}
    for r, (n, hit, found) in zip(docs, want):
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["contaminated"]) == (n, hit, len(found), hit > 0)
        assert g["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


ITEMS = [(1, "one two three four five"), (2, None), (None, "a b"), (3, ""), (10, " ".join(f"t{k}" for k in range(15))), (10, "zz"), (2, "!")]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination_odd(spark, block):
    t = odd_table(spark)
    more = spark.createDataFrame([(900, "x T3 t4 t5 t6-t7 t8 t9 t10 t11 t12, t13 y zz é"), (901, "t0 t1 t2 t3 t4 t5 t6 t7 t8 t9 t10 t11 t12 t13 t14"), (902, "t0 t1 t2 t3 t4 t5 t6 t7 t8")], "doc_id long, text string")
    t = t.unionByName(more, allowMissingColumns=True).withColumn("spans", F.lit("clash")).withColumn("items", F.lit(1))
    b = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n_hit", F.lit("clash"))
    rows = t.select("doc_id", "text").collect()
    want = sorted(zip([r["doc_id"] for r in rows], brute_decontamination([r["text"] for r in rows], ITEMS)), key=str)
    found = decontaminate.decontaminate(t, b, block_bytes=block)
    got = [(r["doc_id"], (r["n_words"], r["n_hit"], list(r["items"]))) for r in found.collect()]
    assert sorted(got, key=str) == want
    assert decontaminate.decontaminate(t.limit(0), b, block_bytes=block).count() == 0
    assert decontaminate.decontaminate(t, b.limit(0), block_bytes=block).agg(F.sum("n_hit")).first()[0] == 0
    text = decontaminate.decontaminate(more, b, keep=("text",)).select("doc_id", decontaminate.without_spans("text").alias("rest"))
    assert {r["doc_id"]: r["rest"] for r in text.collect()} == {900: "x  y  é", 901: "", 902: "t0 t1 t2 t3 t4 t5 t6 t7 t8"}


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline as P
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "tokens"]
    states = [docs]
    for _, f in P.STAGES[:-1]:
        path = P.work_dir(spark)
        f(spark, states[-1], SF).write.parquet(path)
        states.append(spark.read.parquet(path))
        assert states[-1].columns == docs.columns and states[-1].dtypes == docs.dtypes
    rows = [{r["doc_id"]: r for r in s.collect()} for s in states]
    # toxicity: what the classifier predicts of its input, and nothing else
    gone = {r["doc_id"] for r in registry.op8_toxicity(spark, SF).where("predicted = 1").collect()}
    assert set(rows[1]) == set(rows[0]) - gone
    # near duplicates: one document, the first, of each component
    sets = {k: shingles(r["text"]) for k, r in rows[1].items()}
    root = component_of(linked({k: s for k, s in sets.items() if s}))
    assert set(rows[2]) == {k for k in rows[1] if root.get(k, k) == k}
    # passages: no long repeat is left, and clean documents are as they were
    seen, repeats = {}, 0
    for k in sorted(rows[3]):
        own = SPACED.findall(lower(rows[3][k]["text"]))
        repeats += sum(seen.setdefault(w, k) != k for w in windows(own, 60))
        assert rows[3][k]["n_chars"] == len(rows[3][k]["text"])
    assert repeats == 0
    first, shared = {}, set()
    for k in sorted(rows[2]):
        for w in windows(SPACED.findall(lower(rows[2][k]["text"])), 12):
            if first.setdefault(w, k) != k:
                shared |= {k}
    assert all(rows[3][k]["text"] == rows[2][k]["text"] for k in rows[2] if k not in shared)
    # decontamination: no phrase is left where it was
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    keys = list(rows[3])
    for k, (_, hit, _) in zip(keys, brute_decontamination([rows[3][k]["text"] for k in keys], items)):
        if not hit:
            assert rows[4][k]["text"] == rows[3][k]["text"]
        elif k in rows[4]:
            assert len(ALNUM.findall(rows[4][k]["text"])) == len(ALNUM.findall(rows[3][k]["text"])) - hit
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = P.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == set(rows[4])
    assert all(list(r["ids"]) == lib.encode(rows[4][r["doc_id"]]["text"], add_special_tokens=False).ids for r in out)


def test_pipeline_odd(spark, tmp_path):
    import corpus_pipeline as P

    t = odd_table(spark).withColumn("spans", F.lit(1)).withColumn("__text", F.lit("clash")).withColumn("predicted", F.lit(0))
    for name, rows in (("all", t),):
        d = tmp_path / name
        rows.write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(0, 1, 0), (None, None, None), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        got = P.run(spark, str(d)).collect()
        assert (len(got) > 10) == (name == "all")
