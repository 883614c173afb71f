"""Links, repeated windows and repeated strings against brute force."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from conftest import corpus

from mcqflow.llm import jaccard, substrings, suffix
from mcqflow.llm.components import components
from mcqflow.llm.words import word_names, words_of_texts


def test_word_digests_follow_the_words():
    texts = [b"a b  a", b"", b"\xc3\xa9 A\x0bb\n", b"aa a"]
    names, cuts = words_of_texts(texts)
    assert np.diff(cuts).tolist() == [3, 0, 3, 2]
    assert names[0] == names[2] == names[7] and names[1] == names[5] and len(set(names.tolist())) == 5
    assert word_names(b"ABC abc", lower=True)[0].tolist() == [int(word_names(b"abc")[0][0])] * 2


def thue_morse(n, a="a", b="b"):
    """Two words that differ everywhere and collide under polynomials modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("n", [32, 64, 1024, 2048, 4096])
def test_long_words_have_names_of_their_own(frame, n):
    x, y = thue_morse(n)
    assert word_names(x.encode())[0][0] != word_names(y.encode())[0][0]
    assert word_names(x.upper().encode(), lower=True)[0][0] == word_names(x.encode())[0][0]


def test_long_words_are_told_apart(frame):
    x, y = thue_morse(2048)
    rest = [f"w{i}" for i in range(19)]
    docs = [(1, " ".join([*rest, x]), "s"), (2, " ".join([*rest, y]), "s"), (3, f"a b {x} c d", "s"), (4, f"a b {y} c d", "s"), (5, f"A b {x.upper()} c d", "s")]
    got = {r.doc_id: r.component_id for r in jaccard.link_components(frame(docs)).collect()}
    assert got == brute.components(docs) and got[4] == 4 and got[5] == 3
    rows = substrings.remove_repeats(frame(docs)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == brute.substrings(docs)


def test_many_copies_of_one_row(frame, monkeypatch):
    """Equal rows in every partition, through the broadcast and the shuffled joins."""
    base = [f"w{i}" for i in range(40)]
    near = " ".join([*base[:39], "edit"])
    rows = [(7, " ".join(base), "s")] * 60 + [(9, near, "s")] * 3 + [(8, "other words only here " * 3, "s")]
    for most in (jaccard.BROADCAST_ROWS, 0):
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", most)
        got = jaccard.link_components(frame(rows)).collect()
        assert len(got) == 64 and {r.doc_id: r.component_id for r in got} == {7: 7, 9: 7, 8: 8}
        assert sorted(r.doc_id for r in jaccard.keep_one(frame(rows)).collect()) == [7, 8]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(frame, seed):
    docs = corpus(seed, 60)
    got = {r.doc_id: r for r in jaccard.link_components(frame(docs)).collect()}
    want = brute.components(docs)
    for d, t, _ in docs:
        assert (got[d].n_shingles, got[d].component_id) == (len(brute.shingles(t)), want[d])
    kept = jaccard.keep_one(frame(docs))
    assert kept.columns == frame(docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({want[d] for d, *_ in docs})


def test_components_of_odd_rows(odd, empty):
    rows = jaccard.link_components(odd).collect()
    assert len(rows) == 9 and jaccard.link_components(empty).count() == 0
    assert all(r.component_id == r.doc_id for r in rows)
    assert jaccard.keep_one(odd).count() == 8 and jaccard.keep_one(empty).count() == 0


def test_large_groups_are_cut_into_parts(spark, frame, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_ROWS", 3)
    monkeypatch.setattr(jaccard, "LEADS", 1)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*base[: i + 5], f"edit{i}", *base[i + 6 :]]), "s") for i in range(30)]
    got = {r.doc_id: r.component_id for r in jaccard.link_components(frame(docs)).collect()}
    assert got == brute.components(docs)


def test_sets_that_meet_by_chance_do_not_move(frame, monkeypatch):
    """Every text shares a few shingles with the next one; only clusters of near copies send sets."""
    docs = []
    for i in range(40):
        words = [f"w{i}_{k}" for k in range(60)]
        words[20:27] = [f"shared{i // 2}_{k}" for k in range(7)]
        docs.append((2 * i, " ".join(words), "s"))
        if i % 4 == 0:
            docs.append((2 * i + 1, " ".join([*words[:-1], "edit"]), "s"))
    moved, asked = [], jaccard._asked_sets
    monkeypatch.setattr(jaccard, "_asked_sets", lambda active, ids: moved.append(ids.count()) or asked(active, ids))
    got = {r.doc_id: r.component_id for r in jaccard.link_components(frame(docs)).collect()}
    assert got == brute.components(docs) and moved == [20]
    for name in ("FEW", "CLUSTER_SHINGLES"):  # all by larger groups, or by keys
        monkeypatch.setattr(jaccard, name, 0)
        assert {r.doc_id: r.component_id for r in jaccard.link_components(frame(docs)).collect()} == got


def test_rows_that_can_meet_stay():
    r = random.Random(4)
    for _ in range(300):
        pool = [f"x{i}" for i in range(r.randint(5, 60))]
        order = {x: i for i, x in enumerate(r.sample(pool, len(pool)))}
        sets = [sorted(r.sample(pool, r.randint(1, len(pool))), key=order.get) for _ in range(r.randint(2, 6))]
        rows = [(x, k, len(s), i) for k, s in enumerate(sets) for i, x in enumerate(s[: jaccard.prefix_length(len(s))])]
        rows.sort(key=lambda q: order[q[0]])
        _, group = np.unique([order[q[0]] for q in rows], return_inverse=True)
        kept = jaccard.may_meet(group, np.array([q[2] for q in rows]), np.array([q[3] for q in rows]))
        stay = {q[:2] for q, k in zip(rows, kept) if k}
        for a in range(len(sets)):
            for b in range(a):
                both = set(sets[a]) & set(sets[b])
                if 100 * len(both) >= 75 * (len(sets[a]) + len(sets[b]) - len(both)):
                    first = min(both, key=order.get)
                    assert {(first, a), (first, b)} <= stay


def test_rtree_finds_all_that_may_link():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in r.integers(1, 400, 200)]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10], r.integers(0, 2**63, len(s) // 20).astype(np.uint64)]) for s in sets[:80]]
    vectors, sizes = np.stack([jaccard.count_vector(s) for s in sets]), np.array([len(s) for s in sets])
    tree = jaccard.RTree(vectors, sizes)
    for i, s in enumerate(sets):
        found = set(tree.search(vectors[i], len(s), 75)[0].tolist())
        for j, t in enumerate(sets):
            both = len(np.intersect1d(s, t))
            assert 100 * both < 75 * (len(s) + len(t) - both) or j in found


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), *((10, i) for i in range(11, 40)), *((i, i + 1) for i in range(50, 80))]
    b = lambda i: bytes([i])
    nodes = spark.createDataFrame([(b(i),) for i in range(1, 90)], "set_id binary")
    frame = spark.createDataFrame([(b(x), b(y)) for x, y in edges], "a binary, b binary")
    got = {r.set_id[0]: r.comp[0] for r in components(nodes, frame).collect()}
    want = {i: i for i in range(1, 90)} | {2: 1, 3: 1, 5: 4} | {i: 10 for i in range(11, 40)} | {i: 50 for i in range(51, 81)}
    assert got == want


@pytest.mark.parametrize("window", [20, 7])
def test_repeated_windows(frame, window):
    docs = corpus(5, 50)
    rows = substrings.remove_repeats(frame(docs), window).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == brute.substrings(docs, window)


def test_repeated_strings(frame):
    docs = corpus(6, 50)
    rows = {r.doc_id: tuple(r)[1:] for r in suffix.remove_repeats(frame(docs)).collect()}
    assert [rows[d] for d, *_ in docs] == brute.strings([t for _, t, _ in docs])
    left = {r.doc_id: r for r in suffix.drop_repeats(frame(docs)).collect()}
    assert all(len(left[d].text.encode()) <= rows[d][0] - rows[d][1] and left[d].n_chars == len(left[d].text) for d in rows)
    assert all(left[d].text == t for d, t, _ in docs if not rows[d][1])
    assert suffix.drop_repeats(frame(docs)).columns == frame(docs).columns


def test_repeats_of_odd_rows(odd, empty):
    assert substrings.remove_repeats(odd).count() == 9 and substrings.remove_repeats(empty).count() == 0
    rows = suffix.remove_repeats(odd).collect()
    texts = odd.collect()
    want = brute.strings([r.text for r in texts if r.text is None or len(r.text) < 10_000])
    got = sorted(tuple(r)[1:] for r in rows if r.n_bytes < 10_000)
    assert got == sorted(want) and suffix.remove_repeats(empty).count() == 0
    assert suffix.drop_repeats(odd).columns == odd.columns


def test_a_long_text_is_taken_in_slices(monkeypatch):
    monkeypatch.setattr(suffix, "SLICE", 1000)
    data = np.frombuffer(b"".join(b"%d " % (i * i % 9973) for i in range(3000)), np.uint8)
    sliced = suffix.anchors_of(data, 200, 32)
    monkeypatch.setattr(suffix, "SLICE", 3 << 20)
    whole = suffix.anchors_of(data, 200, 32)
    for name, at, first, last in zip(*sliced):
        i = np.searchsorted(whole[2], first, side="right") - 1
        assert (whole[0][i], whole[1][i]) == (name, at) and last <= whole[3][i]
    assert (sliced[3] - sliced[2] + 1).sum() == len(data) - 199
