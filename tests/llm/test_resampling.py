"""Importance resampling against a plain version."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from conftest import corpus

from mcqflow.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets(text, n=10_000):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(docs, targets, percent=5):
    """(id, features, weight, score, place) of each row; docs are (id, text)."""
    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in targets for b in buckets(x))
    S, T = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000) / ((s[b] + 1.0) * (T + 10000)))) for b in range(10_000)]
    rows = []
    for d, text in docs:
        found = buckets(text)
        h = int(sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [r for r, (_, text) in zip(rows, docs) if len(words(text)) >= 20]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r) for r in rows]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


TEXTS = [
    "", "a", "A b", " x--y.z é中 \n \x01 q", "long " + "q" * 700 + " tail " + "é" * 400 + " t t t", "---", "q" * 5000,
    *(" ".join(random.Random(i).choices(["the", "Of", "é1", "x9" * 200, "a", "b-c", "\x01\n"], k=7 * i)) for i in range(25)),
]


@pytest.mark.parametrize("chunk", [1, 7, 50, 1000, 1 << 20])
def test_composed_payloads_give_the_crc_of_every_run(chunk):
    parts = [s for i, t in enumerate(TEXTS) for s in resampling.segments(i, i, t.encode(), chunk)]
    got = {i: [] for i in range(len(TEXTS))}
    n_words = Counter()
    for at in range(0, len(parts), 11):
        for r in resampling._featured(parts[at : at + 11], 10_000).to_pylist():
            assert 2 * r["n_features"] == len(r["buckets"])
            got[r["row"]].extend(np.frombuffer(r["buckets"], np.uint16).tolist())
            n_words[r["row"]] += r["n_words"]
    for i, text in enumerate(TEXTS):
        assert sorted(got[i]) == sorted(buckets(text)) and n_words[i] == len(words(text))


def test_scores_and_draw(spark, frame):
    docs = [(d, t) for d, t, _ in corpus(9, 120)] + [(900 + i, t) for i, t in enumerate(TEXTS)]
    targets = [t for _, t, _ in corpus(10, 12)] + [None, ""]
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id bigint, text string")
    want = sorted(plain(docs, targets), key=repr)
    for chunk in (100, resampling.CHUNK):
        assert rows_of(resampling.resample(frame([(d, t, "s") for d, t in docs]), wanted, chunk=chunk)) == want
    drawn = resampling.drawn_documents(frame([(d, t, "s") for d, t in docs]), wanted)
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r[0] for r in want if r[4])
    assert drawn.columns == frame([(1, "x", "s")]).columns


def test_most_like_the_target_come_first(spark, frame):
    r = random.Random(3)
    ours, theirs = [f"o{i}" for i in range(50)], [f"t{i}" for i in range(50)]
    docs = [(i, " ".join(r.choices(theirs if i % 20 == 0 else ours, k=60)), "s") for i in range(400)]
    wanted = spark.createDataFrame([(0, " ".join(r.choices(theirs, k=2000)))], "item_id int, text string")
    got = resampling.resample(frame(docs), wanted).where("rank is not null").collect()
    assert len(got) == 20 and all(r.doc_id % 20 == 0 for r in got)


def test_odd_rows(spark, odd, empty):
    wanted = spark.createDataFrame([(1, "w1 w2 w3 shared id")], "item_id int, text string")
    none = wanted.limit(0)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for frame, targets in ((wanted, ["w1 w2 w3 shared id"]), (none, [])):
        assert rows_of(resampling.resample(odd, frame)) == sorted(plain(docs, targets), key=repr)
        assert resampling.resample(empty, frame).count() == 0


def test_equal_scores_go_to_the_smaller_id(spark):
    rows = [(1, i, 25, 0, 0, 5) for i in (7, 3, 9, None, 1)] + [(2, 4, 19, 0, 0, 50)] + [(3, 100 + i, 20, 0, 0, -i) for i in range(55)]
    scored = spark.createDataFrame(rows, "row bigint, doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    got = {r.doc_id: r["rank"] for r in resampling.drawn(scored, percent=10).collect()}
    assert {d: k for d, k in got.items() if k} == {1: 1, 3: 2, 7: 3, 9: 4, None: 5, 100: 6} and len(got) == 61
