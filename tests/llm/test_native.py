"""Operators made of DataFrame functions only."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import brute
import pytest
from conftest import corpus
from pyspark.sql import functions as F

from mcqflow.llm import fingerprints, licenses, mixing, quality
from mcqflow.llm.common import table


def test_quality_measures(frame, odd, empty):
    docs = corpus(1)
    got = {r.doc_id: tuple(r)[1:7] for r in quality.judge(frame(docs)).collect()}
    assert got == {d: brute.quality(t) for d, t, _ in docs}
    for r, text in zip(quality.judge(odd.orderBy("text")).collect(), odd.orderBy("text").collect()):
        assert tuple(r)[1:7] == brute.quality(text.text)
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == quality.judge(odd).where("kept").count()


def test_quality_keeps_clean_documents(spark, folder):
    judged = quality.judge(table(spark, folder.replace("0.001", "0.01"), "documents"))
    labels = table(spark, folder.replace("0.001", "0.01"), "labels").where("quality = 1")
    clean = judged.join(labels, "doc_id").where("not base_failed")
    assert clean.where("not kept").count() <= 0.01 * clean.count()


def test_filters_do_not_repeat_the_measures(spark, folder):
    docs = table(spark, folder, "documents")
    for df in (quality.judge(docs), quality.judge(docs).where("kept"), quality.keep_good(docs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("xxhash64(slice(") == 1 and "monotonically" not in plan


@pytest.mark.parametrize("block, shard_blocks", [(16, 8), (512, 4096)])
def test_mix_reaches_its_targets(frame, block, shard_blocks):
    docs = corpus(2, 120) + [(1000, "x " * 300, None), (1001, None, "src2")]
    placed, mixed = mixing.mix(mixing.sized(frame(docs)), block=block, shard_blocks=shard_blocks)
    rows = mixing.taken_words(placed, mixed).collect()
    source = {d: s for d, _, s in docs}
    sizes, taken = Counter(), Counter()
    for d, t, s in docs:
        sizes[s] += len(brute.words(t))
    for r in rows:
        assert r.taken <= 3 * r.size and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    goal = brute.targets(sizes)
    for r in rows:
        assert math.isclose(r.target, goal[source[r.doc_id]], rel_tol=1e-9)
    assert len(rows) == len(docs) and all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    again = mixing.taken_words(*mixing.mix(mixing.sized(frame(docs[::-1])), block=block, shard_blocks=shard_blocks))
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in rows)
    per = mixed.groupBy("shard").agg(F.countDistinct("place").alias("n"), F.max("place").alias("last")).collect()
    assert all(r.n == r.last for r in per) and max(r.n for r in per) - min(r.n for r in per) <= 8


def test_hypergeometric_draws_are_exact(spark):
    N, K, n, steps = 40, 17, 12, 5000
    u = (F.col("id") + 0.5) / float(steps)
    drawn = spark.range(steps).select(mixing.hypergeometric(F.lit(N), F.lit(K), F.lit(n), u).alias("h")).groupBy("h").count()
    for r in drawn.collect():
        p = math.comb(K, r.h) * math.comb(N - K, n - r.h) / math.comb(N, n)
        assert abs(r["count"] / steps - p) <= 1 / steps


def test_mixed_documents_hold_what_is_taken(odd, empty, frame):
    docs = corpus(3, 60)
    want = {r.doc_id: r.taken for r in mixing.taken_words(*mixing.mix(mixing.sized(frame(docs)), block=16)).collect()}
    out = mixing.mix_documents(frame(docs), block=16)
    got, texts = Counter(), {d: t for d, t, _ in docs}
    for r in out.collect():
        got[r.doc_id] += len(brute.words(r.text))
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
    assert out.columns == frame(docs).columns and {d: n for d, n in want.items() if n} == dict(got)
    placed, mixed = mixing.mix(mixing.sized(odd))
    assert mixing.taken_words(placed, mixed).count() == 9
    assert mixing.mix_documents(odd).where("text is null or text = ''").count() == 0
    assert mixing.taken_words(*mixing.mix(mixing.sized(empty))).count() == 0


def test_fingerprints(frame, odd, empty):
    docs = corpus(4, 60)
    down = docs[::-1]
    rows = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(docs)).collect()}
    prints: dict[str, str] = {}
    for i, (d, text, _) in enumerate(down):
        following = down[(i + 1) % len(down)][1]
        r, new = rows[d], brute.edited(text, following)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(new, r.edited_fingerprint) == r.edited_fingerprint
        assert math.isclose(r.near_edited, brute.likeness(text, new)) and math.isclose(r.near_next, brute.likeness(text, following))
    assert fingerprints.fingerprint_edits(odd).count() == 9
    assert fingerprints.fingerprint_edits(empty).count() == 0
    one = fingerprints.fingerprint_edits(frame([(7, "abcdef", "s")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0


def test_near_equal_texts_are_alike_at_every_length(frame):
    """Around the lengths at which paragraphs were once cut otherwise; a line more or a word more at the start changes little."""
    r = random.Random(5)
    docs, pairs = [], []
    for size in (1000, 1020, 1030, 2040, 2050, 4090, 4100, 30_000):
        text = ""
        while len(text) < size:
            text += " ".join(r.choices(["lorem", "ipsum", "et", "dolore", "magna", f"n{r.randint(0, 99)}"], k=r.randint(4, 25))) + ". "
        text = text[: size - 2] + ".\n"
        for other in (text + "one line more here.\n", "Inserted word " + text):
            pairs.append((text, other))
            docs += [(2 * len(pairs) + 1, text, "s"), (2 * len(pairs), other, "s")]
    rows = {x.doc_id: x for x in fingerprints.fingerprint_edits(frame(docs)).collect()}
    for k, (text, other) in enumerate(pairs, 1):
        near = rows[2 * k + 1].near_next
        assert math.isclose(near, brute.likeness(text, other)) and near >= 0.5 and (near >= 0.8 or len(text) < 2000)


def test_sketches_tell_how_many_digests_differ(spark):
    sizes = [(0, 0, 0), (3, 3, 5), (0, 8, 2), (40, 30, 30), (200, 150, 100), (0, 500, 0)]
    data = [(list(range(a)) + list(range(1000, 1000 + c)), list(range(2000, 2000 + b)) + list(range(1000, 1000 + c)), a + b, c) for a, b, c in sizes]
    df = spark.createDataFrame(data, "a array<bigint>, b array<bigint>, d int, c int")
    for x in "ab":
        df = df.withColumn(x, F.transform(x, lambda v: F.xxhash64(v)))
    like = fingerprints.likeness(F.col("a"), F.col("b"), fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))
    for r in df.select("d", "c", like.alias("x")).collect():
        assert math.isclose(r.x, 1.0 if r.d + r.c == 0 else r.c / (r.c + r.d))


def test_licenses(frame, odd, empty):
    texts = [
        "Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\ny", "CC-BY-NC cc by nc cc by nc",
        "under the mit", "This work is licensed under the GNU General Public License, version 3.", "", None, "no license here",
        "licensed\nunder the gnu general public license version 3",
    ]
    rows = {r.doc_id: r for r in licenses.scan(frame([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [rows[i].base_labels for i in range(9)] == ["mit", "apache-2", "cc-by-nc", "", "", "", "", "", ""]
    assert [rows[i].labels for i in range(9)] == ["mit", "apache-2", "cc-by-nc", "", "gpl-3", "", "", "", "gpl-3"]
    assert [(rows[i].n_base, rows[i].first_word, rows[i].last_word) for i in range(4)] == [(1, 1, 1), (1, 4, 4), (3, 0, 6), (0, None, None)]
    assert licenses.scan(odd).count() == 9 and licenses.scan(empty).count() == 0


def test_wrapped_notices(frame):
    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
        "gpl-3": "This is free: licensed under the GNU General Public License, either version 3 of the License or later",
    }
    rows, want = [], {}
    for k, (label, text) in enumerate(notices.items()):
        words = text.split(" ")
        for width in (2, 5, 9, 30):
            lines = [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
            for before in (0, 13, 40, 500):
                i = len(rows)
                rows.append((i, "\n".join(["filler"] * before + lines + ["tail"] * 30), "s"))
                want[i] = label
    clean = ["a copy of software " * 40, "permission granted to use this copy\nof any charge", "the general public license of the version"]
    rows += [(1000 + i, t, "s") for i, t in enumerate(clean)]
    got = {r.doc_id: r for r in licenses.scan(frame(rows)).collect()}
    assert {i: got[i].labels for i in want} == want and all(got[i].score >= 0.9 for i in want)
    assert all(got[1000 + i].labels == "" and got[1000 + i].score == 0 for i in range(3))


def test_position_filter_rejects(spark):
    tokens = ["r1", "r2", "c1", "c2", "c3"]
    blocks = [["r1", "r2", "c1", "c2", "c3"], ["r2", "c1", "c2", "c3"], ["r2", "c1"], ["a", "b", "c", "r1"], []]
    df = spark.createDataFrame([(b,) for b in blocks], "b array<string>")
    assert [r[0] for r in df.select(licenses.containment(F.col("b"), tokens, 0.8)).collect()] == [1.0, 0.8, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("build", [quality.judge, licenses.scan, fingerprints.fingerprint_edits])
def test_no_python_in_the_plan(spark, folder, build):
    plan = build(table(spark, folder, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
