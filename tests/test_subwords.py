"""Trained merges and the subword codec against plain versions."""

from __future__ import annotations

import collections
import random

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from mcqflow.functions.tokens import ByteCodec
from mcqflow.operators import subwords
from mcqflow.operators.subwords import SubwordCodec, train_merges
from mcqflow.plans.prepare import prepare_sft

PIECE = regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\x09-\x0D\x20\p{L}\p{N}]+|[\x09-\x0D\x20]+")


def plain_merges(texts, merges, min_count=2):
    """One merge at a time, all pairs counted anew for each."""
    counts = collections.Counter(p for t in texts if t for p in PIECE.findall(t))
    words, out = [(list(w.encode()), n) for w, n in counts.items()], []
    for k in range(merges):
        pairs = collections.Counter()
        for w, n in words:
            for pair in zip(w, w[1:]):
                pairs[pair] += n
        best = min(pairs, key=lambda p: (-pairs[p], max(p), p), default=None)
        if best is None or pairs[best] < min_count:
            break
        out.append((k, *best, 256 + k, pairs[best]))
        for w, _ in words:
            i = 0
            while i < len(w) - 1:
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = [256 + k]
                i += 1
    return out


def plain_ids(text, merges):
    """The pair of least rank, leftmost first, until none is left."""
    rank, out = {m[1:3]: m[0] for m in merges}, []
    for piece in PIECE.findall(text):
        w = list(piece.encode())
        while True:
            best = min((rank[p] for p in zip(w, w[1:]) if p in rank), default=None)
            if best is None:
                break
            i = 0
            while i < len(w) - 1:
                if rank.get((w[i], w[i + 1])) == best:
                    w[i : i + 2] = [256 + best]
                i += 1
        out += w
    return out


def texts_of(seed):
    r = random.Random(seed)
    known = ["the", "then", "them", "été", "aaaa", "aaaaaaa", "abab", "ababab", "日本語", "x1", "\n\n", "  ", " ", "--", "'s", "\x00\x1f", "😀"]
    return [None, "", " ", *("".join(r.choices([*known, " "], k=r.randint(1, 40))) for _ in range(40)), "z" * 3000]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(texts_of(1))), "item_id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def trained(corpus):
    return train_merges(corpus, "text", 60).cache()


def test_merges_are_those_of_one_at_a_time(trained):
    assert [tuple(r) for r in trained.orderBy("rank").collect()] == plain_merges(texts_of(1), 60)


@pytest.mark.parametrize("rewrite, candidates", [(1, 1), (3, 2)])
def test_rounds_do_not_change_the_merges(corpus, monkeypatch, rewrite, candidates):
    monkeypatch.setattr(subwords, "REWRITE", rewrite)
    monkeypatch.setattr(subwords, "CANDIDATES", candidates)
    got = train_merges(corpus, "text", 12)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == plain_merges(texts_of(1), 12)


def test_training_ends_where_no_pair_is_frequent(spark):
    df = spark.createDataFrame([("ab ab cd",), (None,), ("",)], "text string")
    assert [tuple(r) for r in train_merges(df, "text", 100).collect()] == plain_merges(["ab ab cd"], 100)
    assert train_merges(df.limit(0), "text", 5).count() == 0
    assert train_merges(df, "text", 5, min_count=3).count() == 0


def test_ids_and_round_trip(spark, trained):
    codec = SubwordCodec.load(trained)
    merges = [tuple(r) for r in trained.orderBy("rank").collect()]
    texts = [t for t in texts_of(2) if t is not None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
    ids = codec.encode(F.col("text"))
    rows = df.select("i", ids.alias("ids"), codec.decode(ids).alias("back"), codec.encode(F.col("text"), 7).alias("cut"), codec.count(F.col("text"), 7).alias("n")).collect()
    for r in rows:
        want = plain_ids(texts[r.i], merges)
        assert r.ids == want and r.back == texts[r.i] and r.cut == want[:7] and r.n == len(want[:7])
    assert any(max(r.ids, default=0) > 300 for r in rows)
    missing = spark.createDataFrame([(None,)], "text string")
    assert missing.select(codec.encode(F.col("text"))).first()[0] is None


def test_special_ids_are_left_out(spark, trained):
    codec = SubwordCodec.load(trained, pad=9)
    assert codec.special_ids == (9, codec.eos_id) and codec.eos_id == 256 + trained.count()
    df = spark.createDataFrame([([104, codec.eos_id, 105, 9],)], "ids array<int>")
    assert df.select(codec.decode(F.col("ids"))).first()[0] == "hi"


def test_symbols_step_over_the_gap():
    ids = [0, 255, 256, 0xD7FF, 0xD800, 0xFFFF, 70_000]
    assert [subwords.symbol_id(subwords.symbol(i)) for i in ids] == ids
    "".join(map(subwords.symbol, ids)).encode()


def test_bad_tables_are_refused(spark):
    schema = "rank int, left_id int, right_id int"
    for rows in ([(1, 97, 98)], [(0, 97, 256)], [(0, 97, 98), (1, 97, 98)], [(0, -1, 98)]):
        with pytest.raises(ValueError):
            SubwordCodec.load(spark.createDataFrame(rows, schema))
    with pytest.raises(ValueError):
        SubwordCodec.load(spark.createDataFrame([(i, 97, 98) for i in range(3)], schema), max_merges=2)
    none = SubwordCodec.load(spark.createDataFrame([], schema))
    df = spark.createDataFrame([("hé",)], "t string")
    assert df.select(none.encode(F.col("t"))).first()[0] == list("hé".encode())


def test_codec_prepares_rows(spark, trained, folder):
    from mcqflow import fixtures as fx

    codec = SubwordCodec.load(trained)
    rows = prepare_sft(fx.questions(spark, folder), codec, flag_mismatch=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # that of the fixture
    r = rows.orderBy("item_id").first()
    first = next(i for i, x in enumerate(r.labels) if x != -100)
    assert r.labels[first:] == r.input_ids[first:] and not r.prefix_mismatch


def test_training_reads_the_corpus_once(spark, corpus, monkeypatch):
    seen = []
    monkeypatch.setattr(subwords, "word_counts", lambda df, *a: seen.append(1) or df.select(F.lit("abab").alias("word"), F.lit(3).cast("bigint").alias("n")).limit(1))
    assert train_merges(corpus, "text", 4).count() == 2 and seen == [1]


def test_a_batch_is_merged_in_bounded_slices():
    """By pieces and by bytes; a row that is larger alone. Nulls and offsets of a slice stay right."""
    run = subwords._encoder(((97, 98),))
    lists = [[], None, *[["ab", "b"] * 500] * 300, None, *[["a" * 300_000]] * 6, ["ab" * 1_000_000], []]
    batch = pa.array([["skipped"], *lists], pa.list_(pa.string())).slice(1)
    made = list(run(iter([batch, batch.slice(0, 0), batch.slice(2, 1)])))
    assert len(made) >= 7
    assert all(len(m) == 1 or len(m.flatten()) <= 1 << 20 for m in made)
    want = [None if x is None else [i for p in x for i in ([256] * (len(p) // 2) if p[:2] == "ab" else p.encode())] for x in lists]
    assert [x for m in made for x in m.to_pylist()] == [*want, want[2]]


def test_rows_are_checked_where_they_are_spread(spark, folder):
    """The one scan task of a small file only reads it."""
    from mcqflow import fixtures as fx

    rows = prepare_sft(fx.questions(spark, folder), ByteCodec())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Filter CASE" in plan.split("Exchange")[0]
    assert "Filter CASE" not in plan.split("Exchange")[1]


def test_only_words_with_a_pairs_symbols_are_merged(spark, monkeypatch):
    """Words that cannot hold a pair are left out before the merges they lack are applied."""
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda w: seen.add(1) or w)
    plain = subwords.merged
    monkeypatch.setattr(subwords, "merged", lambda word, merges: plain(count(word), merges) if merges else word)
    texts = ["abab"] * 9 + ["cd"] * 5 + [f"{a}{b}" for a in "uvwxyz" for b in "uvwxyz"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = train_merges(df, "text", 3, min_count=4)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == plain_merges(texts, 3, 4)
    assert 0 < seen.value < 30  # of 38 words


def test_symbols_are_spelled_as_they_stood():
    merges = [("ab", "Ā"), ("Āc", "ā"), ("āā", "Ă")]
    assert subwords.spelled("Ăx", merges) == "abcabcx" and subwords.spelled("Ăx", []) == "Ăx"


def test_counts_leave_python_as_numbers(spark, trained):
    codec = SubwordCodec.load(trained)
    df = spark.createDataFrame(list(enumerate(texts_of(3))), "i int, text string").repartition(2)
    counts = df.select("i", "text", codec.count(F.col("text")).alias("n"), codec.count(F.col("text"), 7).alias("cut"))
    assert "array<int>" not in counts.select("n")._jdf.queryExecution().analyzed().toString()
    assert "size(" not in counts.select("n")._jdf.queryExecution().analyzed().toString()
    merges = [tuple(r) for r in trained.orderBy("rank").collect()]
    for r in counts.collect():
        want = None if r.text is None else len(plain_ids(r.text, merges))
        assert r.n == want and r.cut == (None if want is None else min(want, 7))


def test_pieces_are_those_of_the_plain_pattern():
    new, r = regex.compile(subwords.SUBWORD_PIECE), random.Random(5)
    for _ in range(5000):
        text = "".join(r.choices(" \t\n 　ab1é,.²́\x00\U0001f600", k=r.randint(0, 12)))
        assert new.findall(text) == PIECE.findall(text)


def test_digest_is_that_of_the_ids_joined_by_blanks(spark):
    from hashlib import md5

    from mcqflow.catalogue.queries import digest

    df = spark.createDataFrame([([1, -100, 22],), ([7],), ([],), (None,)], "ids array<int>")
    assert "array<string>" not in df.select(*digest("ids"))._jdf.queryExecution().analyzed().toString()
    for ids, r in zip([[1, -100, 22], [7], []], df.select(*digest("ids")).collect()):
        assert tuple(r) == (len(ids), sum(ids), md5(" ".join(map(str, ids)).encode()).hexdigest())
    assert df.where("ids is null").select(*digest("ids")).first().ids_md5 is None
