"""Column functions on edge rows with expectations worked out by hand."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mcqflow.functions.answers import answer_letter, is_correct, parse_letter
from mcqflow.functions.chat import CHATML, ChatTemplate
from mcqflow.functions.labels import argmax, first_supervised, has_supervision, mask_prompt, token_at
from mcqflow.functions.prompts import build_prompt, register_template, simple_exam
from mcqflow.functions.tokens import ByteCodec, attention_mask, cut_prompt, truncate

BYTES = ByteCodec()


def letters(column):
    return answer_letter(column, "null")


def test_answer_integers(values):
    assert values([0, 1, 2, 3, 4, -1, None], "int", letters) == ["A", "B", "C", "D", None, None, None]


def test_answer_strings(values):
    cases = {
        "B": "B", " C ": "C", "01": "B", "003": "D", "0": "A", "00": "A", " D ": "D", "\x1cA\n": "A",
        "\x85B": "B", "7": None, "a": None, "": None, "1.0": None, "-1": None, "0A": None, "AB": None, "4": None,
        "A B": None, "10": None, "²": None, "١": None,
    }
    assert values(list(cases), "string", letters) == list(cases.values())


@pytest.mark.parametrize("bad", ["7", "a", "", None])
def test_answer_raises(values, bad):
    with pytest.raises(PySparkException, match="unexpected answer"):
        values([bad], "string", answer_letter)


def test_answer_mode_is_checked():
    with pytest.raises(ValueError, match="on_invalid"):
        answer_letter(None, "skip")


def test_parse_letter(values):
    cases = {
        "A": "A", "b)": "B", " b": None, "": None, "Because": "B", "I think C.": "C", "\nC": "C", "A_": "A",
        "A1": "A", "A cat": "A", "x B": "B", "éA": None, "²A": None, "中A": None, "(D)": "D", "d": "D",
        "e": None, "CAB": "C", "xAx B": "B", "E. D": "D", "AB then D": "D",
    }
    assert values(list(cases), "string", parse_letter) == list(cases.values())
    assert values([None], "string", parse_letter) == [None]


def test_correct_is_never_null(spark):
    rows = spark.createDataFrame([(0, "A", "A"), (1, "B", "A"), (2, None, "A")], "i int, p string, g string")
    flags = rows.orderBy("i").select(is_correct(F.col("p"), F.col("g")).alias("f")).collect()
    assert [r.f for r in flags] == [True, False, False]


def exam(spark, subject, question, choices):
    row = spark.createDataFrame([(subject, question, choices)], "s string, q string, c array<string>")
    return row.select(simple_exam(F.col("s"), F.col("q"), F.col("c")).alias("p")).first().p


@pytest.mark.parametrize("subject", [None, ""])
def test_prompt_without_subject(spark, subject):
    text = exam(spark, subject, "Why?", ["w", "x", "y", "z"])
    assert text.split("\n") == [
        "You are taking a multiple-choice exam.",
        "Choose the correct answer.",
        "Respond with ONLY the letter: A, B, C, or D.",
        "Question: Why?",
        "Choices:",
        "A. w",
        "B. x",
        "C. y",
        "D. z",
    ]


def test_prompt_with_subject_blank_line_and_extra_choice(spark):
    text = exam(spark, "law", "One\n\ntwo?", ["w", "x", "y", "z", "extra"])
    assert "exam.\n" in text and text.endswith("\nD. z")
    assert "\nSubject: law\nQuestion: One\n\ntwo?\nChoices:\n" in text


def test_prompt_needs_four_choices(spark):
    with pytest.raises(PySparkException, match="fewer than four"):
        exam(spark, None, "Why?", ["w", "x", "y"])


def test_templates_by_name(spark):
    with pytest.raises(ValueError, match="unknown prompt template"):
        build_prompt("missing", F.lit(""), F.lit(""), F.lit(""))
    register_template("bare", lambda subject, question, choices: question)
    assert spark.range(1).select(build_prompt("bare", F.lit(""), F.lit("q"), F.array())).first()[0] == "q"


@pytest.mark.parametrize("thinking", [True, False])
def test_prompt_is_a_prefix_of_the_dialogue(spark, thinking):
    row = spark.range(1).select(
        CHATML.prompt(F.lit("hi"), thinking).alias("p"), CHATML.dialogue(F.lit("hi"), F.lit("A"), thinking).alias("d")
    ).first()
    assert row.d == row.p + "A<|im_end|>\n"
    assert ("<think>" in row.p) != thinking


def test_own_template(spark):
    plain = ChatTemplate("[", "] ", "\n", "bot", "me", "")
    assert spark.range(1).select(plain.prompt(F.lit("hi"))).first()[0] == "[me] hi\n[bot] "


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=8))
def test_bytes_round_trip(values, texts):
    ids = values(texts, "string", BYTES.encode)
    assert ids == [list(t.encode()) for t in texts]
    assert values(ids, "array<int>", BYTES.decode) == texts
    assert values(texts, "string", BYTES.count) == [len(i) for i in ids]


def test_bytes_truncation(values):
    texts = ["é中a", "", "abcdef", None]
    assert values(texts, "string", lambda t: BYTES.encode(t, 4)) == [
        list("é中".encode())[:4], [], list(b"abcd"), None,
    ]
    assert values(texts, "string", lambda t: BYTES.count(t, 4))[:3] == [4, 0, 4]
    assert values([list("é中".encode())[:4], [256, 65, 256]], "array<int>", BYTES.decode) == ["é�", "A"]


def test_pad_falls_back_to_end():
    assert ByteCodec().pad_id == 256 and ByteCodec(pad=300).pad_id == 300
    assert ByteCodec(pad=300).special_ids == (256, 300)


def test_array_cuts(values):
    rows = [[1, 2, 3, 4, 5], []]
    assert values(rows, "array<int>", lambda a: truncate(a, 2)) == [[1, 2], []]
    assert values(rows, "array<int>", attention_mask) == [[1] * 5, []]
    assert values(rows, "array<int>", lambda a: cut_prompt(a, F.lit(3))) == [[4, 5], []]
    assert values(rows, "array<int>", lambda a: cut_prompt(a, F.lit(9))) == [[], []]


@pytest.mark.parametrize(
    "plen,expected",
    [(0, [1, 2, 3, 4, 5]), (3, [-100] * 3 + [4, 5]), (5, [-100] * 5), (9, [-100] * 5)],
)
def test_mask_prompt(values, plen, expected):
    assert values([[1, 2, 3, 4, 5]], "array<int>", lambda a: mask_prompt(a, F.lit(plen))) == [expected]


def test_first_supervised(values):
    rows = [[-100, -100, 7, 8], [-100], [], [5]]
    assert values(rows, "array<int>", first_supervised) == [2, None, None, 0]
    assert values(rows, "array<int>", has_supervision) == [True, False, False, True]


def test_argmax(values):
    nan = float("nan")
    assert values([[1.0, 3.0, 3.0], [1.0, nan], [-5.0]], "array<double>", argmax) == [1, 1, 0]


def test_token_at(values):
    assert values([[7, 8]], "array<int>", lambda a: token_at(a, F.lit(1))) == [8]
    assert values([[7, 8]], "array<int>", lambda a: token_at(a, F.lit(-1))) == [None]
