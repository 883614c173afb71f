"""Question prompts: a registry of named templates built from column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The wording a scored model was trained and evaluated with.
EXAM_HEADER = (
    "You are taking a multiple-choice exam.\n"
    "Choose the correct answer.\n"
    "Respond with ONLY the letter: A, B, C, or D.\n"
)
SUBJECT_LABEL = "Subject: "
QUESTION_LABEL = "Question: "
CHOICES_LABEL = "Choices:"
OPTION_LABELS = ("A. ", "B. ", "C. ", "D. ")

PromptTemplate = Callable[[Column, Column, Column], Column]


def simple_exam(subject: Column, question: Column, choices: Column) -> Column:
    """Header, optional subject line, question, then the first four options.

    A null or empty subject drops its line. Fewer than four choices is an
    error. A null question or choice gives a null prompt: run the row contract
    first where that can happen.
    """
    subject_line = F.when(
        subject.isNotNull() & (subject != ""),
        F.concat(F.lit(SUBJECT_LABEL), subject, F.lit("\n")),
    ).otherwise("")
    parts = [F.lit(EXAM_HEADER), subject_line, F.lit(QUESTION_LABEL), question]
    parts.append(F.lit(f"\n{CHOICES_LABEL}"))
    for i, label in enumerate(OPTION_LABELS):
        parts += [F.lit(f"\n{label}"), F.get(choices, F.lit(i))]
    return F.when(F.size(choices) < len(OPTION_LABELS), F.raise_error(F.lit("fewer than four choices"))).otherwise(
        F.concat(*parts)
    )


_TEMPLATES: dict[str, PromptTemplate] = {"simple_exam": simple_exam}


def register_template(name: str, template: PromptTemplate) -> None:
    _TEMPLATES[name] = template


def build_prompt(template: str, subject: Column, question: Column, choices: Column) -> Column:
    """Prompt column of the named template; an unknown name fails while planning."""
    if template not in _TEMPLATES:
        raise ValueError(f"unknown prompt template {template!r}; known: {sorted(_TEMPLATES)}")
    return _TEMPLATES[template](subject, question, choices)
