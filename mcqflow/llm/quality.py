"""Quality rules: a threshold table compiled into one projection.

Words are runs of anything but ASCII white space. A null text is an empty one: it has
no words and fails. Rows are judged one by one, so repeated rows, ties and extra columns
change nothing; an empty table gives an empty table. Nothing is exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from mcqflow.llm.common import fresh, let, span, text_of, words_of

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

# Frequent short words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for with are be this by "
    "le la les de des et un une du que en est dans pour "
    "el los las y una del por con para se no su "
    "der die das und ein von den zu ist nicht mit auf für sich"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails where ``measure`` lies outside ``low`` .. ``high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


BASE_RULES = (
    Rule("few_words", "n_words", low=20),
    Rule("repeated_words", "repeat_percent", high=30),
)
# Wide bounds: text in any of the four languages stays, markup, tables and noise go.
RULES = (
    Rule("word_length", "mean_word_chars", low=2, high=15),
    Rule("symbols", "symbols_per_word", high=0.3),
    Rule("stop_words", "n_stop_words", low=2),  # different ones
    Rule("repeated_lines", "dup_lines_per_line", high=0.5),
)


def _repeat_words(windows: Column) -> Column:
    """Words covered by the windows whose hash occurs twice or more."""

    def covered(ranked: Column) -> Column:
        def repeated(e: Column, i: Column) -> Column:
            before, after = F.get(ranked, i - 1), F.get(ranked, i + 1)
            return F.coalesce(before["h"] == e["h"], F.lit(False)) | F.coalesce(
                after["h"] == e["h"], F.lit(False)
            )

        starts = F.sort_array(F.transform(F.filter(ranked, repeated), lambda e: e["p"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n"),
                (p + WINDOW).alias("end"),
            ),
            lambda a: a["n"],
        )

    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        let(ranked, covered)
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def measure(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """Add ``out``: a struct of the measures of each text.

    A generator of one row emits it. Filters and projections on a generator's output stay above
    it, so the measures are taken once a row, however many rules read them.
    """
    w, h = fresh([*docs.columns, out], "_words"), fresh([*docs.columns, out], "_windows")
    n = F.size(w)
    body = text_of(text)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windowed = docs.withColumn(w, words_of(text)).withColumn(
        h, F.transform(span(F.lit(1), n - WINDOW + 2), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    )
    stop = F.array(*[F.lit(x) for x in STOP_WORDS])
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(
            F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"),
        )).alias("lines"),
        _repeat_words(F.col(h)).cast("long").alias("n_repeat_words"),
        F.size(F.array_intersect(w, stop)).cast("long").alias("n_stop_words"),
    )

    def ratios(c: Column) -> Column:
        n = c["n_words"]
        return F.struct(
            n.alias("n_words"),
            c["word_chars"].alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            c["lines"]["dup"].cast("long").alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            c["n_stop_words"].alias("n_stop_words"),
            _ratio(100 * c["n_repeat_words"], n).alias("repeat_percent"),
            _ratio(c["word_chars"], n).alias("mean_word_chars"),
            _ratio(c["n_symbols"], n).alias("symbols_per_word"),
            _ratio(c["lines"]["dup"], c["lines"]["n"]).alias("dup_lines_per_line"),
        )

    return windowed.withColumn(out, F.explode(F.array(let(counts, ratios)))).drop(w, h)


def failed_rules(measures: Column, rules: Sequence[Rule]) -> Column:
    """Names of the rules that a document breaks, in table order."""

    def broken(rule: Rule) -> Column:
        value, bad = measures[rule.measure], F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        return F.when(bad, F.lit(rule.name))

    return F.array_compact(F.array(*[broken(r) for r in rules]))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the measures, ``base_failed``, ``kept`` and the broken rules of each row."""
    judged = measure(docs.select("doc_id", "text"), "_m").select(
        "doc_id",
        *[F.col(f"_m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (F.size(failed_rules(F.col("_m"), BASE_RULES)) > 0).alias("base_failed"),
        F.array_join(failed_rules(F.col("_m"), (*BASE_RULES, *rules)), ",").alias("failed"),
    )
    return judged.select(*judged.columns[:-1], (F.col("failed") == "").alias("kept"), "failed")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that break no rule, with all their columns."""
    out = fresh(docs.columns, "_measures")
    return (
        measure(docs, out).where(F.size(failed_rules(F.col(out), (*BASE_RULES, *rules))) == 0).select(*docs.columns)
    )
