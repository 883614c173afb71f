"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are the lines, and windows of ``WINDOW`` words that start every ``STRIDE`` words of
the whole text, so that a wording of up to ``WINDOW - STRIDE`` words lies in some window
however it is wrapped; more words in a template are refused. A block's tokens are its distinct words. A template matches a block that
holds at least ``threshold`` of the template's tokens. Tokens are ordered by how often
they occur in the whole corpus, rarest first; of a block, those that some template has are
kept, in that order. A block can only match if

* prefix: it holds one of the template's first ``n - needed + 1`` tokens,
* length: it has at least ``needed`` tokens,
* position: from the first shared token on, enough tokens are left in the template and in
  the block.

What passes is verified by intersection. Templates are a fixed small table, so they are
constants of one projection: the blocks are not exchanged, and no block is dropped.

A null text is empty. Empty texts have no words, no labels and score 0. Rows are judged
one by one; repeated rows give repeated results, extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mcqflow.llm.common import ascii_lower, let, text_of

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose words must stand consecutively, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wordings of common licenses, and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2": "apache-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution license": "cc-by",
    "licensed under a creative commons attribution sharealike license": "cc-by-sa",
    "licensed under a creative commons attribution noncommercial license": "cc-by-nc",
    "to the extent possible under law the author has waived all copyright": "cc0",
}
THRESHOLD = 0.9
WINDOW, STRIDE = 48, 24


def license_words(lowered: Column) -> Column:
    """Words of a text that is in lower case."""
    return F.array_remove(F.split(lowered, WORD_BREAK), "")


def token_ranks(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> dict[str, int]:
    """Position of each template token by its count in all texts, rarest first.

    Every word is counted; the result has a row per template token, so its size is bounded
    by the template table.
    """
    tokens = sorted({t for text in templates for t in text.split()})
    known = docs.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    seen = docs.select(F.explode(license_words(ascii_lower(text_of("text")))).alias("token"))
    rows = seen.join(F.broadcast(known), "token").groupBy("token").count().collect()
    counts = {r["token"]: r["count"] for r in rows}
    return {t: i for i, t in enumerate(sorted(tokens, key=lambda t: (counts.get(t, 0), t)))}


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def containment(block: Column, tokens: Sequence[str], threshold: float) -> Column:
    """Share of the ``tokens`` (rarest first) in the block, which is in the same order, if it reaches the
    threshold, else 0."""
    n = len(tokens)
    needed = math.ceil(round(threshold * n, 9))
    prefix = n - needed + 1

    def left(i: int) -> Column:
        """Tokens that can be shared if prefix token i is the first shared one; null if it isn't there."""
        at = F.array_position(block, tokens[i])
        return F.when(at > 0, F.least(F.lit(n - i).cast("bigint"), F.size(block) - at + 1))

    passes = (F.size(block) >= needed) & (F.coalesce(*map(left, range(prefix))) >= needed)
    shared = F.size(F.array_intersect(block, _strings(tokens)))
    verified = F.when(shared >= needed, shared / n).otherwise(F.lit(0.0))
    return F.when(passes, verified).otherwise(F.lit(0.0))


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
    phrases: Mapping[str, str] = PHRASES,
) -> DataFrame:
    """Phrase places, labels and the best containment of each document."""
    if any(len(text.split()) > WINDOW - STRIDE for text in templates):
        raise ValueError(f"a template has at most {WINDOW - STRIDE} words")
    ranks = token_ranks(docs, templates)
    known = sorted(ranks, key=ranks.__getitem__)
    ordered = {text: sorted(set(text.split()), key=ranks.__getitem__) for text in templates}
    prefixes = sorted(
        {t for ts in ordered.values() for t in ts[: len(ts) - math.ceil(round(threshold * len(ts), 9)) + 1]}
    )
    low, words = "_low", "_words"
    read = docs.select("doc_id", ascii_lower(text_of("text")).alias(low)).withColumn(
        words, license_words(F.col(low))
    )

    def share(blocks: Column, tokens: Sequence[str]) -> Column:
        return F.coalesce(F.array_max(F.transform(blocks, lambda b: containment(b, tokens, threshold))), F.lit(0.0))

    def matched(blocks: Column) -> Column:
        return F.array(
            *[
                F.struct(F.lit(label).alias("label"), share(blocks, ordered[text]).alias("share"))
                for text, label in templates.items()
            ]
        )

    def candidates(text: Column, every: Column) -> Column:
        lines = F.transform(F.split(text, "\n"), license_words)
        starts = F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), F.lit(STRIDE))
        blocks = F.concat(lines, F.transform(starts, lambda i: F.slice(every, i, WINDOW)))
        near = F.filter(blocks, lambda b: F.arrays_overlap(b, _strings(prefixes)))
        # The known tokens of a block, rarest first.
        return F.array_distinct(F.transform(near, lambda b: F.array_intersect(_strings(known), b)))

    none = F.array().cast("array<struct<label:string,share:double>>")
    hits = F.when(F.arrays_overlap(words, _strings(prefixes)), let(candidates(F.col(low), F.col(words)), matched)).otherwise(none)

    # One space on both sides of every word: a phrase is a substring at word ends.
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    body = {p: f"(?<= ){p}(?= )" for p in phrases}
    any_phrase = "(?:" + "|".join(phrases) + ")"
    has_any = F.lit(False)
    for p in phrases:
        has_any = has_any | F.contains(F.col("_joined"), F.lit(f" {p} "))

    def spaces(before: Column) -> Column:
        return (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).cast("long")

    first_part = F.regexp_extract("_joined", rf"(?s)^(.*? ){any_phrase} ", 1)
    last_part = F.regexp_extract("_joined", rf"(?s)^(.* ){any_phrase} ", 1)
    found = read.select("doc_id", F.col(words), hits.alias("_hits"), joined.alias("_joined")).select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        "_hits",
        F.when(
            has_any,
            F.struct(
                *[F.regexp_count("_joined", F.lit(r)).cast("long").alias(f"n{i}") for i, r in enumerate(body.values())],
                (spaces(first_part) - 1).alias("first"),
                (spaces(last_part) - 1).alias("last"),
            ),
        ).alias("_base"),
    )
    n_base = sum((F.coalesce(F.col(f"_base.n{i}"), F.lit(0)) for i in range(len(body))), F.lit(0).cast("long"))
    labels = F.array_compact(
        F.array(*[F.when(F.col(f"_base.n{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())])
    )
    own = F.transform(F.filter("_hits", lambda h: h["share"] > 0), lambda h: h["label"])
    best = F.coalesce(F.array_max(F.transform("_hits", lambda h: h["share"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.col("_base.first").alias("first_word"),
        F.col("_base.last").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(labels, own))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
