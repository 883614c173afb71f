"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and three times for its median. Every row is
computed and discarded by Spark's ``noop`` sink.
"""

from __future__ import annotations

import functools
import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, functions as F  # noqa: E402

from mcqflow import fixtures as fx  # noqa: E402
from mcqflow.catalogue import queries as q  # noqa: E402
from mcqflow.functions.answers import parse_letter  # noqa: E402
from mcqflow.operators import accuracy, batching, dialogue, runs  # noqa: E402
from mcqflow.operators.subwords import SubwordCodec, train_merges  # noqa: E402
from mcqflow.operators.vocabulary import VocabularyCodec, encode_by_join  # noqa: E402
from mcqflow.plans import evaluate, prepare  # noqa: E402
from mcqflow.session import local_session  # noqa: E402
from mcqflow.sources.shared import shared_folder  # noqa: E402
from mcqflow.sources.sinks import write_prepared  # noqa: E402
from mcqflow.streaming import jobs  # noqa: E402

SPARK = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def questions() -> DataFrame:
    return fx.questions(SPARK, FOLDER)


def documents() -> DataFrame:
    return q.documents(SPARK, FOLDER)


@functools.cache
def vocabulary() -> DataFrame:
    """Built and stored by the warm-up run; encoding is timed on the stored table."""
    return q.stored_vocabulary(SPARK, FOLDER)


def vocabulary_codec() -> DataFrame:
    codec = VocabularyCodec.load(vocabulary())
    return documents().select("item_id", codec.encode(F.col("text")).alias("ids"))


def vocabulary_join() -> DataFrame:
    return encode_by_join(documents(), vocabulary(), "text", q.VOCABULARY_SIZE)


@functools.cache
def merges() -> DataFrame:
    """Trained on a tenth of the words, by the warm-up run; encoding is timed on the stored table."""
    some = documents().where(F.pmod("item_id", F.lit(10)) == 0)
    return write_prepared(train_merges(some, "text", q.MERGES), shared_folder(SPARK) + "/merges", partition_by=())


def subword_codec() -> DataFrame:
    codec = SubwordCodec.load(merges())
    return documents().select("item_id", codec.encode(F.col("text")).alias("ids"))


def manifest() -> DataFrame:
    return batching.training_manifest(documents(), 2, 2, 4, epochs=2)


def intervals_from_stream() -> DataFrame:
    steps = q._stream(SPARK, FOLDER, "events").select(
        F.col("event_type").alias("run"), F.col("value").alias("loss"), F.col("ts").cast("timestamp").alias("ts")
    )
    return q._snapshot(SPARK, jobs.running_loss(steps, "1 hour"))


# Name: the table its rows are counted from, and the job.
HEADLINES = {
    "prompts": ("part", lambda: prepare.eval_prompts(questions())),
    "sft_rows": ("part", lambda: prepare.prepare_sft(questions(), q.BYTES)),
    "parse_letters": (
        "part",
        lambda: fx.outputs(SPARK, FOLDER).select("item_id", parse_letter(F.col("output_text")).alias("pred")),
    ),
    "stored_outputs_by_subject": (
        "part",
        lambda: evaluate.evaluate_outputs(questions(), fx.outputs(SPARK, FOLDER, "tuned")).subjects,
    ),
    "generated_by_subject": ("part", lambda: evaluate.evaluate_generated(questions(), fx.text_model()).subjects),
    "first_token_exact_batches": (
        "part",
        lambda: evaluate.evaluate_first_token_batched(questions(), fx.first_token_model(), q.BYTES).subjects,
    ),
    "first_token_by_subject": (
        "part",
        lambda: evaluate.evaluate_first_token(questions(), fx.first_token_model(), q.BYTES).subjects,
    ),
    "compare_runs": ("part", lambda: accuracy.compare_runs(q.scored(SPARK, FOLDER), "base", "tuned")),
    "render_dialogues": ("conversations", lambda: dialogue.render_dialogues(fx.messages(SPARK, FOLDER))),
    "assistant_mask": (
        "conversations",
        lambda: dialogue.supervise_dialogues(fx.messages(SPARK, FOLDER), q.BYTES),
    ),
    "byte_codec": ("documents", lambda: documents().select("item_id", q.BYTES.encode(F.col("text")))),
    "build_vocabulary": ("documents", lambda: q.vocabulary(SPARK, FOLDER)),
    "vocabulary_codec": ("documents", vocabulary_codec),
    "vocabulary_join": ("documents", vocabulary_join),
    "subword_codec": ("documents", subword_codec),
    "training_batches_computed": (
        "part",
        lambda: prepare.training_batches(questions(), q.BYTES, 8, order="computed"),
    ),
    "training_batches": ("part", lambda: prepare.training_batches(questions(), q.BYTES, 8)),
    "manifest": ("documents", manifest),
    "vector_first_token": ("embeddings", lambda: accuracy.first_token_metric(q._vectors(SPARK, FOLDER))),
    "mean_loss": ("events", lambda: runs.mean_loss(fx.step_log(SPARK, FOLDER))),
    "loss_per_interval": ("events", lambda: runs.interval_loss(fx.step_log(SPARK, FOLDER))),
    "kept_checkpoints": ("events", lambda: runs.kept_checkpoints(fx.checkpoints(SPARK, FOLDER))),
    "streamed_loss": ("events", intervals_from_stream),
}
REPEATS = 3


def main() -> None:
    seconds: dict[str, float] = {}
    rates: dict[str, int] = {}
    for name in sys.argv[1:] or HEADLINES:
        table, job = HEADLINES[name]
        times = []
        for _ in range(REPEATS + 1):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 4)
        rates[name] = int(fx.table(SPARK, FOLDER, table).count() / seconds[name])
        print(name, seconds[name], rates[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total median seconds of the headline queries",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    SPARK.stop()


if __name__ == "__main__":
    main()
