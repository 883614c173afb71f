"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents, in hashed order, form one stream of words, cut into blocks. The words
a source gives are whole passes over its blocks and, for the rest, blocks in a permuted
order. So each source has an exact quota of blocks. A binary tree deals the quotas out to
the output shards: at each node the left half's share of every source is a draw from the
multivariate hypergeometric distribution, so that all shards have one size and each is a
random sample of the whole mix. Shard by shard the tree's leaves name slots of each source,
the slots name disjoint blocks, and a shard shuffles its own blocks.

Sources are ordered by code point, null last, and weigh 1, 2, 3, 1, 2, 3, ... A null text
has no words and is never taken; an empty table gives an empty mix. Repeated rows are
documents of their own. Draws depend on hashes of ids and the seed only, so reruns agree.
Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mcqflow.llm.common import checkpointed, let, span, text_of, words_of

BLOCK_WORDS = 512
SHARD_BLOCKS = 4096
BUCKET_WORDS = 1 << 20  # of a source's stream, ordered by one task
BUCKET_ROWS = 1 << 14
MOST = 3  # times its size that a source may give
SEED = 17
# A table of sources of at most so many bytes is broadcast; a larger one is exchanged.
BROADCAST_BYTES = 8 << 20

# Primes for permutations i -> a * i + c modulo a number of blocks.
PRIMES = (2654435761, 2246822519, 3266489917, 668265263)


def sized(docs: DataFrame) -> DataFrame:
    """The narrow table that the mix is planned on: a row per document, without its text."""
    return docs.select(
        "doc_id",
        "source",
        F.size(words_of("text")).cast("long").alias("size"),
        F.xxhash64(text_of("text")).alias("digest"),
    )


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank``: the position of each source by code point, null last."""
    parts = sources.repartitionByRange(
        int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.asc_nulls_last("source")
    )
    parts = checkpointed(parts.withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    here = F.row_number().over(W.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    return parts.join(offsets, "part").withColumn("rank", F.col("offset") + here).drop("part", "offset")


def source_targets(rows: DataFrame) -> DataFrame:
    """source, rank, source_size, target and number of rows of each source."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    weighed = checkpointed(_ranked(checkpointed(sources)).withColumn("weight", F.pmod("rank", F.lit(3)) + 1))
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # A source is capped where a share by weight would be above its cap. What it leaves
    # raises the share of the others, until no more of them is capped.
    share = -1.0
    cap = MOST * F.col("source_size")
    while True:
        free = cap >= share * F.col("weight")
        rest, weight = weighed.agg(
            F.coalesce(F.sum(F.when(~free, cap)), F.lit(0)), F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0))
        ).first()
        new = (total - rest) / weight if weight else share
        if new <= share:
            break
        share = new
    target = F.least(cap.cast("double"), F.lit(max(share, 0.0)) * F.col("weight"))
    return weighed.select("source", "rank", "source_size", "n_rows", target.alias("target"))


def _quotas(sources: DataFrame, block: int) -> DataFrame:
    """Whole passes, and blocks and words of the last, partial pass."""
    size, give = F.col("source_size"), F.floor("target").cast("long")
    passes = F.when(size > 0, F.floor(give / size)).otherwise(0).cast("long")
    part = give - F.col("passes") * size
    q = sources.withColumn("passes", passes).withColumn("full", F.floor(size / block).cast("long"))
    q = q.withColumn("blocks", F.ceil(size / block).cast("long"))
    q = q.withColumn("part_blocks", F.floor(part / block).cast("long"))
    q = q.withColumn("part_words", part - F.col("part_blocks") * block)
    return q.withColumn(
        "quota", F.col("passes") * F.col("blocks") + F.col("part_blocks") + (F.col("part_words") > 0).cast("long")
    )


def _log_factorial(x: Column) -> Column:
    """ln x!, exact to rounding: a table below 20, Stirling's series above."""
    n = x.cast("double")
    series = (
        (n + 0.5) * F.ln(n) - n + 0.5 * math.log(2 * math.pi) + 1 / (12 * n) - 1 / (360 * n * n * n)
        + 1 / (1260 * n * n * n * n * n)
    )
    return F.when(x < 20, F.ln(F.factorial(x.cast("int")).cast("double"))).otherwise(series)


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many marked ones are among the draws, by inversion at the uniform number ``u``.

    Starts at the most likely number and goes outwards to both sides, ten standard deviations.
    """
    def draw(c: Column) -> Column:
        N, K, n = c["all"], c["hit"], c["cut"]
        low, high = F.greatest(F.lit(0).cast("long"), n + K - N), F.least(n, K)

        def from_mode(m: Column) -> Column:
            log_p = (
                _log_factorial(K) - _log_factorial(m) - _log_factorial(K - m)
                + _log_factorial(N - K) - _log_factorial(n - m) - _log_factorial(N - K - n + m)
                - _log_factorial(N) + _log_factorial(n) + _log_factorial(N - n)
            )
            deviation = F.sqrt(n.cast("double") * (K / N) * (1 - K / N)) * F.sqrt((N - n) / F.greatest(N - 1, F.lit(1)))
            steps = F.least(F.ceil(10 * deviation) + 10, high - low + 1)
            p = F.exp(log_p)
            start = F.struct(
                p.alias("sum"), m.alias("found"), (p >= u).alias("done"),
                m.alias("up"), p.alias("pu"), m.alias("down"), p.alias("pd"),
            )

            def step(s: Column, _: Column) -> Column:
                up, down = s["up"].cast("double"), s["down"].cast("double")
                pu = F.when(s["up"] >= high, F.lit(0.0)).otherwise(
                    s["pu"] * (K - up) * (n - up) / ((up + 1) * (N - K - n + up + 1))
                )
                pd = F.when(s["down"] <= low, F.lit(0.0)).otherwise(
                    s["pd"] * down * (N - K - n + down) / ((K - down + 1) * (n - down + 1))
                )

                def chosen(q: Column) -> Column:
                    first = s["sum"] + q["pu"]
                    second = first + q["pd"]
                    return F.struct(
                        second.alias("sum"),
                        F.when((first >= u) & (q["pu"] > 0), s["up"] + 1)
                        .when((second >= u) & (q["pd"] > 0), s["down"] - 1)
                        .otherwise(s["found"]).alias("found"),
                        (second >= u).alias("done"),
                        (s["up"] + 1).alias("up"), q["pu"].alias("pu"),
                        (s["down"] - 1).alias("down"), q["pd"].alias("pd"),
                    )

                return F.when(s["done"], s).otherwise(let(F.struct(pu.alias("pu"), pd.alias("pd")), chosen))

            return F.aggregate(span(F.lit(0), steps), start, step, lambda s: s["found"])

        mode = F.floor((n + 1) * ((K + 1) / (N + 2))).cast("long")
        inside = F.least(F.greatest(mode, low), high)
        return F.when(low == high, low).otherwise(let(inside, from_mode))

    return let(
        F.struct(population.cast("long").alias("all"), marked.cast("long").alias("hit"), draws.cast("long").alias("cut")), draw
    )


def _left_half(node: Column, quotas: Column, seed: int) -> Column:
    """The left child's quotas: a multivariate hypergeometric draw, source by source."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    none = F.array().cast("array<bigint>")

    def take(s: Column, q: Column) -> Column:
        u = (F.pmod(F.xxhash64(F.lit(seed), node, F.size(s["taken"])), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return let(
            hypergeometric(s["rest"], q, s["room"], u),
            lambda h: F.struct(
                F.array_append(s["taken"], h).alias("taken"), (s["rest"] - q).alias("rest"), (s["room"] - h).alias("room")
            ),
        )

    return let(
        total,
        lambda t: F.aggregate(
            quotas,
            F.struct(none.alias("taken"), t.alias("rest"), F.floor(t / 2).cast("long").alias("room")),
            take,
            lambda s: s["taken"],
        ),
    )


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """shard and its quota of every source, in the order of ``rank``; ``shards`` is a power of two."""
    whole = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("q"))
    nodes = whole.select(F.lit(0).cast("long").alias("node"), F.transform("q", lambda x: x["quota"]).alias("quotas"))
    level, parallel = 1, int(quotas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while level < shards:
        salt = seed + level
        split = nodes.withColumn("left", _left_half(F.col("node"), F.col("quotas"), salt))
        right = F.zip_with("quotas", "left", lambda a, b: a - b)
        children = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("quotas")),
            F.struct((2 * F.col("node") + 1).alias("node"), right.alias("quotas")),
        )
        nodes = split.select(F.inline(children))
        level *= 2
        if level in (8, 64, 512, 4096, 32768):
            nodes = checkpointed(nodes.repartition(min(level, parallel), "node"))
    return nodes.select(F.col("node").alias("shard"), F.posexplode("quotas").alias("rank", "quota"))


def _draws(quotas: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """A row for each block that a shard takes: rank, block, words taken of it, shard and place."""
    before = W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    slots = leaves.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0))).where("quota > 0")
    slots = slots.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)))
    facts = quotas.select("rank", "passes", "blocks", "full", "part_blocks", "part_words")
    rows = slots.select("rank", "shard", "slot").join(facts, "rank")
    taken = rows.withColumn("pass", F.floor(F.col("slot") / F.col("blocks"))).withColumn(
        "i", F.col("slot") - F.col("pass") * F.col("blocks")
    )
    step = F.coalesce(*[F.when(F.col("full") % p != 0, F.lit(p)) for p in PRIMES], F.lit(1))
    shift = F.pmod(F.xxhash64(F.lit(seed), "rank", "pass"), F.lit(1 << 30))
    permuted = F.when(
        F.col("i") < F.col("full"), F.pmod(F.pmod(step, F.col("full")) * F.col("i") + shift, F.col("full"))
    ).otherwise(F.col("i"))
    partial = (F.col("pass") == F.col("passes")) & (F.col("i") == F.col("part_blocks"))
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "rank", "slot"), "rank", "slot")
    return taken.select(
        "rank",
        permuted.alias("block"),
        "pass",
        F.when(partial, F.col("part_words")).alias("words"),
        "shard",
        F.row_number().over(order).alias("place"),
    )


def mix(
    rows: DataFrame, block: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """The documents of ``sized`` with their number ``row`` and target, and the mix: for each
    shard and place the run of words (row, pass, start, words) that stands there."""
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    sources = source_targets(rows)
    quotas = checkpointed(_quotas(sources, block))
    total, n_bytes = quotas.agg(
        F.coalesce(F.sum("quota"), F.lit(0)), F.coalesce(F.sum(F.coalesce(F.length("source"), F.lit(0)) + 100), F.lit(0))
    ).first()
    small = n_bytes <= BROADCAST_BYTES
    facts = quotas.select(F.col("source").alias("_source"), "rank", "source_size", "n_rows", "target")
    joined = rows.join(
        F.broadcast(facts) if small else facts, F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")

    # Words of each document in its source's stream. One task orders one bucket of it.
    buckets = F.greatest(
        F.lit(1), F.ceil(F.col("source_size") / BUCKET_WORDS), F.ceil(F.col("n_rows") / BUCKET_ROWS)
    )
    keyed = joined.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "digest"), buckets))
    here = W.partitionBy("rank", "bucket").orderBy(
        F.xxhash64(F.lit(seed + 2), "doc_id", "digest"), "doc_id", "digest", "row"
    )
    inside = F.coalesce(F.sum("size").over(here.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = keyed.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    earlier = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("rank", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = keyed.withColumn("inside", inside).join(offsets, ["rank", "bucket"])
    start = (F.col("offset") + F.col("inside")).alias("start")
    docs = checkpointed(placed.select("row", "doc_id", "source", "digest", "size", "source_size", "target", "rank", start))

    shards = 1 << max(0, math.ceil(math.log2(max(1, total / shard_blocks))))
    leaves = checkpointed(splitting_tree(quotas, shards, seed))
    draws = _draws(quotas, leaves, seed)
    blocks = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    pieces = docs.where("size > 0").select("row", "rank", "start", "size", F.explode(blocks).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(
        F.col("start") + F.col("size"), F.col("block") * block + F.coalesce(F.col("words"), F.lit(block))
    )
    mixed = (
        pieces.join(draws, ["rank", "block"])
        .withColumn("n", high - low)
        .where("n > 0")
        .select("shard", "place", "row", "pass", (low - F.col("start")).alias("start"), F.col("n").alias("words"))
    )
    return docs, mixed


def taken_words(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words of the document in the mix."""
    taken = mixed.groupBy("row").agg(F.sum("words").alias("taken"))
    return docs.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).alias("taken")
    )


def mix_documents(docs: DataFrame, **options: int) -> DataFrame:
    """The mix as documents: a row for each run of words that a pass takes of a document.

    A document taken whole keeps its text; a run is cut at word ends. ``n_chars`` is that of
    the new text, other columns are those of the document.
    """
    columns = docs.columns
    keys = ["doc_id", "digest"]
    # Rows with one id and text are told apart by their order among themselves.
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*[c for c in columns if c not in ("doc_id", "text")]))
    narrow = sized(docs)
    placed, mixed = mix(narrow, **options)
    runs = (
        mixed.groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct("start", "words"))).alias("parts"))
        .select("row", "pass", F.explode(_merged(F.col("parts"))).alias("run"))
        .groupBy("row").agg(F.collect_list(F.struct("pass", "run.start", "run.words")).alias("runs"))
    )
    again = F.row_number().over(W.partitionBy(*keys).orderBy("row"))
    wanted = placed.join(runs, "row").select(*keys, "size", "runs", "row")
    wanted = placed.select(*keys, "row").withColumn("nth", again).join(wanted.drop(*keys), "row").drop("row")
    texts = docs.withColumn("digest", F.xxhash64(text_of("text"))).withColumn("nth", nth)
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.digest") == F.col("w.digest")) & (F.col("d.nth") == F.col("w.nth"))
    rows = texts.alias("d").join(wanted.alias("w"), same).select(
        *[F.col(f"d.{c}") for c in columns if c not in ("text", "n_chars")],
        F.col("d.text").alias("_whole"), F.col("w.size").alias("_size"), F.explode("w.runs").alias("_run"),
    )
    # Each piece is a word and the white space behind it; leading white space is a piece too.
    pieces = F.split("_whole", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("_whole").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.array_join(F.slice(pieces, (F.col("_run.start") + 1 + lead).cast("int"), F.col("_run.words").cast("int")), "")
    text = F.when(F.col("_run.words") == F.col("_size"), F.col("_whole")).otherwise(cut)
    out = rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns)


def _merged(parts: Column) -> Column:
    """Sorted runs (start, words), with those that touch put together."""
    none = F.array().cast("array<struct<start:bigint,words:bigint>>")

    def put(a: Column, p: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        grown = F.struct(last["start"].alias("start"), (last["words"] + p["words"]).alias("words"))
        joins = (F.size(a) > 0) & (last["start"] + last["words"] == p["start"])
        return F.when(joins, F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), grown)).otherwise(
            F.array_append(a, F.struct(p["start"].alias("start"), p["words"].alias("words")))
        )

    return F.aggregate(parts, none, put)
