"""URL filters: a blocked Bloom filter before an exact hash join.

What is listed becomes a table of keys: a rule's host and path, or the canonical form of a
listed URL. All keys go into one Bloom filter of 512-bit blocks; a key sets one bit in each
of the eight words of its block. A URL asks for the keys that could fit it, which are its
canonical form and, for each shape that a rule has (labels of the host, characters of the
path), its own last labels and first characters. The keys that the filter passes, nearly all
of them listed, go to a hash join on the key itself, which removes the false positives.

The filter's size follows the number of keys up to ``MAX_BLOCKS``, so it is at most two
megabytes; beyond that it passes more false positives and no result changes. It reaches the
tasks as the value of a scalar subquery. The keys are broadcast up to ``BROADCAST_ROWS``
rows; more of them are joined on (key, salt), as one rule can fit most rows.

The longest rule that fits decides. Without one, a URL is blocked if its canonical form is
listed and allowed otherwise. A null URL, or one without ``://``, has an empty host and path,
fits nothing and is allowed. Rows are judged one by one: repeated rows each have their row,
null ids stay null, extra columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from mcqflow.llm.common import ascii_lower, checkpointed

LANES = 8
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 15
BROADCAST_ROWS = 200_000  # keys of some hundred bytes
SALTS = 16

# Parameters that say where a visitor came from, not what is shown.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
SPAM_HOST = r"(^|[.-])(casino|lottery|pills|porn|spam|viagra)([.-]|$)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path and parameters without what doesn't change the page: scheme, user, usual port,
    ``www.``, repeated and last slashes, index page, tracking, order of parameters, fragment.
    Null where there is no ``://``."""
    host = F.regexp_replace(host_of(url), r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", "/"), "/$", "")
    asked = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.contains("://"), whole)


def spam_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages whose host bears one of the words of spam."""
    listed = pages.where(host_of(F.col("url")).rlike(SPAM_HOST)).select(canonical(F.col("url")).alias("url"))
    return listed.where("url is not null").distinct()


def _ranked(rules: Sequence[Rule]) -> list[Rule]:
    """Different rules from the weakest to the strongest; the first of two with one name counts."""
    first = {r.name: r for r in reversed(rules)}.values()
    return sorted(first, key=lambda r: (len(r.name), len(r.host), r.name))


def _keys(listed: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """key and rank of all that is listed: 0 for a URL, else the place of a rule."""
    keys = listed.select(F.concat(F.lit("u "), "url").alias("key"), F.lit(0).alias("rank")).where("key is not null").distinct()
    rows = [("r " + r.name, i) for i, r in enumerate(_ranked(rules), 1)]
    if not rows:
        return keys
    return keys.union(listed.sparkSession.createDataFrame(rows, "key string, rank int"))


def _asked(rules: Sequence[Rule]) -> list[Column]:
    """The keys that may fit a row of host, path and canonical URL; rows may ask for one twice."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    parts = [
        F.concat(F.lit("r "), F.substring_index("host", ".", -labels), F.substring("path", 1, chars)) for labels, chars in shapes
    ]
    return [*parts, F.concat(F.lit("u "), "canonical")]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """The bit of each word of the block."""
    h = F.xxhash64(key, F.lit(LANES))
    one = F.lit(1).cast("bigint")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(LANES)]


def block_count(keys: int) -> int:
    """A power of two with ``BITS_PER_KEY`` bits for each key, up to ``MAX_BLOCKS``."""
    return min(MAX_BLOCKS, 1 << max(0, (keys * BITS_PER_KEY - 1) // (64 * LANES)).bit_length())


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row: the words of all blocks, in order."""
    key = F.col("key")
    words = [F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(key))]
    set_blocks = keys.groupBy(_block(key, blocks).alias("block")).agg(*words)
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).join(set_blocks, "block", "left")
    zero = F.lit(0).cast("bigint")
    row = F.struct("block", F.array(*(F.coalesce(f"w{i}", zero) for i in range(LANES))).alias("words"))
    return every.agg(F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["words"])).alias("words"))


def may_hold(words: Column, key: Column, blocks: int) -> Column:
    """Whether the filter may hold a key; surely false where it says so."""
    at = _block(key, blocks) * LANES
    out = F.lit(True)
    for i, bit in enumerate(_bits(key)):
        out = out & (F.get(words, at + i).bitwiseAND(bit) == bit)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each page; ``listed`` has canonical URLs in ``url``."""
    keys = checkpointed(_keys(listed, rules))
    n = keys.count()
    blocks = block_count(n)
    words = bloom_filter(keys, blocks).scalar()
    url = F.col("url")
    rows = pages.select("page_id", "url", F.monotonically_increasing_id().alias("row")).select(
        "page_id", "row", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical")
    )
    passed = F.array_compact(F.array(*(F.when(may_hold(words, key, blocks), key) for key in _asked(rules))))
    hits = rows.select("page_id", "row", "host", "path", F.explode_outer(passed).alias("key"))
    on = ["key"]
    if n <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    else:
        on = ["key", "salt"]
        hits = hits.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    best = hits.join(keys, on, "left").groupBy("row", "page_id", "host", "path").agg(F.max("rank").alias("rank"))
    ranked = _ranked(rules)
    names = F.array(*(F.lit(r.name) for r in ranked)).cast("array<string>")
    verdicts = F.array(*(F.lit(r.verdict) for r in ranked)).cast("array<string>")
    own = F.when(F.col("rank") == 0, "block").otherwise("allow")
    return best.select(
        "page_id", "host", "path",
        F.get(names, F.col("rank") - 1).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("rank") - 1), own).alias("verdict"),
    )


def judge_pages(pages: DataFrame) -> DataFrame:
    """The rules, and the list of spam that the pages give."""
    return judge(pages, spam_urls(pages))
