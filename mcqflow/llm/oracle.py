"""DuckDB SQL for the operators that SQL can express. The others are tested by brute force."""

from __future__ import annotations

import math

from mcqflow.llm import licenses, quality, urls

_SPACE = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _list(values: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _rule(rule: quality.Rule) -> str:
    tests = [f"{rule.measure} < {rule.low}"] if rule.low is not None else []
    tests += [f"{rule.measure} > {rule.high}"] if rule.high is not None else []
    return f"CASE WHEN {' OR '.join(tests)} THEN '{rule.name}' END"


def quality_sql() -> str:
    base = ", ".join(_rule(r) for r in quality.BASE_RULES)
    every = ", ".join(_rule(r) for r in (*quality.BASE_RULES, *quality.RULES))
    k = quality.WINDOW
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '{_SPACE}') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
g AS (SELECT doc_id, i, w[i:i + {k - 1}] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, {k}) AS r(j) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '{quality.SYMBOLS}'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_intersect(list_distinct(w), {_list(quality.STOP_WORDS)})) AS n_stop_words, len(lines) AS n_lines
  FROM w LEFT JOIN covered USING (doc_id)),
r AS (
  SELECT *, CASE WHEN n_words = 0 THEN 0 ELSE 100 * n_repeat_words / n_words END AS repeat_percent,
    CASE WHEN n_words = 0 THEN 0 ELSE word_chars / n_words END AS mean_word_chars,
    CASE WHEN n_words = 0 THEN 0 ELSE n_symbols / n_words END AS symbols_per_word,
    CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines / n_lines END AS dup_lines_per_line
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  concat_ws(',', {base}) <> '' AS base_failed, concat_ws(',', {every}) = '' AS kept, concat_ws(',', {every}) AS failed
FROM r"""


JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i:i + 4] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""

SUBSTRING_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, range(0, 20) AS r(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

WARC_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""


def license_sql() -> str:
    phrases = " UNION ALL ".join(
        f"SELECT {_list(p.split())} AS p, '{label}' AS label" for p, label in licenses.PHRASES.items()
    )
    rows = []
    for text, label in licenses.TEMPLATES.items():
        tokens = sorted(set(text.split()))
        least = math.ceil(round(licenses.THRESHOLD * len(tokens), 9))
        rows.append(f"SELECT {_list(tokens)} AS tokens, '{label}' AS label, {least} AS needed")
    templates = " UNION ALL ".join(rows)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH t AS (SELECT doc_id, {_LOWER} AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{word}') AS w FROM t),
p AS ({phrases}),
places AS (
  SELECT doc_id, i - 1 AS i, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), p
  WHERE w[i] = p[1] AND w[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b FROM places GROUP BY doc_id),
blocks AS (
  SELECT doc_id, list_distinct(regexp_extract_all(line, '{word}')) AS b
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  UNION ALL
  SELECT doc_id, list_distinct(w[i:(i + {licenses.WINDOW - 1})])
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1, {licenses.STRIDE})) AS i FROM w)),
q AS ({templates}),
hits AS (
  SELECT doc_id, label, len(list_intersect(b, tokens)) / len(tokens) AS share FROM blocks, q
  WHERE len(list_intersect(b, tokens)) >= needed),
best AS (SELECT doc_id, max(share) AS share FROM hits GROUP BY doc_id),
base_labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM places GROUP BY doc_id),
labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l
  FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a AS first_word, base.b AS last_word,
  coalesce(base_labels.l, '') AS base_labels, coalesce(labels.l, '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN base_labels USING (doc_id) LEFT JOIN labels USING (doc_id)"""


def url_sql() -> str:
    def canonical(url: str) -> str:
        host = f"regexp_replace({_host(url)}, '^.*@', '')"
        host = f"regexp_replace(regexp_replace({host}, ':(80|443)?$', ''), '^www\\.', '')"
        path = f"regexp_replace(coalesce(regexp_extract({url}, '://[^/?#]*([^?#]*)', 1), ''), '/+', '/', 'g')"
        path = f"regexp_replace(regexp_replace({path}, '/index\\.html?$', '/'), '/$', '')"
        kept = (
            f"list_sort(list_filter(string_split(regexp_extract({url}, '://[^?#]*\\?([^#]*)', 1), '&'),"
            f" lambda x: x <> '' AND NOT regexp_matches(x, '{urls.TRACKING}')))"
        )
        query = f"array_to_string({kept}, '&')"
        return f"{host} || {path} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"

    def _host(url: str) -> str:
        return f"translate(coalesce(regexp_extract({url}, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_UPPER.lower()}')"

    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in urls.RULES)
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS i, page_id, url, {_host("url")} AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    CASE WHEN contains(url, '://') THEN {canonical("url")} END AS canonical
  FROM pages),
listed AS (SELECT DISTINCT canonical FROM p WHERE regexp_matches(host, '{urls.SPAM_HOST}') AND canonical IS NOT NULL),
r(verdict, h, f) AS (VALUES {rules}),
fits AS (
  SELECT i, verdict, h || f AS rule, row_number() OVER (PARTITION BY i ORDER BY length(h || f) DESC, length(h) DESC) AS k
  FROM p, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f))
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (i)"""


# The 256 remainders of the CRC by its polynomial, as a list t.
_CRC_TABLE = """
SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i))"""


def _crc(text: str) -> str:
    """CRC of a text's UTF-8 bytes, where a list t of remainders is at hand."""
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || hex(encode({text}))[(2 * i + 1):(2 * i + 2)])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER_OR_NULL = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
MERKLE_SQL = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("text")} AS leaf, {_leaf(_LOWER_OR_NULL)} AS low FROM documents),
n AS (
  SELECT row_number() OVER () AS r, doc_id, tree, leaf, CASE WHEN {_crc("doc_id::VARCHAR")} % 3 = 0 THEN low ELSE leaf END AS now,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, low) - 1 AS pos
  FROM d, crc),
lv(tree, level, nodes) AS (
  SELECT tree, 0, list(leaf ORDER BY pos) FROM n GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[(i + 1):(i + 8)], '')))
  FROM lv WHERE len(nodes) > 1),
sub AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM lv WHERE len(nodes) = 1),
tv(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM sub
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[(i + 1):(i + 8)], '')))
  FROM tv WHERE len(nodes) > 1),
steps AS (
  SELECT r, level AS step, nodes, n.pos >> (3 * level) AS p FROM n JOIN lv USING (tree) WHERE len(nodes) > 1
  UNION ALL
  SELECT r, 100 + level, nodes, sub.pos >> (3 * level) FROM n JOIN sub USING (tree), tv WHERE len(nodes) > 1),
beside AS (
  SELECT r, step, array_to_string(nodes[(p // 8 * 8 + 1):p], '') AS a, array_to_string(nodes[(p + 2):(p // 8 * 8 + 8)], '') AS b
  FROM steps),
path AS (SELECT r, string_agg(a || b, '' ORDER BY step) AS proof, list(a || '|' || b ORDER BY step) AS l FROM beside GROUP BY r),
folded AS (
  SELECT n.*, coalesce(proof, '') AS proof, list_reduce(
    list_prepend(now, coalesce(l, [])), lambda c, x: sha256(split_part(x, '|', 1) || c || split_part(x, '|', 2))) AS folded_root
  FROM n LEFT JOIN path USING (r)),
top AS (SELECT nodes[1] AS root FROM tv WHERE len(nodes) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN sub USING (tree), top"""


_FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESAMPLING_SQL = rf"""
WITH crc AS ({_CRC_TABLE}),
w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_FEATURE_WORD}') AS w, true AS own FROM documents
  UNION ALL
  SELECT -row_number() OVER (), NULL, regexp_extract_all({_LOWER}, '{_FEATURE_WORD}'), false FROM benchmark),
g AS (
  SELECT r, own, array_to_string(w[i:(i + k - 1)], ' ') AS g
  FROM (SELECT r, own, w, unnest(range(1, len(w) + 1)) AS i FROM w), range(1, 4) AS k(k) WHERE i + k - 1 <= len(w)),
runs AS (SELECT g, {_crc("g")} % 10000 AS bucket FROM (SELECT DISTINCT g FROM g), crc),
f AS (SELECT r, own, bucket, count(*) AS n FROM g JOIN runs USING (g) GROUP BY r, own, bucket),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM f GROUP BY bucket),
every AS (SELECT sum(s) AS S_all, sum(t) AS T_all FROM sums),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (S_all + 10000) / ((s + 1) * (T_all + 10000))))::BIGINT AS gain FROM sums, every),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE own GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weights USING (r) WHERE own),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS place FROM scored WHERE n_words >= 20),
most AS (SELECT 5 * count(*) // 100 AS most FROM ranked)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank
FROM scored LEFT JOIN ranked USING (r), most"""


def all_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_sql(),
        "op3_ngram_jaccard_join": JACCARD_SQL,
        "op4_substring_dedup": SUBSTRING_SQL,
        "op6_warc": WARC_SQL,
        "op8_license_scans": license_sql(),
        "op11_importance_resampling": RESAMPLING_SQL,
        "op12_merkle_manifest": MERKLE_SQL,
        "op13_url_filters": url_sql(),
    }
