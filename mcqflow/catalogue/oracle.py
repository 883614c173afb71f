"""The same results in SQL, written apart from the library, for DuckDB.

Byte ids come from the hex form of the text; numbering uses the plain global window.
"""

from __future__ import annotations

# --- shared pieces -----------------------------------------------------------

_NL = "chr(10)"
# The exam's wording and the chat strings.
_EXAM = (
    f"'You are taking a multiple-choice exam.' || {_NL} || 'Choose the correct answer.' || {_NL}"
    f" || 'Respond with ONLY the letter: A, B, C, or D.' || {_NL}"
)
_GEN = f"'<|im_start|>assistant' || {_NL}"
_NO_THINK = f"'<think>' || {_NL} || {_NL} || '</think>' || {_NL} || {_NL}"
_END = f"'<|im_end|>' || {_NL}"


def _user(text: str) -> str:
    return f"'<|im_start|>user' || {_NL} || {text} || {_END}"


def _bytes(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::INT)"


def _digest(ids: str, name: str = "ids") -> str:
    return (
        f"len({ids})::BIGINT AS {name}_n, coalesce(list_sum({ids}), 0)::BIGINT AS {name}_sum,"
        f" md5(array_to_string({ids}, ' ')) AS {name}_md5"
    )


def _repeat(value: int, n: str) -> str:
    return f"list_transform(range({n}), lambda x: {value})"


_RIGHT = "substr('ABCD', (p_partkey % 4)::INT + 1, 1)"
_OPTIONS = ", ".join(
    f"'Brand#' || (((k - 1 + ({i} - p_partkey % 4) * 7) + 25) % 25 + 1)" for i in range(4)
)

QUESTIONS = f"""
numbered AS (SELECT *, regexp_extract(p_brand, '#([0-9]+)', 1)::BIGINT AS k FROM part),
questions AS (
  SELECT p_partkey AS item_id,
    'Which brand is the ' || p_name || ', part ' || p_partkey || '?' AS question,
    [{_OPTIONS}] AS choices,
    CASE WHEN p_partkey % 50 <> 0 THEN p_type END AS subject,
    CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 4)::VARCHAR
         WHEN p_partkey % 3 = 1 THEN {_RIGHT}
         ELSE ' ' || {_RIGHT} || chr(9) END AS answer,
    {_RIGHT} AS gold,
    CASE WHEN p_partkey % 10 = 0 THEN 'validation' ELSE 'auxiliary_train' END AS split
  FROM numbered)
"""


def _exam(subject: str) -> str:
    options = " || ".join(f"{_NL} || '{c}. ' || choices[{i + 1}]" for i, c in enumerate("ABCD"))
    return (
        f"{_EXAM} || CASE WHEN {subject} <> '' THEN 'Subject: ' || {subject} || {_NL} ELSE '' END"
        f" || 'Question: ' || question || {_NL} || 'Choices:' || {options}"
    )


_RENDERED = f"""
exam AS (SELECT *, {_exam("coalesce(subject, '')")} AS prompt FROM questions),
prompts AS (
  SELECT *, {_user('prompt')} || {_GEN} || {_NO_THINK} AS prompt_text,
    {_user('prompt')} || {_GEN} || {_NO_THINK} || gold || {_END} AS full_text
  FROM exam)
"""
PROMPTS = f"{QUESTIONS}, {_RENDERED}"

_HEX = "(strpos('0123456789abcdef', substr(d, {n}, 1)) - 1)"
OUTPUTS = f"""
digests AS (
  SELECT run, p_partkey AS item_id, md5(run || ':' || p_partkey) AS d
  FROM part, (VALUES ('base'), ('tuned')) AS r(run)),
picks AS (
  SELECT run, item_id, {_HEX.format(n=3)} % 6 AS form, substr('ABCD', 1 + (CASE
      WHEN {_HEX.format(n=1)} < CASE WHEN run = 'tuned' THEN 12 ELSE 7 END THEN item_id % 4
      ELSE {_HEX.format(n=2)} % 4 END)::INT, 1) AS l
  FROM digests),
outputs AS (
  SELECT run, item_id, CASE form WHEN 0 THEN l || '.' WHEN 1 THEN 'The answer is ' || l || '.'
    WHEN 2 THEN lower(l) || ')' WHEN 3 THEN '(' || l || ')' WHEN 4 THEN 'Because' ELSE '' END AS output_text
  FROM picks)
"""


def _parsed(text: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({text}, '\\b([ABCD])\\b', 1), ''),"
        f" CASE WHEN upper(substr({text}, 1, 1)) IN ('A', 'B', 'C', 'D') THEN upper(substr({text}, 1, 1)) END)"
    )


SCORED = f"""{QUESTIONS}, {OUTPUTS},
parsed AS (SELECT run, item_id, {_parsed('output_text')} AS pred FROM outputs),
scored AS (
  SELECT run, q.item_id, gold, coalesce(subject, '') AS subject, pred, coalesce(pred = gold, false) AS correct
  FROM questions q JOIN parsed USING (item_id))
"""

_COUNTS = (
    "count(*) FILTER (correct)::BIGINT AS correct, count(*)::BIGINT AS total,"
    " coalesce(count(*) FILTER (correct) / nullif(count(*), 0), 0.0)::DOUBLE AS acc"
)


def _tokens(max_len: int) -> str:
    """Prepared token rows: ids, prompt length and labels."""
    return f"""{PROMPTS},
cut AS (
  SELECT item_id, coalesce(subject, '') AS subject, gold, {_bytes('full_text')}[1:{max_len}] AS ids,
    least(strlen(prompt_text), {max_len}) AS plen
  FROM prompts),
tokens AS (
  SELECT *, list_concat({_repeat(-100, 'least(plen, len(ids))')}, ids[plen + 1:]) AS labels,
    {_repeat(1, 'len(ids)')} AS mask
  FROM cut)
"""


SHORT = 300

_PIECE = r"\p{L}+|\p{N}+|[^\s\x0b\p{Z}\p{L}\p{N}]"
VOCABULARY = f"""
words AS (
  SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '{_PIECE}') AS w FROM documents)),
vocabulary AS (
  SELECT token, (row_number() OVER (ORDER BY n DESC, token) - 1)::INT AS id, n FROM (
    SELECT token, count(*)::BIGINT AS n FROM words GROUP BY token ORDER BY n DESC, token LIMIT 5000)),
encoded AS (
  SELECT doc_id AS item_id, coalesce(list(coalesce(id, 5000) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ids,
    string_agg(v.token, ' ' ORDER BY pos) AS text
  FROM documents LEFT JOIN words USING (doc_id) LEFT JOIN vocabulary v ON v.token = words.token
  GROUP BY doc_id)
"""

MERGES = 64
_SUBWORD = r" ?\p{L}+| ?\p{N}+| ?[^\x09-\x0D\x20\p{L}\p{N}]+|[\x09-\x0D\x20]+"
_LATIN = f"array_to_string(list_transform({_bytes('piece')}, lambda b: chr(b)), '')"
# One merge a step, and all pairs counted anew for each.
SUBWORDS = f"""
cut AS (SELECT doc_id, regexp_extract_all(text, '{_SUBWORD}') AS w FROM documents),
different AS (
  SELECT piece, {_LATIN} AS word, n FROM (SELECT piece, count(*) AS n FROM (SELECT unnest(w) AS piece FROM cut) GROUP BY piece)),
trained(step, word, n, pair, times) AS (
  SELECT 0, word, n, '', 0::BIGINT FROM different
  UNION ALL
  SELECT step + 1, replace(word, best.p, chr(256 + step)), n, best.p, best.times
  FROM trained, (
    SELECT p, sum(n)::BIGINT AS times
    FROM (SELECT substr(word, i, 2) AS p, n FROM (SELECT word, n, unnest(range(1, length(word))) AS i FROM trained))
    GROUP BY p HAVING sum(n) >= 2
    ORDER BY times DESC, greatest(unicode(p[1]), unicode(p[2])), unicode(p[1]), unicode(p[2]) LIMIT 1) AS best
  WHERE step < {MERGES}),
merges AS (
  SELECT DISTINCT step - 1 AS rank, unicode(pair[1]) AS left_id, unicode(pair[2]) AS right_id, 255 + step AS id, times AS n, pair
  FROM trained WHERE step > 0),
ordered AS (SELECT list(pair || chr(id) ORDER BY rank) AS l FROM merges)
"""


def _subword_ids(pieces: str) -> str:
    """Ids of a table of pieces: every merge in order, on every piece."""
    return (
        f"SELECT piece, list_transform(range(1, length(w) + 1), lambda i: unicode(substr(w, i::INT, 1))) AS ids FROM ("
        f"SELECT piece, list_reduce(list_prepend({_LATIN}, l), lambda w, m: replace(w, m[1:2], m[3])) AS w"
        f" FROM (SELECT DISTINCT piece FROM {pieces}), ordered)"
    )


_TURN = f"'<|im_start|>' || role || {_NL} || text || {_END}"

_DIALOGUES = (
    f"t AS (SELECT conv_id, turn, role,"
    f" {_bytes(f'{chr(39)}<|im_start|>{chr(39)} || role || {_NL}')} AS head,"
    f" {_bytes(f'text || {_END}')} AS body FROM conversations),"
    f" l AS (SELECT *, list_concat({_repeat(-100, 'len(head)')}, CASE WHEN role = 'assistant' THEN body"
    f" ELSE {_repeat(-100, 'len(body)')} END) AS turn_labels FROM t),"
    f" g AS (SELECT conv_id, flatten(list(list_concat(head, body) ORDER BY turn)) AS ids,"
    f" flatten(list(turn_labels ORDER BY turn)) AS labels FROM l GROUP BY conv_id)"
)

def _permuted(ranked: str, seed: int, epochs: int) -> str:
    """Tables that end in ``permuted(item_id, epoch, position)``, from ``ranked(item_id, i)``: three double
    rounds over a mixed base, walked until the position is below the number of rows."""

    def added(k: int, turn: int, digit: str) -> str:
        return f"('0x' || substr(md5('{seed}:' || epoch || ':{k}:{turn}:' || {digit}), 1, 15))::BIGINT"

    once = "SELECT item_id, epoch, walks, n, a, b, spot // b AS l, spot % b AS r FROM ({rows})"
    for turn in range(3):
        once = f"SELECT * REPLACE ((l + {added(0, turn, 'r')} % a) % a AS l) FROM ({once})"
        once = f"SELECT * REPLACE ((r + {added(1, turn, 'l')} % b) % b AS r) FROM ({once})"
    start = once.format(rows="SELECT *, 0 AS walks, i AS spot FROM placed")
    again = once.format(rows="SELECT item_id, epoch, walks + 1 AS walks, n, a, b, spot FROM walked WHERE spot >= n")
    return f"""{ranked},
sized AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, ceil(sqrt(n))::BIGINT AS a FROM (SELECT count(*) AS n FROM ranked))),
placed AS (SELECT item_id, i, epoch, n, a, b FROM ranked, sized, range({epochs}) AS e(epoch)),
walked AS (
  SELECT item_id, epoch, walks, n, a, b, l * b + r AS spot FROM ({start})
  UNION ALL
  SELECT item_id, epoch, walks, n, a, b, l * b + r AS spot FROM ({again})),
permuted AS (SELECT item_id, epoch::INT AS epoch, spot::BIGINT AS position FROM walked WHERE spot < n)"""


def _ranks(item: str) -> str:
    return f"ranked AS (SELECT {item} AS item_id, row_number() OVER (ORDER BY {item}) - 1 AS i FROM documents)"


_MANIFEST = """
epochs AS (SELECT doc_id AS item_id, epoch FROM documents, (VALUES (0), (1)) AS e(epoch)),
shuffled AS (
  SELECT epoch, item_id, row_number() OVER (
    PARTITION BY epoch ORDER BY md5('42:' || epoch || ':' || item_id)) - 1 AS position
  FROM epochs),
manifest AS (
  SELECT epoch::INT AS epoch, (position // 2 // 2 // 4)::BIGINT AS step, (position // 2 % 2)::INT AS rank,
    (position // 2 // 2 % 4)::INT AS micro, (position // 2)::BIGINT AS batch_id, item_id
  FROM shuffled),
steps AS (
  SELECT epoch, step, count(*)::BIGINT AS items, max(step) OVER (PARTITION BY epoch) + 1 AS epoch_steps
  FROM manifest GROUP BY epoch, step),
counted AS (
  SELECT epoch, (epoch * epoch_steps + step + 1)::BIGINT AS step, items, step + 1 = epoch_steps AS ends_epoch
  FROM steps)
"""

STEP_LOG = """
ranked AS (
  SELECT event_type AS run, value AS loss,
    row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n FROM events),
step_log AS (
  SELECT run, n // 4 + 1 AS step, n % 2 AS rank, (n // 2) % 2 AS micro, loss FROM ranked)
"""

_BOUNDARY = """
boundary AS (SELECT *, max(micro) OVER (PARTITION BY run, step) AS last FROM step_log),
step_loss AS (SELECT run, step, avg(loss) AS loss FROM boundary WHERE micro = last GROUP BY run, step)
"""

_LABELS = f"""
vectors AS (
  SELECT vec_id AS item_id, 'g' || (label % 4) AS subject, (vec_id % 3)::INT AS pos,
    list_position(embedding, list_max(embedding)) - 1 AS pred, label, vec_id % 7 <> 0 AS supervised
  FROM embeddings),
flagged AS (SELECT *, pred = label AS correct FROM vectors WHERE supervised)
"""

_FIRST = (
    "coalesce(count(*) FILTER (correct) / nullif(count(*), 0), 0.0)::DOUBLE AS first_token_acc,"
    " count(*)::BIGINT AS eval_samples, count(*) FILTER (correct)::BIGINT AS correct"
)

_ARRIVED = f"""{QUESTIONS},
arrived AS (
  SELECT event_id, user_id AS item_id, ts, CASE WHEN value < 50 THEN substr('ABCD', (event_id % 4)::INT + 1, 1) END AS pred
  FROM events),
flagged AS (
  SELECT a.*, coalesce(subject, '') AS subject, coalesce(pred = gold, false) AS correct
  FROM arrived a JOIN questions USING (item_id))
"""

_EARLIEST = """
earliest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts, pred NULLS LAST) AS k FROM flagged) WHERE k = 1)
"""

_BROKEN = f"""{QUESTIONS},
broken AS (
  SELECT item_id, gold, CASE WHEN item_id % 31 <> 0 THEN item_id END AS shown_id,
    item_id % 17 = 0 AS no_question,
    item_id % 13 <> 0 AND item_id % 19 <> 0 AND item_id % 29 = 0 AS no_choices,
    item_id % 13 = 0 AS few,
    item_id % 13 <> 0 AND item_id % 19 = 0
      AND len(list_filter(choices, lambda c: c LIKE '%1')) > 0 AS null_choice,
    item_id % 11 <> 0 AND item_id % 23 = 0 AS no_answer,
    item_id % 11 = 0 AS bad_answer
  FROM questions),
reasons AS (
  SELECT item_id, shown_id, CASE WHEN shown_id IS NULL THEN 'missing item_id' WHEN no_question THEN 'missing question' WHEN no_choices THEN 'missing choices'
    WHEN few THEN 'fewer than four choices' WHEN null_choice THEN 'null choice'
    WHEN no_answer THEN 'missing answer' WHEN bad_answer THEN 'invalid answer' END AS invalid_reason
  FROM broken)
"""

_PICK = "substr('ABCD', (strlen(prompt_text) % 4)::INT + 1, 1)"
# The id model sees at most 2048 ids; no prompt here is that long.
_GENERATED = f"""{PROMPTS},
flagged AS (SELECT item_id, coalesce(subject, '') AS subject, {_PICK} = gold AS correct FROM prompts)
"""


def _first_token(max_len: int) -> str:
    return f"""{_tokens(max_len)},
flagged AS (SELECT item_id, subject, 65 + len(ids) % 4 = labels[plen + 1] AS correct
  FROM tokens WHERE plen < len(ids))
"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def all_sql() -> dict[str, str]:
    record = (
        "overall AS (SELECT count(*) FILTER (correct) / count(*) AS acc, count(*)::BIGINT AS n FROM {t}),"
        " per AS (SELECT subject, " + _COUNTS + " FROM {t} GROUP BY subject)"
    )
    base = "flagged AS (SELECT * FROM scored WHERE run = 'base')"
    tuned = "flagged AS (SELECT * FROM scored WHERE run = 'tuned')"
    sides = ", ".join(
        f"max({c}) FILTER (run = '{r}') AS {r}_{c}" for r in ("base", "tuned") for c in ("correct", "total", "acc")
    )
    compared = _with(
        f"{SCORED}, per AS (SELECT run, subject, {_COUNTS} FROM scored GROUP BY run, subject),"
        f" sides AS (SELECT subject, {sides} FROM per GROUP BY subject)",
        "SELECT *, tuned_acc - base_acc AS delta FROM sides",
    )
    vocabulary_ids = _with(VOCABULARY, f"SELECT item_id, {_digest('ids')} FROM encoded")
    spelled = (
        f"{SUBWORDS}, used AS (SELECT doc_id, unnest(w) AS piece, unnest(range(len(w))) AS pos FROM cut),"
        f" spelled AS ({_subword_ids('used')})"
    )
    subword_rows = (
        f"{SUBWORDS}, {PROMPTS}, sides AS (SELECT item_id, unnest([prompt_text, full_text]) AS t, unnest([0, 1]) AS side FROM prompts),"
        f" used AS (SELECT item_id, side, unnest(w) AS piece, unnest(range(len(w))) AS pos"
        f" FROM (SELECT *, regexp_extract_all(t, '{_SUBWORD}') AS w FROM sides)),"
        f" spelled AS ({_subword_ids('used')}),"
        f" whole AS (SELECT item_id, side, flatten(list(ids ORDER BY pos))[1:{SHORT}] AS ids FROM used JOIN spelled USING (piece) GROUP BY 1, 2),"
        f" tokens AS (SELECT f.item_id, f.ids, list_concat({_repeat(-100, 'least(len(p.ids), len(f.ids))')}, f.ids[len(p.ids) + 1:]) AS labels"
        f" FROM whole f JOIN whole p USING (item_id) WHERE f.side = 1 AND p.side = 0)"
    )
    vocabulary_text = _with(VOCABULARY, "SELECT item_id, md5(coalesce(text, '')) AS text_md5 FROM encoded")
    per_subject = f"SELECT subject, {_COUNTS} FROM flagged GROUP BY subject"
    generated_suffix = f"{_bytes("'Answer ' || gold")}"
    return {
        "s1_read_split": _with(
            QUESTIONS,
            "SELECT item_id, question, subject, answer, split FROM questions WHERE split = 'validation'",
        ),
        "s2_read_splits": _with(QUESTIONS, "SELECT item_id, split FROM questions"),
        "s3_row_contract": _with(_BROKEN, "SELECT shown_id AS item_id, invalid_reason FROM reasons"),
        "s3_quarantine": _with(
            _BROKEN,
            "SELECT coalesce(invalid_reason, 'valid') AS outcome, count(*)::BIGINT AS n FROM reasons GROUP BY 1",
        ),
        "s4_prepared_table": _with(
            PROMPTS,
            "SELECT item_id, split, gold, coalesce(subject, '') AS subject, md5(prompt_text) AS prompt_md5 FROM prompts",
        ),
        "s5_result_json": _with(
            f"{SCORED}, {base}, {record.format(t='flagged')}",
            "SELECT 'generate' AS metric, overall.acc AS overall_acc, n, subject, per.acc, correct, total FROM per, overall",
        ),
        "s6_count_splits": _with(QUESTIONS, "SELECT split, count(*)::BIGINT AS n FROM questions GROUP BY split"),
        "p1_answer_letter": _with(QUESTIONS, "SELECT item_id, gold FROM questions"),
        "p1_answer_or_null": _with(
            _BROKEN, "SELECT shown_id AS item_id, CASE WHEN NOT no_answer AND NOT bad_answer THEN gold END AS gold FROM broken"
        ),
        "p2_mcq_prompt": _with(PROMPTS, "SELECT item_id, prompt FROM prompts"),
        "p3_prompt_by_name": _with(QUESTIONS, f"SELECT item_id, {_exam(chr(39) * 2)} AS prompt FROM questions"),
        "p4_chat_prompt": _with(
            QUESTIONS,
            f"SELECT item_id, {_user('question')} || {_GEN} || {_NO_THINK} AS plain,"
            f" {_user('question')} || {_GEN} AS thinking FROM questions",
        ),
        "p5_chat_dialogue": _with(
            QUESTIONS,
            f"SELECT item_id, {_user('question')} || {_GEN} || {_NO_THINK} || gold || {_END} AS dialogue FROM questions",
        ),
        "p6_render_dialogues": "SELECT conv_id, count(*)::BIGINT AS turns,"
        f" string_agg({_TURN}, '' ORDER BY turn) AS text FROM conversations GROUP BY 1",
        "p6_shifted_turns": "SELECT conv_id, count(*)::BIGINT AS turns,"
        f" string_agg({_TURN}, '' ORDER BY turn) || {_GEN} || {_NO_THINK} AS text FROM conversations GROUP BY 1",
        "p6_turn_offsets": f"SELECT conv_id, turn, md5(t) AS text_md5, coalesce(sum(length(t)) OVER (PARTITION BY conv_id"
        " ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset"
        f" FROM (SELECT conv_id, turn, {_TURN} AS t FROM conversations)",
        "p6_null_turns": "WITH m AS (SELECT conv_id, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'missing role'"
        " WHEN (conv_id + turn) % 11 = 0 THEN 'missing text' END AS reason FROM conversations),"
        " c AS (SELECT conv_id, count(reason) AS bad, count(*) AS n FROM m GROUP BY conv_id)"
        " SELECT conv_id, 'rendered' AS outcome, n::BIGINT AS n FROM c WHERE bad = 0 UNION ALL"
        " SELECT conv_id, coalesce(reason, 'held'), count(*)::BIGINT FROM m JOIN c USING (conv_id) WHERE bad > 0 GROUP BY 1, 2",
        "p6_message_lists": "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles,"
        f" md5(string_agg({_TURN}, '' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1",
        "p7_byte_ids": f"SELECT item_id, {_digest('ids')} FROM"
        f" (SELECT doc_id AS item_id, {_bytes('text')} AS ids FROM documents)",
        "p7v_vocabulary_ids": vocabulary_ids,
        "j2_vocabulary_join": vocabulary_ids,
        "v1_subword_merges": f"WITH RECURSIVE {SUBWORDS} SELECT rank, left_id, right_id, id, n FROM merges",
        "p7_subword_ids": f"WITH RECURSIVE {spelled}, whole AS ("
        " SELECT doc_id AS item_id, coalesce(flatten(list(ids ORDER BY pos) FILTER (ids IS NOT NULL)), []) AS ids"
        " FROM documents LEFT JOIN used USING (doc_id) LEFT JOIN spelled USING (piece) GROUP BY doc_id)"
        f" SELECT item_id, {_digest('ids')} FROM whole",
        "p12_subword_rows": f"WITH RECURSIVE {subword_rows} SELECT item_id, {_digest('ids')}, {_digest('labels', 'labels')} FROM tokens",
        "p15_decode_subwords": "SELECT doc_id AS item_id, md5(text) AS text_md5 FROM documents",
        "v1_vocabulary": _with(VOCABULARY, "SELECT token, id, n FROM vocabulary"),
        "v2_special_ids": _with(
            VOCABULARY,
            "SELECT count(*)::BIGINT AS size, (max(id) + 1)::INT AS unk_id, (max(id) + 2)::INT AS eos_id,"
            " (max(id) + 2)::INT AS pad_id FROM vocabulary",
        ),
        "p8_truncate": f"SELECT item_id, {_digest('ids')}, true AS same FROM"
        f" (SELECT doc_id AS item_id, {_bytes('text')}[1:1024] AS ids FROM documents)",
        "p9_attention_mask": f"SELECT item_id, {_digest('mask', 'mask')} FROM (SELECT doc_id AS item_id,"
        f" {_repeat(1, 'strlen(text)')} AS mask FROM documents)",
        "p10_prompt_mask": _with(
            f"{QUESTIONS}, b AS (SELECT item_id, {_bytes('question')} AS ids, item_id % 50 AS plen FROM questions),"
            f" l AS (SELECT item_id, list_concat({_repeat(-100, 'least(plen, len(ids))')}, ids[plen + 1:]) AS labels FROM b)",
            f"SELECT item_id, {_digest('labels', 'labels')} FROM l",
        ),
        "p11_assistant_mask": _with(_DIALOGUES, f"SELECT conv_id, {_digest('ids')}, {_digest('labels', 'labels')} FROM g"),
        "p11_limited_mask": _with(
            f"{_DIALOGUES}, h AS (SELECT conv_id, ids[1:{SHORT}] AS ids, labels[1:{SHORT}] AS labels FROM g)",
            f"SELECT conv_id, {_digest('ids')}, {_digest('labels', 'labels')} FROM h",
        ),
        "p12_produced_columns": _with(_tokens(1024), "SELECT item_id, len(labels)::BIGINT AS length FROM tokens"),
        "p13_null_mode": _with(
            f"{_BROKEN}, {_RENDERED}",
            "SELECT shown_id AS item_id, CASE WHEN NOT (no_question OR no_choices OR few OR null_choice) THEN md5(prompt_text) END"
            " AS prompt_md5, CASE WHEN NOT no_answer AND NOT bad_answer THEN broken.gold END AS gold"
            " FROM broken JOIN prompts USING (item_id)",
        ),
        "p13_eval_prompts": _with(
            PROMPTS, "SELECT item_id, prompt_text, gold, coalesce(subject, '') AS subject FROM prompts"
        ),
        "p14_cut_prompt": _with(
            f"{QUESTIONS}, g AS (SELECT item_id, list_concat({generated_suffix}, [256]) AS ids FROM questions)",
            f"SELECT item_id, {_digest('ids')} FROM g",
        ),
        "p15_decode_bytes": _with(QUESTIONS, "SELECT item_id, 'Answer ' || gold AS text FROM questions"),
        "p15_decode_documents": "SELECT doc_id AS item_id, md5(text) AS text_md5 FROM documents",
        "p15_decode_vocabulary": vocabulary_text,
        "p15_decode_by_join": vocabulary_text,
        "p16_parse_letter": _with(
            OUTPUTS, f"SELECT run, item_id, {_parsed('output_text')} AS pred FROM outputs"
        ),
        "p17_correct": _with(SCORED, "SELECT run, item_id, pred, correct FROM scored"),
        "p17_scored_runs": _with(SCORED, "SELECT run, item_id, pred, correct FROM scored"),
        "p18_first_supervised": _with(
            _LABELS, "SELECT item_id, CASE WHEN supervised THEN pos::BIGINT END AS pos FROM vectors"
        ),
        "p19_argmax": "SELECT vec_id AS item_id,"
        " (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings",
        "p20_first_tokens": _with(
            _tokens(1024),
            "SELECT item_id, ids[plen + 1]::BIGINT AS gold_token, ids[plen + 2]::BIGINT AS pred_token FROM tokens",
        ),
        "f1_supervised_rows": _with(_tokens(SHORT), "SELECT item_id FROM tokens WHERE plen < len(ids)"),
        "f1_supervised_vectors": _with(_LABELS, "SELECT item_id, subject FROM flagged"),
        "f2_first_items": _with(QUESTIONS, "SELECT item_id, question FROM questions ORDER BY item_id LIMIT 1000"),
        "f3_due_steps": _with(_MANIFEST, "SELECT epoch, step, items FROM counted WHERE step % 10 = 0"),
        "f3_epoch_ends": _with(_MANIFEST, "SELECT epoch, step, items FROM counted WHERE ends_epoch"),
        "b1_shuffle": _with(_MANIFEST, "SELECT epoch::INT AS epoch, item_id, position::BIGINT AS position FROM shuffled"),
        "b1_permuted_rows": f"WITH RECURSIVE {_permuted(_ranks('doc_id'), 42, 2)} SELECT epoch, item_id, position FROM permuted",
        "b1_permuted_gaps": f"WITH RECURSIVE {_permuted(_ranks('doc_id * 3 + doc_id % 2'), 7, 1)}"
        " SELECT epoch, item_id, position FROM permuted",
        "b3_permuted_batches": f"WITH RECURSIVE {_permuted(f'{_tokens(1024)}, ranked AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM tokens)', 42, 2)},"
        " wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY epoch, position // 8) AS w FROM permuted JOIN tokens USING (item_id)),"
        f" padded AS (SELECT epoch, position, item_id, list_concat(ids, {_repeat(256, 'w - len(ids)')}) AS ids,"
        f" list_concat(labels, {_repeat(-100, 'w - len(ids)')}) AS labels FROM wide)"
        f" SELECT epoch, (position // 8)::BIGINT AS batch_id, (position % 8)::INT AS slot, item_id, {_digest('ids', 'input_ids')},"
        f" {_digest('labels', 'labels')} FROM padded",
        "b2_exact_batches": _with(
            "o AS (SELECT doc_id AS item_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)",
            "SELECT item_id, (i // 8)::BIGINT AS batch_id, (i % 8)::INT AS slot FROM o",
        ),
        "b2_batches": _with(
            "o AS (SELECT doc_id AS item_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)",
            "SELECT item_id, (i // 8)::BIGINT AS batch_id, (i % 8)::INT AS slot FROM o",
        ),
        "b3_pad": _with(
            f"{_tokens(1024)}, placed AS (SELECT *, (row_number() OVER (ORDER BY md5('42:0:' || item_id)) - 1) // 8"
            " AS batch_id FROM tokens),"
            " wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS w FROM placed),"
            f" padded AS (SELECT batch_id::BIGINT AS batch_id, item_id,"
            f" list_concat(ids, {_repeat(256, 'w - len(ids)')}) AS ids,"
            f" list_concat(mask, {_repeat(0, 'w - len(ids)')}) AS mask,"
            f" list_concat(labels, {_repeat(-100, 'w - len(ids)')}) AS labels FROM wide)",
            f"SELECT batch_id, item_id, {_digest('ids')}, {_digest('mask', 'mask')}, {_digest('labels', 'labels')} FROM padded",
        ),
        "b3_quarantine_batches": _with(
            f"{_BROKEN}, placed AS (SELECT item_id, (row_number() OVER (ORDER BY md5('42:0:' || item_id)) - 1) // 8"
            " AS batch_id FROM reasons WHERE invalid_reason IS NULL)",
            "SELECT batch_id::BIGINT AS batch_id, count(*)::BIGINT AS n, min(item_id) AS least FROM placed GROUP BY 1",
        ),
        "b1_null_keys": "WITH k AS (SELECT CASE WHEN doc_id % 5 <> 0 THEN source END AS g FROM documents)"
        " SELECT 'all' AS g, count(*)::BIGINT AS n, count(*)::BIGINT - 1 AS last FROM k UNION ALL"
        " SELECT g, count(*)::BIGINT, count(*)::BIGINT - 1 FROM k GROUP BY g",
        "b3_collate": _with(
            f"{_tokens(1024)}, placed AS (SELECT *, (row_number() OVER (ORDER BY item_id) - 1) // 8 AS batch_id FROM tokens),"
            " wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS w FROM placed),"
            f" padded AS (SELECT batch_id, item_id, w, list_concat(ids, {_repeat(256, 'w - len(ids)')}) AS ids,"
            f" list_concat(labels, {_repeat(-100, 'w - len(ids)')}) AS labels FROM wide),"
            " g AS (SELECT batch_id::BIGINT AS batch_id, max(w)::BIGINT AS width,"
            " string_agg(item_id::VARCHAR, ' ' ORDER BY item_id) AS items,"
            " flatten(list(ids ORDER BY item_id)) AS ids, flatten(list(labels ORDER BY item_id)) AS labels"
            " FROM padded GROUP BY batch_id)",
            f"SELECT batch_id, width, items, {_digest('ids')}, {_digest('labels', 'labels')} FROM g",
        ),
        "b4_manifest": _with(_MANIFEST, "SELECT epoch, step, rank, micro, batch_id, item_id FROM manifest"),
        "b4_fractional_epochs": _with(
            f"{_MANIFEST}, per AS (SELECT max(step) + 1 AS n FROM manifest)",
            "SELECT epoch, step, rank, micro, batch_id, item_id FROM manifest, per WHERE epoch * n + step < floor(1.5 * n)",
        ),
        "b5_step_totals": _with(
            "c AS (SELECT count(*)::BIGINT AS samples FROM documents),"
            " b AS (SELECT samples, ceil(samples / 2)::BIGINT AS batches FROM c),"
            " s AS (SELECT *, ceil(ceil(batches / 2) / 4)::BIGINT AS steps_per_epoch FROM b),"
            " t AS (SELECT *, floor(1.5::DOUBLE * steps_per_epoch)::BIGINT AS total_steps FROM s)",
            "SELECT *, floor(total_steps * 0.03::DOUBLE)::BIGINT AS warmup_steps FROM t",
        ),
        "b6_sorted_subjects": _with(
            SCORED, f"SELECT run, subject, {_COUNTS} FROM scored GROUP BY run, subject ORDER BY run, subject"
        ),
        "j1_align": _with(
            f"{QUESTIONS}, {OUTPUTS}",
            "SELECT run, item_id, gold, coalesce(subject, '') AS subject, output_text"
            " FROM questions JOIN outputs USING (item_id)",
        ),
        "j1_missing_outputs": _with(
            f"{QUESTIONS}, {OUTPUTS}, answered AS (SELECT run, item_id, {_parsed('output_text')} AS pred FROM outputs WHERE output_text <> ''),"
            " flagged AS (SELECT r.run, coalesce(subject, '') AS subject, coalesce(pred = gold, false) AS correct"
            " FROM questions q CROSS JOIN (VALUES ('base'), ('tuned')) AS r(run) LEFT JOIN answered a ON a.run = r.run AND a.item_id = q.item_id)",
            f"SELECT run, subject, {_COUNTS} FROM flagged GROUP BY run, subject",
        ),
        "j2_salted_join": vocabulary_ids,
        "j3_compare_runs": compared,
        "j3_compare_results": compared,
        "a1_overall_accuracy": _with(SCORED, f"SELECT run, {_COUNTS} FROM scored GROUP BY run"),
        "a2_subject_accuracy": _with(SCORED, f"SELECT run, subject, {_COUNTS} FROM scored GROUP BY run, subject"),
        "a2_class_accuracy": _with(
            "flagged AS (SELECT source AS subject, coalesce(quality = 1 - toxic, false) AS correct"
            " FROM labels JOIN documents USING (doc_id))",
            f"SELECT coalesce(subject, '') AS subject, {_COUNTS} FROM flagged GROUP BY 1",
        ),
        "a3_first_token": _with(_LABELS, f"SELECT {_FIRST} FROM flagged"),
        "a3_repeated_scores": _with(_LABELS, f"SELECT {_FIRST} FROM flagged"),
        "a4_first_token_subjects": _with(_LABELS, f"SELECT subject, {_FIRST} FROM flagged GROUP BY subject"),
        "a5_merge_counts": _with(SCORED, f"SELECT run, subject, {_COUNTS} FROM scored GROUP BY run, subject"),
        "a5_distinct_items": _with(SCORED, f"SELECT run, {_COUNTS} FROM scored GROUP BY run"),
        "a6_result_record": _with(
            f"{SCORED}, {tuned}, {record.format(t='flagged')}",
            "SELECT 'generate' AS metric, overall.acc AS overall_acc, n, subject, per.acc FROM per, overall",
        ),
        "a6_result_rows": "WITH f AS (SELECT value < 50 AS correct, user_id::VARCHAR AS subject FROM events),"
        f" {record.format(t='f')} SELECT 'generate' AS metric, overall.acc::DOUBLE AS overall_acc, n, subject, per.acc FROM per, overall",
        "a7_mean_loss": _with(
            f"{STEP_LOG}, {_BOUNDARY}",
            "SELECT run, round(avg(loss), 9) AS train_loss, count(*)::BIGINT AS train_steps FROM step_loss GROUP BY run",
        ),
        "a7_mean_loss_all_micro": _with(
            f"{STEP_LOG}, s AS (SELECT run, step, avg(loss) AS loss FROM step_log GROUP BY run, step)",
            "SELECT run, round(avg(loss), 9) AS train_loss, count(*)::BIGINT AS train_steps FROM s GROUP BY run",
        ),
        "a8_last_evaluation": "SELECT event_type AS run, max(event_id) AS last_step,"
        " arg_max(value, event_id) AS last_first_token_acc, arg_max(user_id, event_id) AS last_eval_samples"
        " FROM events GROUP BY event_type",
        "a8_train_record": _with(
            f"{STEP_LOG}, {_BOUNDARY},"
            " l AS (SELECT run, round(avg(loss), 9) AS train_loss, count(*)::BIGINT AS train_steps FROM step_loss GROUP BY run),"
            " e AS (SELECT event_type AS run, count(*)::BIGINT AS train_samples,"
            " arg_max(value, event_id) AS last_first_token_acc, arg_max(user_id, event_id) AS last_eval_samples"
            " FROM events GROUP BY event_type)",
            "SELECT run, train_loss, train_steps, train_samples, last_first_token_acc, last_eval_samples FROM l JOIN e USING (run)",
        ),
        "a9_interval_loss": _with(
            STEP_LOG,
            "SELECT run, (step - 1) // 10 AS interval, round(avg(loss), 9) AS loss, count(*)::BIGINT AS records"
            " FROM step_log GROUP BY 1, 2",
        ),
        "w1_latest_checkpoint": "SELECT user_id::VARCHAR AS run, max(event_id) AS step,"
        " 'out/' || user_id || '/checkpoint-' || max(event_id) AS path FROM events GROUP BY user_id",
        "w2_kept_checkpoints": _with(
            "r AS (SELECT user_id, event_id AS step, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events)",
            "SELECT user_id::VARCHAR AS run, 'out/' || user_id || '/checkpoint-' || step AS path, step, age FROM r WHERE age <= 2",
        ),
        "t1_prepare_stream": _with(
            _tokens(1024), f"SELECT item_id, {_digest('ids')}, {_digest('labels', 'labels')} FROM tokens"
        ),
        "t2_running_accuracy": _with(_ARRIVED, per_subject),
        "t2_interval_accuracy": _with(
            _ARRIVED,
            "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, subject,"
            f" {_COUNTS} FROM flagged WHERE date_trunc('hour', ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM flagged) GROUP BY 1, 2",
        ),
        "t2_first_arrivals": _with(
            f"{_ARRIVED}, {_EARLIEST}",
            "SELECT item_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, pred, correct FROM earliest",
        ),
        "t2_deduplicated_accuracy": _with(
            f"{_ARRIVED}, {_EARLIEST}", f"SELECT subject, {_COUNTS} FROM earliest GROUP BY subject"
        ),
        "j1_awaited_outputs": "WITH e AS (SELECT *, substr('ABCD', (event_id // 2 % 4)::INT + 1, 1) AS letter FROM events),"
        " asked AS (SELECT * FROM e WHERE event_id % 2 = 0), outputs AS (SELECT * FROM e WHERE event_id % 2 = 1),"
        " mark AS (SELECT least((SELECT max(ts) FROM asked), (SELECT max(ts) FROM outputs)) - INTERVAL 2 HOUR AS mark)"
        " SELECT a.user_id AS item_id, strftime(a.ts, '%Y-%m-%d %H:%M:%S.%f') AS asked_at, strftime(o.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,"
        " a.letter AS gold, a.event_type AS subject, o.letter AS pred, coalesce(o.letter = a.letter, false) AS correct"
        " FROM asked a LEFT JOIN outputs o ON o.user_id = a.user_id AND o.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY, mark"
        " WHERE o.ts IS NOT NULL OR a.ts + INTERVAL 1 DAY < mark",
        "t3_running_loss": "SELECT event_type AS run, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start,"
        " round(avg(value), 9) AS loss, count(*)::BIGINT AS records FROM events"
        " WHERE date_trunc('hour', ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events) GROUP BY 1, 2",
        "u1_tokenizer_plugin": f"SELECT item_id, {_digest('ids')}, text_md5 FROM"
        f" (SELECT doc_id AS item_id, {_bytes('text')} AS ids, md5(text) AS text_md5 FROM documents)",
        "u2_text_predictor": _with(PROMPTS, f"SELECT item_id, 'Answer: ' || {_PICK} AS output_text FROM prompts"),
        "u2_numeric_predictor": "SELECT vec_id AS item_id,"
        " (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings",
        "u3_metric_by_name": _with(
            f"{_first_token(1024)}, g AS (SELECT {_PICK} = gold AS correct FROM prompts)",
            "SELECT 'generate' AS metric, (count(*) FILTER (correct) / count(*))::DOUBLE AS overall_acc,"
            " count(*)::BIGINT AS n FROM g UNION ALL"
            " SELECT 'first_token', (count(*) FILTER (correct) / count(*))::DOUBLE, count(*)::BIGINT FROM flagged",
        ),
        "e1_prepare_sft": _with(
            _tokens(SHORT),
            f"SELECT item_id, subject, {_digest('ids')}, {_digest('mask', 'mask')}, {_digest('labels', 'labels')},"
            " false AS prefix_mismatch FROM tokens",
        ),
        "e2_generated_text": _with(_GENERATED, per_subject),
        "e2_generated_ids": _with(
            f"{_GENERATED}, {record.format(t='flagged')}",
            "SELECT 'generate' AS metric, overall.acc AS overall_acc, n, subject, per.acc FROM per, overall",
        ),
        "e2_stored_outputs": _with(f"{SCORED}, {tuned}", per_subject),
        "e3_first_token": _with(_first_token(SHORT), per_subject),
        "e3_first_token_batched": _with(_first_token(SHORT), per_subject),
    }
