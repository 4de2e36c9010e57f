r"""DuckDB equivalents of the registered queries.

Regular expressions here are RE2: word borders are written out, since ``\b``
is ASCII-only there, and applied twice where two matches may share a border.
"""

from __future__ import annotations

from hearth import constants as C
from hearth.functions.overlap import IRREGULAR, STEP2, STEP3, STEP4

BLANK = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LEXICON = ["idiot", "moron", "clown", "worthless"]


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def with_ctes(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


# ---- text ----------------------------------------------------------------------


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def word(w: str, border: str = r"[^\p{L}\p{N}_]") -> str:
    return f"(^|{border}){w}($|{border})"


def clean(x: str) -> str:
    x = f"replace(coalesce({x}, ''), chr(0), '')"
    for artefact, mark in C.ARTEFACTS.items():
        x = f"replace({x}, {quoted(artefact)}, {quoted(mark)})"
    for wrong, right in C.TYPOS.items():
        for _ in range(2):
            x = rf"regexp_replace({x}, '{word(wrong)}', '\1{right}\2', 'gi')"
    return f"trim(regexp_replace({x}, '[{BLANK}]+', ' ', 'g'))"


def synonym(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {x} END"


def taxonomy(x: str, table: dict[str, str]) -> str:
    return f"CASE WHEN {synonym(x, table)} IN {in_list(C.TAXONOMY)} THEN {synonym(x, table)} ELSE 'neutral' END"


def token(x: str) -> str:
    return f"regexp_extract(coalesce({x}, ''), '[^{BLANK}]+', 0)"


def corpus_label(x: str) -> str:
    return taxonomy(f"lower(split_part({clean(x)}, ' ', 1))", C.CORPUS_SYNONYMS)


def model_label(x: str) -> str:
    edge = r"""[.,!?;:"''()\[\]{}]+"""
    t = f"regexp_replace(lower({token(x)}), '^{edge}|{edge}$', '', 'g')"
    return f"CASE WHEN {t} IN {in_list(C.TAXONOMY)} THEN {t} ELSE {taxonomy(t, C.MODEL_SYNONYMS)} END"


def unlabelled(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    rest = f"array_to_string(list_filter(regexp_split_to_array({s}, '[{BLANK}]+'), lambda w: w <> '')[2:], ' ')"
    return f"CASE WHEN lower({token(x)}) IN {in_list(C.TAXONOMY)} THEN {rest} ELSE {s} END"


def dialogue_text() -> str:
    return strip(f"({unlabelled('context')}) || {quoted(C.PART_SEPARATOR)} || utterance")


def cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


# ---- views ------------------------------------------------------------------------

RAW = """raw AS (
  SELECT doc_id,
    CASE doc_id % 5 WHEN 0 THEN 'Sad ' || source WHEN 1 THEN 'joy ' || source WHEN 2 THEN source WHEN 4 THEN 'terrified' END AS context,
    '  ' || replace(replace(text, '. ', '_comma_ '), 'the ', 'loosing ') || chr(160) || 'Embarassed' AS utterance,
    CASE doc_id % 6 WHEN 0 THEN 'Sad ' WHEN 1 THEN 'happiness' WHEN 2 THEN 'sad,' WHEN 4 THEN 'embarassed' WHEN 5 THEN 'grief' END AS emotion
  FROM documents)"""

CLEANED = f"""cleaned AS (
  SELECT text, emotion FROM (SELECT substr({clean(dialogue_text())}, 1, 1200) AS text, {corpus_label('emotion')} AS emotion FROM raw)
  WHERE text <> '')"""

TURNS = """turns AS (
  SELECT conv_id || '_' || turn AS turn_id, (conv_id % 20)::VARCHAR AS user_id, conv_id::VARCHAR AS conversation_id,
    text AS user_message, CASE WHEN next_role = 'assistant' THEN next_text END AS bot_response,
    CASE conv_id % 3 WHEN 0 THEN 'sad' WHEN 1 THEN '' END AS emotion,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id::INTEGER) + to_minutes(turn::INTEGER) AS created_at, conv_id, turn
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user')"""

MESSAGES = """messages AS (
  SELECT c_custkey AS message_id, (c_custkey % 20)::VARCHAR AS user_id,
    CASE c_custkey % 10 WHEN 0 THEN 'Hi! My name is ' || p_name || '.' WHEN 1 THEN 'I live in ' || lower(r_name) || ', near the coast.'
      WHEN 2 THEN 'I work as ' || lower(c_mktsegment) || ' clerk.' WHEN 3 THEN 'I am ' || (20 + c_custkey % 60) || ' years old.'
      WHEN 4 THEN 'I love ' || p_name || '!' WHEN 5 THEN 'my wife is named Eve.'
      WHEN 6 THEN 'I studied ' || lower(p_type) || '. I can swim' WHEN 7 THEN 'I am sad today' WHEN 8 THEN '   '
      ELSE 'Nothing to report' END AS user_message,
    TIMESTAMP '2024-01-01 00:00:30' + to_minutes(c_custkey::INTEGER) AS created_at
  FROM customer JOIN part ON p_partkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def facts(x: str) -> str:
    lists = []
    for kind, pattern, sentence in C.FACT_PATTERNS:
        head, slot, tail = sentence.partition("{0}")
        p = quoted("(?i)" + pattern)
        if kind == "taste":
            things, verbs = f"regexp_extract_all({x}, {p}, 2)", f"regexp_extract_all({x}, {p}, 1)"
            lists.append(
                f"list_transform(range(1, len({things}) + 1), lambda i: 'User ' || {verbs}[i] || ' ' || trim({things}[i]))"
            )
        elif slot:
            lists.append(f"list_transform(regexp_extract_all({x}, {p}, 1), lambda v: {quoted(head)} || trim(v) || {quoted(tail)})")
        else:
            lists.append(f"list_transform(regexp_extract_all({x}, {p}, 1), lambda v: {quoted(head)})")
    joined = lists[0]
    for part in lists[1:]:
        joined = f"list_concat({joined}, {part})"
    return f"list_sort(list_distinct(list_filter({joined}, lambda f: length(f) > 5)))"


STAMP = "strftime(created_at, '%Y%m%d%H%M%S%f')"
SECONDS = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"

TURN_RECORDS = f"""turn_records AS (
  SELECT user_id || '_' || {STAMP} AS id, user_id, conversation_id, '{C.TURN}' AS type,
    'User said: ' || user_message || CASE WHEN coalesce(bot_response, '') <> '' THEN chr(10) || 'Assistant responded: ' || bot_response ELSE '' END AS document,
    substr(user_message, 1, 1000) AS user_message, substr(coalesce(bot_response, ''), 1, 1000) AS bot_response,
    CASE WHEN coalesce(emotion, '') = '' THEN 'unknown' ELSE emotion END AS emotion, created_at, user_message AS embed_text
  FROM turns WHERE {strip('user_message')} <> '')"""

FACT_RECORDS = f"""found AS (SELECT user_id, created_at, unnest({facts('user_message')}) AS fact FROM messages),
fact_records AS (
  SELECT user_id || '_fact_' || {STAMP} || '_' || substr(md5(fact), 1, 12) AS id, user_id, NULL::VARCHAR AS conversation_id,
    '{C.FACT}' AS type, fact AS document, NULL::VARCHAR AS user_message, NULL::VARCHAR AS bot_response, NULL::VARCHAR AS emotion,
    created_at, fact AS embed_text
  FROM found)"""

MEMORY = "memory AS (SELECT * FROM turn_records UNION ALL SELECT * FROM fact_records)"
MEMORY_ALL = [TURNS, MESSAGES, TURN_RECORDS, FACT_RECORDS, MEMORY]

LISTING = f"""CASE WHEN type = '{C.FACT}' THEN '{C.FACT_ICON}' || document
  WHEN user_message <> '' THEN '{C.TURN_ICON}' || substr(user_message, 1, 50) || '...' END"""

PAIRS = """pairs AS (
  SELECT turn_id AS row_id, replace(replace(replace(replace(bot_response, ' the ', ' a '), ' la ', ' une '), ' die ', ' eine '), ' en ', ' ') AS pred,
    bot_response AS ref
  FROM turns WHERE bot_response IS NOT NULL)"""

SCORED = """scored AS (
  SELECT d.doc_id, d.text, (0.6 * toxic + 0.2 * quality)::DOUBLE AS toxicity, ((d.doc_id % 10) / 10.0)::DOUBLE AS insult
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

EMOTIONS = """emotions AS (
  SELECT gold, CASE WHEN doc_id % 7 = 0 THEN 'neutral' WHEN doc_id % 5 = 0 THEN 'sad' ELSE gold END AS pred
  FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'sad' WHEN 1 THEN 'joyful' WHEN 2 THEN 'angry' ELSE 'lonely' END AS gold FROM documents))"""

LEXICON_HIT = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(text), '{word(w)}') THEN {quoted(w)}" for w in LEXICON
) + " ELSE '' END"


# ---- vectors --------------------------------------------------------------------------


def embedded(name: str, source: str, text: str, prefix: str, keep: str) -> str:
    return f"""{name} AS (
  SELECT {keep}, list_transform(c, lambda x: (x / CASE WHEN n > 0 THEN n ELSE 1 END)::FLOAT) AS embedding
  FROM (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n
  FROM (SELECT *, list_transform(range(64), lambda d: len(list_filter(b, lambda y: y = d))::DOUBLE) AS c
  FROM (SELECT *, list_transform(list_filter(regexp_split_to_array(lower('{prefix}' || {text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''),
      lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64) AS b FROM {source}))))"""


def shown(vector: str) -> str:
    return f"array_to_string(list_transform({vector}, lambda x: printf('%.5f', x::DOUBLE)), ' ')"


def top(queries: str, points: str, k: int, condition: str = "TRUE") -> str:
    """Subquery ``(query_id, id, distance, rank)``; both sides have ``id, embedding``."""
    return f"""(SELECT query_id, id, distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank
  FROM (SELECT q.id AS query_id, p.id AS id, round(pow(list_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 2), 6) AS distance
        FROM {queries} q JOIN {points} p ON {condition})) WHERE rank <= {k})"""


VECTORS = "vectors AS (SELECT vec_id AS id, embedding, vec_id % 20 AS user_id FROM embeddings)"
DOC_VECTORS = embedded("doc_vectors", "documents", "text", C.PASSAGE_PREFIX, "doc_id AS id, text AS document")
ASKED = f"""asked AS (
  SELECT user_id || '_' || {STAMP} AS id, user_id, user_message, bot_response, CASE WHEN emotion <> '' THEN emotion END AS emotion,
    conv_id % 2 = 0 AS use_filter, created_at FROM turns)"""
ASKED_VECTORS = embedded("asked_vectors", "asked", "user_message", C.QUERY_PREFIX, "*")
ASKED_VECTORS = ASKED_VECTORS.replace("SELECT *, list_transform(c,", "SELECT * EXCLUDE (b, c, n), list_transform(c,")
MEMORY_VECTORS = embedded(
    "memory_vectors", "memory", "embed_text", C.QUERY_PREFIX,
    "id, user_id, type, document, user_message, bot_response, emotion, created_at",
)
CONTEXTS = f"""contexts AS MATERIALIZED (
  SELECT h.query_id, h.rank, h.id, h.distance, d.document FROM {top('asked_vectors', 'doc_vectors', 5)} h JOIN doc_vectors d ON d.id = h.id)"""
HITS = f"""hits AS MATERIALIZED (
  SELECT h.*, round(1 - h.distance, 6) AS relevance, m.document AS content, m.type, m.user_message, m.bot_response, m.emotion
  FROM {top('asked_vectors', 'memory_vectors', 10, 'q.user_id = p.user_id AND p.created_at < q.created_at')} h JOIN memory_vectors m ON m.id = h.id)"""
PLACED = """placed AS (
  SELECT *, count(*) FILTER (type = 'extracted_fact' AND place <= 4) OVER (PARTITION BY query_id) AS used
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY rank) AS place FROM hits)),
lines AS (
  SELECT *, (CASE WHEN type = 'extracted_fact' THEN place ELSE used + place END)::INTEGER AS slot FROM placed
  WHERE CASE WHEN type = 'extracted_fact' THEN place <= 4 ELSE place <= 8 - used END)"""
BLOCKS = f"""blocks AS (
  SELECT query_id, {quoted(C.MEMORY_HEADER)} || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY slot), '') AS memory_block
  FROM (SELECT query_id, slot, CASE WHEN type = 'extracted_fact' THEN '- ' || content
      WHEN user_message <> '' THEN '- Previously you said: "' || {cut('user_message', 100)} || '"' ||
        CASE WHEN bot_response <> '' THEN chr(10) || '  I responded: "' || {cut('bot_response', 80)} || '"' ELSE '' END END AS line
    FROM lines) GROUP BY query_id)"""
HITS_ALL = [*MEMORY_ALL, ASKED, ASKED_VECTORS, MEMORY_VECTORS, HITS]
BLOCKS_ALL = [*HITS_ALL, PLACED, BLOCKS]


def prompt(safety: str) -> str:
    return (
        f"{quoted(C.SYSTEM_TEXT + chr(10))} || CASE WHEN {safety} THEN {quoted(C.SAFETY_ON_TEXT)} ELSE {quoted(C.SAFETY_OFF_TEXT)} END"
        f" || {quoted(C.PROMPT_EMOTION)} || coalesce(emotion, 'unknown') || {quoted(C.PROMPT_CONTEXT)}"
        f" || coalesce(bullets, {quoted(C.NO_CONTEXT)}) || {quoted(C.PROMPT_MESSAGE)} || user_message || {quoted(chr(10) + C.CLOSING_TEXT)}"
    )


def bullets(source: str) -> str:
    return f"""bullets AS (SELECT query_id, string_agg('- ' || document, chr(10) ORDER BY rank) AS bullets FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM ({source})) WHERE place <= 3 GROUP BY query_id)"""


BULLETS = bullets("SELECT query_id, 0 AS rank, memory_block AS document FROM blocks UNION ALL SELECT query_id, rank, document FROM contexts")
PROMPTS_ALL = [*BLOCKS_ALL, DOC_VECTORS, CONTEXTS, BULLETS]


def fallback(emotion: str, reason: str) -> str:
    return (
        f"{quoted(C.FALLBACK_OPENING)} || CASE WHEN {reason} <> '' THEN ' (fallback: ' || {reason} || ')' ELSE '' END"
        f" || {quoted(C.FALLBACK_MIDDLE)} || CASE WHEN coalesce({emotion}, '') = '' THEN {quoted(C.FALLBACK_LABEL)} ELSE {emotion} END"
        f" || {quoted(C.FALLBACK_CLOSING)}"
    )


# ---- metrics ----------------------------------------------------------------------------


def tokens_13a(x: str) -> str:
    x = f"regexp_replace({x}, '[{BLANK}]+$', '')"
    for mark, into in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"),
                       ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        x = f"replace({x}, {mark}, {into})"
    x = f"' ' || {x} || ' '"
    for rule, into in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                       (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, '{rule}', '{into}', 'g')"
    return f"list_filter(regexp_split_to_array({x}, '[{BLANK}]+'), lambda w: w <> '')"


BLEU_BODY = """SELECT 'bleu' AS metric, round(CASE WHEN m1 + m2 + m3 + m4 = 0 OR least(t1, t2, t3, t4) = 0 THEN 0 ELSE
    100 * bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) END, 6) AS bleu, round(bp, 6) AS brevity_penalty,
    t1::DOUBLE AS sys_len, ref_len::DOUBLE AS ref_len, (SELECT count(*) FROM pairs) AS samples, 0::BIGINT AS fallback_responses
  FROM (SELECT *, CASE WHEN t1 >= ref_len THEN 1 WHEN t1 > 0 THEN exp(1 - ref_len / t1) ELSE 0 END AS bp,
    CASE WHEN m1 > 0 THEN m1 / t1 ELSE 1 / (pow(2, (m1 = 0)::INT) * t1) END AS p1,
    CASE WHEN m2 > 0 THEN m2 / t2 ELSE 1 / (pow(2, (m1 = 0)::INT + (m2 = 0)::INT) * t2) END AS p2,
    CASE WHEN m3 > 0 THEN m3 / t3 ELSE 1 / (pow(2, (m1 = 0)::INT + (m2 = 0)::INT + (m3 = 0)::INT) * t3) END AS p3,
    CASE WHEN m4 > 0 THEN m4 / t4 ELSE 1 / (pow(2, (m1 = 0)::INT + (m2 = 0)::INT + (m3 = 0)::INT + (m4 = 0)::INT) * t4) END AS p4
  FROM sums)"""
BLEU_CTES = [
    f"toks AS (SELECT row_id, 'p' AS side, {tokens_13a('pred')} AS t FROM pairs UNION ALL SELECT row_id, 'r', {tokens_13a('ref')} FROM pairs)",
    """grams AS (SELECT row_id, side, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS g
      FROM toks, (SELECT unnest([1, 2, 3, 4]) AS n))""",
    "counts AS (SELECT row_id, n, g, count(*) FILTER (side = 'p') AS cp, count(*) FILTER (side = 'r') AS cr FROM grams GROUP BY ALL)",
    "sums AS (SELECT " + ", ".join(
        f"sum(least(cp, cr)) FILTER (n = {n}) AS m{n}, sum(cp) FILTER (n = {n}) AS t{n}" for n in (1, 2, 3, 4)
    ) + ", sum(cr) FILTER (n = 1) AS ref_len FROM counts)",
]
BLEU = with_ctes(BLEU_BODY, TURNS, PAIRS, *BLEU_CTES)

ROUGE_BODY = """SELECT 'rougeL' AS metric, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS rougeL_f1,
    round(avg(p), 6) AS rougeL_precision, round(avg(r), 6) AS rougeL_recall, count(*) AS samples, 0::BIGINT AS fallback_responses
  FROM (SELECT CASE WHEN len(a) > 0 THEN l / len(a) ELSE 0 END AS p, CASE WHEN len(b) > 0 THEN l / len(b) ELSE 0 END AS r FROM lcs)"""
ROUGE_CTES = [
    """words AS (SELECT list_filter(regexp_split_to_array(lower(pred), '[^a-z0-9]+'), lambda w: w <> '') AS a,
      list_filter(regexp_split_to_array(lower(ref), '[^a-z0-9]+'), lambda w: w <> '') AS b FROM pairs)""",
    """coded AS (SELECT a, b, list_transform(a, lambda w: [coalesce(list_position(b, w), 0)]) AS ca,
      list_transform(b, lambda w: list_position(b, w)) AS cb, list_transform(range(1, len(b) + 1), lambda j: [j::INTEGER]) AS js FROM words)""",
    """lcs AS (SELECT a, b, list_reduce(ca, lambda prev, x: list_reduce(js, lambda acc, e:
        list_append(acc, greatest(acc[e[1]], prev[e[1] + 1], CASE WHEN cb[e[1]] = x[1] THEN prev[e[1]] + 1 ELSE 0 END)::INTEGER), [0::INTEGER]),
        list_transform(range(len(b) + 1), lambda i: 0::INTEGER))[len(b) + 1] AS l FROM coded)""",
]
ROUGE = with_ctes(ROUGE_BODY, TURNS, PAIRS, *ROUGE_CTES)


def shape(x: str) -> str:
    """One letter per character of a word: v for a vowel, c for a consonant; each round settles two of a run of y."""
    consonants = "bcdfghjklmnpqrstvwxz0123456789"
    x = f"translate({x}, '{consonants}aeiou', '{'c' * len(consonants)}vvvvv')"
    for _ in range(4):
        x = rf"replace(regexp_replace({x}, '(^|v)y', '\1c', 'g'), 'cy', 'cv')"
    return x


def measure(x: str) -> str:
    return f"len(regexp_extract_all({shape(x)}, 'v+c+'))"


def ends_cvc(x: str) -> str:
    return f"((length({x}) > 2 AND {shape(x)} LIKE '%cvc' AND right({x}, 1) NOT IN ('w', 'x', 'y')) OR {shape(x)} = 'vc')"


def without(x: str, n: int) -> str:
    return f"left({x}, -{n})"


def swapped(table: list[tuple[str, str]], first: str = "") -> str:
    """The first suffix of the table that a word has, exchanged where a syllable stays before it."""
    found = [f"WHEN w LIKE '%{old}' THEN CASE WHEN {measure(without('w', len(old)))} > 0 THEN {without('w', len(old))} || '{new}' ELSE w END" for old, new in table]
    return f"CASE {first} {' '.join(found)} ELSE w END"


def stemming(source: str) -> list[str]:
    """``stems`` (token, w): the Porter stems of the distinct tokens of ``source``, a rule after the other; irregular and short ones stay out of the rules."""
    irregular = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in IRREGULAR.items())
    double = f"length(w) > 1 AND right(w, 1) = substr(w, -2, 1) AND right({shape('w')}, 1) = 'c'"
    dropped = [f"WHEN w LIKE '%{s}' THEN CASE WHEN {measure(without('w', len(s)))} > 1"
               + (f" AND right({without('w', len(s))}, 1) IN ('s', 't')" if s == "ion" else "") + f" THEN {without('w', len(s))} ELSE w END" for s in STEP4]
    vowel = f"contains({shape(without('w', 2))}, 'v')", f"contains({shape(without('w', 3))}, 'v')"
    rules = [
        f"CASE WHEN w LIKE '%ies' AND length(w) = 4 THEN {without('w', 1)} WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {without('w', 2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {without('w', 1)} ELSE w END",
        # a mark shows where -ed or -ing went
        f"""CASE WHEN w LIKE '%ied' THEN CASE WHEN length(w) = 4 THEN {without('w', 1)} ELSE {without('w', 2)} END
          WHEN w LIKE '%eed' THEN CASE WHEN {measure(without('w', 3))} > 0 THEN {without('w', 1)} ELSE w END
          WHEN w LIKE '%ed' AND {vowel[0]} THEN '+' || {without('w', 2)} WHEN w LIKE '%ing' AND {vowel[1]} THEN '+' || {without('w', 3)} ELSE w END""",
    ]
    stages = ["distinct_tokens AS (SELECT DISTINCT token, token AS w FROM " + source + f" WHERE length(token) > 3 AND token NOT IN {in_list(IRREGULAR)})"]
    after = f"""CASE WHEN NOT cut THEN w WHEN right(w, 2) IN ('at', 'bl', 'iz') THEN w || 'e'
          WHEN {double} THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN w ELSE {without('w', 1)} END
          WHEN {measure('w')} = 1 AND {ends_cvc('w')} THEN w || 'e' ELSE w END"""
    logi = f"WHEN w LIKE '%logi' THEN CASE WHEN {measure(without('w', 3))} > 0 THEN {without('w', 1)} ELSE w END"
    rules += [
        after,
        f"CASE WHEN w LIKE '%y' AND length(w) > 2 AND right({shape(without('w', 1))}, 1) = 'c' THEN {without('w', 1)} || 'i' ELSE w END",
        f"CASE WHEN w LIKE '%alli' AND {measure(without('w', 4))} > 0 THEN {without('w', 2)} ELSE w END",
        swapped(STEP2, logi),
        swapped(STEP3),
        f"CASE {' '.join(dropped)} ELSE w END",
        f"CASE WHEN w LIKE '%e' AND ({measure(without('w', 1))} > 1 OR ({measure(without('w', 1))} = 1 AND NOT {ends_cvc(without('w', 1))})) THEN {without('w', 1)} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {measure(without('w', 1))} > 1 THEN {without('w', 1)} ELSE w END",
    ]
    previous = "distinct_tokens"
    for i, rule in enumerate(rules):
        inner = f"(SELECT token, ltrim(w, '+') AS w, w LIKE '+%' AS cut FROM {previous})" if rule is after else previous
        stages.append(f"stage_{i} AS MATERIALIZED (SELECT token, {rule} AS w FROM {inner})")
        previous = f"stage_{i}"
    others = f"SELECT DISTINCT token, CASE WHEN length(token) <= 3 THEN token ELSE CASE token {irregular} END END FROM {source} WHERE length(token) <= 3 OR token IN {in_list(IRREGULAR)}"
    return [*stages, f"stems AS MATERIALIZED (SELECT token, w FROM {previous} UNION ALL {others})"]


STEMMED_CTES = [
    ROUGE_CTES[0].replace("words AS (SELECT", "plain AS MATERIALIZED (SELECT row_id,"),
    "tokens AS MATERIALIZED (SELECT row_id, side, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM (SELECT row_id, 'a' AS side, a AS ws FROM plain UNION ALL SELECT row_id, 'b', b FROM plain))",
    *stemming("tokens"),
    "sides AS (SELECT row_id, list(w ORDER BY pos) FILTER (side = 'a') AS a, list(w ORDER BY pos) FILTER (side = 'b') AS b FROM tokens JOIN stems USING (token) GROUP BY row_id)",
    "words AS (SELECT coalesce(s.a, []) AS a, coalesce(s.b, []) AS b FROM plain LEFT JOIN sides s USING (row_id))",
    *ROUGE_CTES[1:],
]
ROUGE_STEMMED = with_ctes(ROUGE_BODY, TURNS, PAIRS, *STEMMED_CTES)

GREEDY = with_ctes(
    """SELECT 'bertscore' AS metric, round(avg(p), 6) AS bertscore_precision, round(avg(r), 6) AS bertscore_recall,
    round(avg(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS bertscore_f1, count(*) AS samples, count(*) FILTER (row_id % 7 = 0) AS fallback_responses, 'hashed' AS model_type
  FROM (SELECT ids.row_id, coalesce(p, 0) AS p, coalesce(r, 0) AS r FROM (SELECT DISTINCT row_id FROM tok) ids
    LEFT JOIN (SELECT row_id, avg(m) AS p FROM (SELECT row_id, a, max(s) AS m FROM sims GROUP BY ALL) GROUP BY row_id) USING (row_id)
    LEFT JOIN (SELECT row_id, avg(m) AS r FROM (SELECT row_id, b, max(s) AS m FROM sims GROUP BY ALL) GROUP BY row_id) USING (row_id))""",
    "tok AS (SELECT vec_id // 20 AS row_id, vec_id AS pos, vec_id % 2 = 0 AS cand, embedding::DOUBLE[] AS v FROM embeddings)",
    "sims AS (SELECT c.row_id, c.pos AS a, r.pos AS b, list_dot_product(c.v, r.v) AS s FROM tok c JOIN tok r ON c.row_id = r.row_id AND c.cand AND NOT r.cand)",
)

ALIGNMENT_BODY = """SELECT 'emotion_alignment' AS metric, round((SELECT avg((gold = pred)::INT) FROM emotions), 6) AS accuracy,
    round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro,
    round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1_macro, (SELECT count(*) FROM emotions) AS samples
  FROM (SELECT label, coalesce(tp / nullif(n_pred, 0), 0) AS p, coalesce(tp / nullif(n_gold, 0), 0) AS r FROM (
    SELECT label, (SELECT count(*) FROM emotions WHERE gold = label AND pred = label) AS tp,
      (SELECT count(*) FROM emotions WHERE gold = label) AS n_gold, (SELECT count(*) FROM emotions WHERE pred = label) AS n_pred
    FROM (SELECT gold AS label FROM emotions UNION SELECT pred FROM emotions)))"""
ALIGNMENT = with_ctes(ALIGNMENT_BODY, EMOTIONS)

TOXICITY = with_ctes(
    """SELECT 'toxicity' AS metric, round(avg(raw), 6) AS avg_toxicity_raw, round(avg(post), 6) AS avg_toxicity_post,
    round(avg(raw) - avg(post), 6) AS absolute_reduction,
    round(CASE WHEN avg(raw) > 0 THEN (avg(raw) - avg(post)) / avg(raw) * 100 ELSE 0 END, 6) AS percent_reduction, count(*) AS samples,
    count(*) FILTER (raw >= 0.5) AS toxic_raw_count, count(*) FILTER (post >= 0.5) AS toxic_post_count, 0::BIGINT AS fallback_responses, TRUE AS filter_applied
  FROM (SELECT raw, CASE WHEN raw >= 0.5 THEN 0.0::DOUBLE ELSE raw END AS post FROM (SELECT greatest(toxicity, insult) AS raw FROM scored))""",
    SCORED,
)

STREAMED = f"""all_facts AS (
  SELECT user_id, created_at, unnest({facts('user_message')}) AS fact FROM (
    SELECT user_id, created_at, user_message FROM messages UNION ALL SELECT user_id, created_at, user_message FROM turns)),
spoken AS (
  SELECT user_id, created_at, user_message, bot_response FROM turns
  UNION ALL SELECT user_id, created_at, user_message, NULL FROM messages WHERE {strip('user_message')} <> ''),
repeated AS (
  SELECT user_id || '_' || {STAMP} AS id, user_id, '{C.TURN}' AS type,
    'User said: ' || user_message || CASE WHEN coalesce(bot_response, '') <> '' THEN chr(10) || 'Assistant responded: ' || bot_response ELSE '' END AS document,
    created_at FROM spoken
  UNION ALL SELECT user_id || '_fact_' || {STAMP} || '_' || substr(md5(fact), 1, 12), user_id, '{C.FACT}', fact, created_at FROM all_facts)"""

# ---- requests ----------------------------------------------------------------------------------

BODIES = f"""parsed AS (
  SELECT turn_id, conv_id % 7 AS kind, conv_id, user_message, user_id, conversation_id FROM turns)"""

REPLY = "CASE WHEN {given} THEN trim(bot_response) ELSE " + fallback("emotion", quoted("generation disabled")) + " END"
REPLY_HIT = LEXICON_HIT.replace("text", "reply")

TOLD = f"""lists AS (SELECT query_id, list(document ORDER BY rank) AS context FROM (
    SELECT query_id, 0 AS rank, memory_block AS document FROM blocks UNION ALL SELECT query_id, rank, document FROM contexts) GROUP BY query_id),
told AS (SELECT *, CASE WHEN use_filter THEN {REPLY_HIT} ELSE '' END AS word FROM (
  SELECT a.id AS query_id, a.user_id, a.emotion, a.use_filter, context, coalesce(n, 0)::INTEGER AS memories_used, bot_response IS NULL AS used_fallback,
    {REPLY.format(given='bot_response IS NOT NULL')} AS reply, md5({prompt('use_filter')}) AS prompt_md5
  FROM asked a LEFT JOIN bullets b ON b.query_id = a.id LEFT JOIN lists l ON l.query_id = a.id
  LEFT JOIN (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id) h ON h.query_id = a.id))"""

RESULT_JSON = with_ctes(
    f"""SELECT query_id, json_object('emotion', emotion, 'response', CASE WHEN word <> '' THEN {quoted(C.REFUSAL)} ELSE reply END,
      'toxic', word <> '', 'toxicity_scores', CASE WHEN word <> '' THEN json_object(word, 1.0::DOUBLE) ELSE json('{{}}') END,
      'context', context, 'use_filter', use_filter, 'using_fallback', used_fallback, 'llm_enabled', NOT used_fallback,
      'llm_error', CASE WHEN used_fallback THEN 'generation disabled' END, 'llm_model', NULL, 'llm_candidates', NULL,
      'filter_applied', use_filter AND word <> '', 'memories_used', memories_used,
      'conversation_saved', query_id IN (SELECT id FROM turn_records),
      'memory_stats', json_object('total', total, 'conversations', conversations, 'facts', facts))::VARCHAR AS body
    FROM told JOIN (SELECT user_id, count(*) AS total, count(*) FILTER (type = '{C.TURN}') AS conversations,
      count(*) FILTER (type = '{C.FACT}') AS facts FROM memory GROUP BY user_id) USING (user_id)""",
    *PROMPTS_ALL, TOLD,
)

EVALUATED = f"""SELECT id AS row_id, CASE WHEN word <> '' THEN {quoted(C.REFUSAL)} ELSE reply END AS pred, bot_response AS ref,
    NOT use_filter AS used_fallback, word <> '' AS toxic, prompt_md5
  FROM (SELECT *, {REPLY_HIT} AS word FROM (
    SELECT id, bot_response, use_filter, {REPLY.format(given='use_filter')} AS reply, md5({prompt('TRUE')}) AS prompt_md5
    FROM asked JOIN bullets ON query_id = id WHERE bot_response IS NOT NULL))"""
EVALUATED_ALL = [TURNS, ASKED, ASKED_VECTORS, DOC_VECTORS, CONTEXTS, bullets("SELECT query_id, rank, document FROM contexts")]

_LONG = {
    "bleu": ("bleu_report", ["bleu", "brevity_penalty", "sys_len", "ref_len", "samples"]),
    "rougeL": ("rouge_report", ["rougeL_f1", "rougeL_precision", "rougeL_recall", "samples"]),
    "toxicity": ("toxicity_report", [
        "avg_toxicity_raw", "avg_toxicity_post", "absolute_reduction", "percent_reduction", "samples", "toxic_raw_count", "toxic_post_count",
    ]),
}
REPORT = with_ctes(
    " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, '{name}' AS name, round({name}::DOUBLE, 6) AS value FROM {source}" for metric, (source, names) in _LONG.items() for name in names
    ) + " UNION ALL SELECT unnest(['bleu', 'rougeL', 'toxicity']), 'fallback_responses', (SELECT count(*) FILTER (used_fallback) FROM pairs)::DOUBLE",
    *EVALUATED_ALL, f"pairs AS MATERIALIZED ({EVALUATED})", *BLEU_CTES, *STEMMED_CTES,
    f"bleu_report AS MATERIALIZED ({BLEU_BODY})", f"rouge_report AS MATERIALIZED ({ROUGE_BODY})",
    """toxicity_report AS (SELECT avg(toxic::INT) AS avg_toxicity_raw, 0 AS avg_toxicity_post, avg(toxic::INT) AS absolute_reduction,
      CASE WHEN avg(toxic::INT) > 0 THEN 100 ELSE 0 END AS percent_reduction, count(*) AS samples, count(*) FILTER (toxic) AS toxic_raw_count, 0 AS toxic_post_count FROM pairs)""",
)

KNN = with_ctes(f"SELECT * FROM {top('vectors', 'vectors', 5, 'q.id <> p.id')}", VECTORS)

DERIVED = taxonomy(f"lower({token('context')})", C.CORPUS_SYNONYMS)

SPLIT_BODY = f"""SELECT *, CASE WHEN ('0x' || substr(md5(text || '‖' || emotion), 1, 8))::BIGINT % 10 = 0 THEN 'valid' ELSE 'train' END AS split
        FROM (SELECT DISTINCT {strip('text')} AS text, emotion FROM cleaned)"""


def bayes(asked: str) -> list[str]:
    """Multinomial naive Bayes with smoothing 1, fitted on the training split; ``guessed`` labels the distinct texts asked for."""
    return [
        f"split AS MATERIALIZED ({SPLIT_BODY})",
        r"worded AS MATERIALIZED (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM split)",
        "words AS MATERIALIZED (SELECT emotion, w, count(*) AS n FROM (SELECT emotion, unnest(ws) AS w FROM worded WHERE split = 'train') GROUP BY ALL)",
        "known AS (SELECT w FROM words GROUP BY w)",
        """classes AS MATERIALIZED (SELECT emotion, docs, ln(docs + 1) - ln(sum(docs) OVER () + count(*) OVER ()) AS prior, ln(coalesce(total, 0) + (SELECT count(*) FROM known)) AS norm
          FROM (SELECT emotion, count(*) AS docs FROM split WHERE split = 'train' GROUP BY emotion) LEFT JOIN (SELECT emotion, sum(n) AS total FROM words GROUP BY emotion) USING (emotion))""",
        f"asked AS MATERIALIZED (SELECT DISTINCT text, ws FROM worded WHERE {asked})",
        "asked_words AS MATERIALIZED (SELECT text, w, count(*) AS k FROM (SELECT text, unnest(ws) AS w FROM asked) SEMI JOIN known USING (w) GROUP BY ALL)",
        "sizes AS (SELECT text, sum(k) AS size FROM asked_words GROUP BY text)",
        "gains AS (SELECT text, emotion, sum(k * ln(n + 1)) AS gain FROM asked_words JOIN words USING (w) GROUP BY ALL)",
        """guessed AS MATERIALIZED (SELECT text, arg_max(emotion, place) AS predicted FROM (
          SELECT a.text, c.emotion, (round(prior - coalesce(size, 0) * norm + coalesce(gain, 0), 9), docs, -row_number() OVER (ORDER BY c.emotion)) AS place
          FROM asked a CROSS JOIN classes c LEFT JOIN sizes s ON s.text = a.text LEFT JOIN gains g ON g.text = a.text AND g.emotion = c.emotion) GROUP BY text)""",
    ]


ORACLE: dict[str, str] = {
    "scan_csv_tolerant": with_ctes("SELECT * FROM raw", RAW),
    "corpus_roundtrip": with_ctes("SELECT DISTINCT text, emotion FROM cleaned", RAW, CLEANED),
    "load_pairs_limited": with_ctes(
        f"""SELECT conv_id, turn, {strip('user_message')} AS text, {strip('bot_response')} AS response FROM (
          SELECT * FROM (SELECT * REPLACE (CASE WHEN conv_id % 9 = 0 THEN '  ' ELSE bot_response END AS bot_response) FROM turns)
          WHERE user_message NOT IN {in_list(C.MISSING_SPELLINGS)} AND bot_response NOT IN {in_list(C.MISSING_SPELLINGS)}
          ORDER BY conv_id, turn LIMIT 100) WHERE {strip('user_message')} <> '' AND {strip('bot_response')} <> ''""",
        TURNS,
    ),
    "collection_upsert": """SELECT id, CASE WHEN stored IS NOT NULL THEN stored ELSE offered END AS doc_id FROM (
      SELECT md5(text) AS id, min(doc_id) FILTER (lang = 'en') AS stored, max(doc_id) AS offered FROM documents GROUP BY ALL)""",
    "collection_append": """SELECT id, CASE WHEN first IS NOT NULL THEN '1' ELSE '2' END AS wave, coalesce(first, second) AS source, n_chars FROM (
      SELECT md5(text) AS id, min(source) FILTER (lang = 'en') AS first, min(source) AS second, length(any_value(text)) AS n_chars FROM documents GROUP BY md5(text))""",
    "collection_count": "SELECT count(*) AS size FROM documents",
    "metric_report_long": with_ctes(
        "SELECT 'metric' AS metric, metric AS value FROM a" + "".join(
            f" UNION ALL SELECT '{n}', {n}::VARCHAR FROM a" for n in ("accuracy", "precision_macro", "recall_macro", "f1_macro", "samples")
        ),
        f"a AS ({ALIGNMENT})",
    ),
    "chat_requests_parse": with_ctes(
        f"""SELECT turn_id, CASE WHEN kind IN (1, 2, 3) THEN '' ELSE {strip('user_message')} END AS message,
          CASE WHEN kind IN (1, 2) THEN FALSE WHEN kind IN (0, 3) THEN TRUE ELSE conv_id % 2 = 0 END AS use_filter,
          CASE WHEN kind = 2 THEN 'u' WHEN kind IN (0, 1, 3) THEN 'default' ELSE user_id END AS user_id,
          CASE WHEN kind < 4 THEN '' ELSE conversation_id END AS conversation_id,
          kind NOT IN (1, 2, 3) AND {strip('user_message')} <> '' AS accepted FROM parsed""",
        TURNS, BODIES,
    ),
    "chat_result_json": RESULT_JSON,
    "infer_text_column": with_ctes(f"SELECT doc_id, {dialogue_text()} AS text FROM raw", RAW),
    "infer_text_for_index": with_ctes("SELECT doc_id, coalesce(context, '') || ' ' || chr(10) || ' ' || utterance AS text FROM raw", RAW),
    "derive_emotion_label": with_ctes(f"SELECT doc_id, {DERIVED} AS emotion FROM raw", RAW),
    "strip_label_token": with_ctes(f"SELECT doc_id, {unlabelled('context')} AS context FROM raw", RAW),
    "clean_corpus": with_ctes("SELECT * FROM cleaned", RAW, CLEANED),
    "dedup_corpus": with_ctes("SELECT DISTINCT text, emotion FROM cleaned", RAW, CLEANED),
    "union_splits": with_ctes(
        "SELECT doc_id, context, NULL::VARCHAR AS utterance, NULL::VARCHAR AS emotion FROM raw UNION ALL SELECT doc_id, NULL, utterance, emotion FROM raw", RAW
    ),
    "taxonomy_filter": with_ctes(f"SELECT doc_id, lower(trim(emotion)) AS emotion FROM raw WHERE lower(trim(emotion)) IN {in_list(C.TAXONOMY)}", RAW),
    "synonym_join": with_ctes(
        f"SELECT doc_id, t AS token, {synonym('t', C.CORPUS_SYNONYMS)} AS canonical FROM (SELECT doc_id, CASE WHEN emotion IS NOT NULL THEN lower({token('emotion')}) END AS t FROM raw)", RAW
    ),
    "unmapped_labels": with_ctes(
        f"SELECT lower(trim(emotion)) AS label, count(*) AS rows FROM raw WHERE lower(trim(emotion)) NOT IN {in_list(C.TAXONOMY)} GROUP BY ALL", RAW
    ),
    "typo_audit": with_ctes(
        " UNION ALL ".join(
            f"""SELECT '{w}' AS typo, count(*) FILTER (regexp_matches(utterance, '(?i){word(w)}')) AS rows_before,
            count(*) FILTER (regexp_matches({clean('utterance')}, '(?i){word(w)}')) AS rows_after, count(*) AS rows FROM raw"""
            for w in C.TYPOS
        ),
        RAW,
    ),
    "label_distribution": with_ctes("SELECT emotion, count(*) AS rows FROM (SELECT DISTINCT text, emotion FROM cleaned) GROUP BY emotion", RAW, CLEANED),
    "dense_doc_ids": "SELECT 'doc-' || (row_number() OVER (ORDER BY doc_id) - 1) AS id, doc_id, n_chars FROM documents",
    "clean_text": with_ctes(f"SELECT doc_id, {clean('utterance')} AS text FROM raw", RAW),
    "normalize_emotion": with_ctes(f"SELECT doc_id, {corpus_label('emotion')} AS emotion FROM raw", RAW),
    "normalize_model_label": with_ctes(f"SELECT doc_id, {model_label('emotion')} AS emotion FROM raw", RAW),
    "prefix_text": "SELECT doc_id, 'query: ' || text AS query, 'passage: ' || text AS passage, 'emotion: ' || text AS labelled FROM documents",
    "ellipsis_snippet": f"""SELECT doc_id, CASE WHEN length(line) > 160 THEN substr(line, 1, 157) || '...' ELSE line END AS snippet,
      {cut('text', 30)} AS title FROM (SELECT doc_id, text, replace(text, chr(10), ' ') AS line FROM documents)""",
    "hash_embed": with_ctes(f"SELECT id, {shown('embedding')} AS embedding FROM doc_vectors", DOC_VECTORS),
    "l2_normalize": f"""SELECT id, {shown('list_transform(v, lambda x: (x / CASE WHEN n > 0 THEN n ELSE 1 END)::FLOAT)')} AS embedding
      FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (
        SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * vec_id) AS v FROM embeddings))""",
    "extract_facts": with_ctes(f"SELECT message_id, array_to_string({facts('user_message')}, '; ') AS facts FROM messages", MESSAGES),
    "knn_topk": KNN,
    "knn_topk_blocks": KNN,
    "knn_clustered_exact": KNN,
    "knn_lsh_recall": f"SELECT count(*) AS truth_rows, TRUE AS recalled FROM ({KNN})",
    "knn_per_user": with_ctes(
        f"SELECT *, round(1 - distance, 6) AS relevance FROM {top('vectors', 'vectors', 10, 'q.id <> p.id AND q.user_id = p.user_id')}", VECTORS
    ),
    "retrieve_contexts": with_ctes("SELECT * FROM contexts", TURNS, ASKED, ASKED_VECTORS, DOC_VECTORS, CONTEXTS),
    "context_block": with_ctes(
        "SELECT query_id, string_agg('- ' || document, chr(10) ORDER BY rank) AS context_block FROM contexts GROUP BY query_id",
        TURNS, ASKED, ASKED_VECTORS, DOC_VECTORS, CONTEXTS,
    ),
    "index_build": with_ctes(
        f"SELECT 'doc-' || (row_number() OVER (ORDER BY id) - 1) AS id, document, {shown('embedding')} AS embedding FROM doc_vectors", DOC_VECTORS
    ),
    "pair_join": with_ctes("SELECT * FROM pairs", TURNS, PAIRS),
    "turn_pairs": with_ctes("SELECT conv_id, turn, user_message, bot_response FROM turns", TURNS),
    "memory_turns": with_ctes(f"SELECT * EXCLUDE (embed_text, created_at), {SECONDS} AS created_at FROM turn_records", TURNS, TURN_RECORDS),
    "memory_facts": with_ctes(f"SELECT id, user_id, type, document, {SECONDS} AS created_at FROM fact_records", MESSAGES, FACT_RECORDS),
    "memory_stats": with_ctes(
        f"""SELECT user_id, coalesce(total, 0) AS total, coalesce(conversations, 0) AS conversations, coalesce(facts, 0) AS facts
        FROM (SELECT DISTINCT (c_custkey % 30)::VARCHAR AS user_id FROM customer) LEFT JOIN (
          SELECT user_id, count(*) AS total, count(*) FILTER (type = '{C.TURN}') AS conversations, count(*) FILTER (type = '{C.FACT}') AS facts
          FROM memory GROUP BY user_id) USING (user_id)""",
        *MEMORY_ALL,
    ),
    "memory_listing": with_ctes(
        f"""SELECT user_id, rank, id, type, {LISTING} AS line FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id)::INTEGER AS rank FROM memory)
        WHERE rank <= 100 AND {LISTING} IS NOT NULL""",
        *MEMORY_ALL,
    ),
    "memory_clear_user": with_ctes(
        "SELECT id, user_id, type FROM memory WHERE user_id NOT IN (SELECT n_nationkey::VARCHAR FROM nation WHERE n_regionkey = 1)", *MEMORY_ALL
    ),
    "memory_save": with_ctes(
        "SELECT user_id, count_if(type = 'conversation_turn')::BIGINT AS turns, count_if(type = 'extracted_fact')::BIGINT AS facts, 0::BIGINT AS again FROM memory GROUP BY user_id", *MEMORY_ALL
    ),
    "memory_delete_stored": with_ctes(
        "SELECT id, user_id, type FROM memory WHERE user_id NOT IN (SELECT n_nationkey::VARCHAR FROM nation WHERE n_regionkey = 1)", *MEMORY_ALL
    ),
    "memory_user_lookup": with_ctes(
        "SELECT id, user_id, type, document FROM memory WHERE user_id IN (SELECT n_nationkey::VARCHAR FROM nation WHERE n_regionkey = 1)", *MEMORY_ALL
    ),
    "memory_hits": with_ctes("SELECT query_id, rank, id, type, content, emotion, distance, relevance FROM hits", *HITS_ALL),
    "memory_prompt_lines": with_ctes("SELECT query_id, slot, id, type FROM lines", *HITS_ALL, PLACED),
    "memory_block": with_ctes("SELECT * FROM blocks", *BLOCKS_ALL),
    "preview_with_overflow": with_ctes(
        f"""SELECT user_id, count(*) AS total, string_agg(line, chr(10) ORDER BY rank) FILTER (rank <= 20) AS shown,
          greatest(count(*) - 20, 0) AS hidden, CASE WHEN count(*) > 20 THEN '...and ' || (count(*) - 20) || ' more' ELSE '' END AS overflow
        FROM (SELECT user_id, {LISTING} AS line, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rank FROM memory)
        GROUP BY user_id""",
        *MEMORY_ALL,
    ),
    "conversation_summary": f"""SELECT conv_id, coalesce({cut('first_text', 30)}, 'New chat') AS title, messages FROM (
      SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS first_text, count(*) AS messages FROM conversations GROUP BY conv_id)""",
    "prompt_table": with_ctes(
        f"SELECT id AS query_id, {prompt('use_filter')} AS prompt FROM asked LEFT JOIN bullets ON query_id = id", *PROMPTS_ALL
    ),
    "fallback_response": with_ctes(
        f"SELECT turn_id, {fallback('emotion', 'CASE WHEN turn > 0 THEN ' + quoted('turn ') + ' || turn ELSE ' + quoted('') + ' END')} AS response FROM turns", TURNS
    ),
    "lexicon_toxicity": f"SELECT doc_id, word <> '' AS toxic, word FROM (SELECT doc_id, {LEXICON_HIT} AS word FROM documents)",
    "score_map_toxicity": with_ctes(
        "SELECT doc_id, round(greatest(toxicity, insult), 6) AS max_score, greatest(toxicity, insult) >= 0.5 AS toxic FROM scored", SCORED
    ),
    "sanitize": with_ctes(
        f"SELECT doc_id, greatest(toxicity, insult) >= 0.5 AS toxic, CASE WHEN greatest(toxicity, insult) >= 0.5 THEN {quoted(C.REFUSAL)} ELSE text END AS final_text FROM scored",
        SCORED,
    ),
    "chat_turns": with_ctes(
        f"""SELECT query_id, memories_used, used_fallback, word <> '' AS toxic,
          CASE WHEN word <> '' THEN {quoted(C.REFUSAL)} ELSE reply END AS final_text, prompt_md5 FROM told""",
        *PROMPTS_ALL, TOLD,
    ),
    "bleu_corpus": BLEU,
    "rouge_l": ROUGE,
    "rouge_l_stemmed": ROUGE_STEMMED,
    "greedy_match_score": GREEDY,
    "emotion_alignment": ALIGNMENT,
    "toxicity_reduction": TOXICITY,
    "evaluation_run": with_ctes(EVALUATED, *EVALUATED_ALL),
    "evaluation_report": REPORT,
    "training_set": with_ctes(
        f"""SELECT array_to_string(t[1:128], ' ') AS input, least(len(t), 128)::INTEGER AS n_tokens, emotion AS target FROM (
          SELECT list_filter(regexp_split_to_array('emotion: ' || text, '[{BLANK}]+'), lambda w: w <> '') AS t, emotion FROM (
            SELECT DISTINCT {strip('text')} AS text, emotion FROM cleaned))""",
        RAW, CLEANED,
    ),
    "train_valid_split": with_ctes(SPLIT_BODY, RAW, CLEANED),
    "classify_label_bayes": with_ctes("SELECT text, emotion, split, predicted FROM split JOIN guessed USING (text)", RAW, CLEANED, *bayes("TRUE")),
    "emotion_alignment_predicted": with_ctes(
        ALIGNMENT_BODY, RAW, CLEANED, *bayes("split = 'valid'"),
        f"""emotions AS (SELECT emotion AS gold, predicted AS pred FROM split JOIN guessed USING (text)
          WHERE split = 'valid' AND text NOT IN {in_list(C.MISSING_SPELLINGS)})""",
    ),
    "stream_memory_ingest": with_ctes(f"SELECT DISTINCT id, user_id, type, document, {SECONDS} AS created_at FROM (SELECT DISTINCT ON (id) * FROM repeated)", TURNS, MESSAGES, STREAMED),
    "stream_memory_stats": with_ctes(
        f"""SELECT user_id, count(*) AS total, count(*) FILTER (type = '{C.TURN}') AS conversations, count(*) FILTER (type = '{C.FACT}') AS facts
        FROM (SELECT DISTINCT id, user_id, type FROM repeated) GROUP BY user_id""",
        TURNS, MESSAGES, STREAMED,
    ),
    "stream_retrieve": with_ctes(
        """SELECT query_id, 'memory' AS source, rank, id, distance FROM hits
        UNION ALL SELECT query_id, 'context', rank, id::VARCHAR, distance FROM contexts""",
        *HITS_ALL, DOC_VECTORS, CONTEXTS,
    ),
    "stream_guard": f"""SELECT doc_id, word <> '' AS toxic, CASE WHEN word <> '' THEN {quoted(C.REFUSAL)} ELSE text END AS final_text
      FROM (SELECT doc_id, text, {LEXICON_HIT} AS word FROM documents)""",
}
