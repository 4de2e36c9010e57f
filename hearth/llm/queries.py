"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm import alignment, conversations, extraction, hashing, langid, packing, pieces, pitman_yor, quality, simhash, substrings, topk, urls
from hearth.llm.common import remainder, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, their text again, and whether both libraries agree."""
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = pieces.decode(encoded)
    return back.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), "parity", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learnt from those whose remainder modulo 7 is not 2."""
    return pitman_yor.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and decision for every document, learnt from weak labels of all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(docs)).select("doc_id", "quality", "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence of at most 2048 tokens."""
    found = packing.pack(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside repeated windows of 35, per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return substrings.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", kept)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extraction.extract(pages, extraction.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the 20 largest inner products of every vector whose id is divisible by 20."""
    return hashing.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint over 3-word shingles and class of every document, linked at 3 or fewer bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those whose remainder modulo 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs, ~held_out)
    found = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers, per document."""
    return alignment.align(table(spark, sf_dir, "documents"))


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation after the damage of the contract."""
    rows = table(spark, sf_dir, "conversations")
    found = conversations.repair(conversations.damage(rows)).withColumnRenamed("conv_id", "own_id")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("own_id")), "left")
    counts = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_multi_index_hashing": op7_multi_index_hashing,
    "op8_simhash": op8_simhash,
    "op9_language": op9_language,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_url_filter": op12_url_filter,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
k AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS n FROM k) WHERE n > 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM c),
a AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.r = p.r AND g.i = p.i) GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(a.n, 0))::BIGINT AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (r)
""",
    "op10_exact_top_k": """
WITH o AS (SELECT vec_id, min(embedding) AS embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id, len(embedding)),
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM o),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""",
    "op13_conversation_repair": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
k AS (SELECT *, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS name FROM conversations),
h AS (SELECT k.conv_id, k.turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 20 AS kind FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) FROM h)),
n AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prior,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS mark FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again FROM n),
f AS (SELECT *, mark = '' AS blank, mark <> '' AND again AS duplicate, mark <> '' AND NOT again AND mark NOT IN ('.', '!', '?') AS truncated FROM m),
moves AS (SELECT * FROM (VALUES (0, 'u', 2), (0, 's', 1), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(a, role, b)),
inserts AS (SELECT * FROM (VALUES (0, 0, '', []), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
    (2, 3, 'I', ['assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 2, 'I', ['user:']), (3, 3, 'II', ['user:', 'assistant:'])) v(a, b, audit, added)),
s(c, i, state, cost, audit, kept) AS (
  SELECT c, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM f GROUP BY c
  UNION ALL
  SELECT c, i, state, (x).cost, (x).audit, (x).kept FROM (SELECT c, i, state, min({'cost': cost, 'audit': audit, 'kept': kept}) AS x FROM (
    SELECT s.c, f.i, v.b AS state, s.cost + 2 * len(e.audit) + CASE v.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN v.edit <> 'D' AND f.truncated THEN 1 ELSE 0 END AS cost, s.audit || e.audit || v.edit AS audit,
      list_concat(s.kept, list_concat(e.added, CASE WHEN v.edit = 'D' THEN [] ELSE [v.put || ':' || f.text] END)) AS kept
    FROM s JOIN f ON f.c = s.c AND f.i = s.i + 1 JOIN inserts e ON e.a = s.state,
    LATERAL (SELECT e.b AS b, 'D' AS edit, '' AS put UNION ALL
      SELECT moves.b, CASE WHEN left(f.role, 1) = moves.role THEN 'K' ELSE 'R' END, CASE WHEN left(f.role, 1) = moves.role THEN f.role WHEN moves.role = 'u' THEN 'user' ELSE 'assistant' END
      FROM moves WHERE moves.a = e.b AND NOT f.blank AND NOT f.duplicate AND (moves.role <> 's' OR left(f.role, 1) = 's')) v
  ) GROUP BY c, i, state)
),
r AS (SELECT c, min({'cost': s.cost + 2 * len(e.audit), 'audit': s.audit || e.audit, 'kept': list_concat(s.kept, e.added)}) AS x
  FROM s JOIN (SELECT c, max(i) AS i FROM f GROUP BY c) l USING (c, i) JOIN inserts e ON e.a = s.state AND e.b IN (0, 3) GROUP BY c),
g AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
    count_if(prior IS NOT NULL AND prior || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce((x).cost, 0)::BIGINT AS cost, coalesce((x).audit, '') AS audit, sha256(coalesce(array_to_string((x).kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS c FROM conversations) o LEFT JOIN g USING (c) LEFT JOIN r USING (c)
""",
}
