"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bottomk, conversation_repair, decontamination, html_text, mixing, pii, quality, simhash_dedup, substring_dedup, token_alignment, token_counts, toxicity, vector_search
from .common import purge

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_quality": quality.query,
    "op3_html_text": html_text.query,
    "op4_pii": pii.query,
    "op5_vector_search": vector_search.query,
    "op6_decontamination": decontamination.query,
    "op7_simhash_dedup": simhash_dedup.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_mixing": mixing.query,
    "op10_toxicity": toxicity.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_fingerprints": bottomk.query,
    "op13_token_alignment": token_alignment.query,
}

#: The other operators use a tokenizer, a fitted model, a hash or an iteration that
#: SQL lacks, or are too slow in it; tests/llm holds them against brute force.
ORACLE: dict[str, str] = {
    "op5_vector_search": """
WITH good AS (
    SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5""",
    "op8_substring_dedup": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20
), later AS (
    SELECT doc_id, s FROM starts QUALIFY row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) > 1
), gone AS (
    SELECT DISTINCT doc_id, s + k AS i FROM later, (SELECT unnest(range(20)) AS k)
), words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
}


# rows from the last to the first give the costs from each state; then the least letter, row by row
ORACLE["op11_conversation_repair"] = r"""
WITH RECURSIVE source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') AS k FROM conversations
), sums AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(k || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')])),
        lambda c, v: xor(xor(c, v) >> 1, 3988292384::BIGINT * (xor(c, v) & 1))), 4294967295::BIGINT) % 20 AS d
    FROM source
), kept AS (
    SELECT k, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM sums WHERE d <> 0
), dealt AS (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM kept
), placed AS (
    SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again,
        right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS mark, lag(role[1]) OVER (PARTITION BY k ORDER BY i) AS before
    FROM dealt
), rows AS (
    SELECT *, mark = '' AS blank, mark <> '' AND again AS duplicate, mark <> '' AND NOT again AND mark NOT IN ('.', '!', '?') AS cut, i > 1 AND before || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM placed
), stuck AS (
    SELECT k, i, n, role, text, CASE WHEN blank OR duplicate THEN 1000000000 WHEN cut THEN 5 ELSE 0 END AS more,
        CASE WHEN role[1] = 's' THEN 0 ELSE 1000000000 END AS s, CASE WHEN role[1] = 'u' THEN 0 ELSE 1000000000 END AS u, CASE WHEN role[1] = 'a' THEN 0 ELSE 1000000000 END AS a FROM rows
), back AS (
    SELECT DISTINCT k, n + 1 AS i, 0::BIGINT AS v0, 10::BIGINT AS v1, 5::BIGINT AS v2, 0::BIGINT AS v3 FROM stuck
    UNION ALL
    SELECT k, i, least(b0, 5 + b2, 10 + b3), least(b1, 5 + b2, 10 + b3), least(b2, 5 + b3), least(b3, 5 + b2) FROM (
        SELECT r.k, r.i, least(2 + v0, more + s + v1, more + u + v2, more + 1 + v2) AS b0, least(2 + v1, more + u + v2, more + 1 + v2) AS b1,
            least(2 + v2, more + a + v3, more + 1 + v3) AS b2, least(2 + v3, more + u + v2, more + 1 + v2) AS b3
        FROM back JOIN stuck r ON r.k = back.k AND r.i = back.i - 1)
), goes AS (
    SELECT b.k, b.i, [v0, v1, v2, v3] AS v, r.* EXCLUDE (k, i) FROM back b LEFT JOIN stuck r ON r.k = b.k AND r.i = b.i
), walk AS (
    SELECT k, 0 AS step, 1::BIGINT AS i, 0 AS state, '' AS letter, NULL::VARCHAR AS line FROM goes WHERE i = 1
    UNION ALL
    SELECT k, step + 1, CASE WHEN go = 'I' THEN i ELSE i + 1 END, CASE go WHEN 'D' THEN state WHEN 'K' THEN kind ELSE ahead END, go,
        CASE go WHEN 'K' THEN role || ':' || text WHEN 'R' THEN ['user', 'assistant'][ahead - 1] || ':' || text WHEN 'I' THEN ['user', 'assistant'][ahead - 1] || ':' END
    FROM (
        SELECT *, CASE WHEN more IS NOT NULL AND v[state + 1] = 2 + after[state + 1] THEN 'D' WHEN v[state + 1] = 5 + v[ahead + 1] THEN 'I'
            WHEN more IS NULL THEN NULL WHEN (kind = ahead OR kind = 1 AND state = 0) AND v[state + 1] = more + after[kind + 1] THEN 'K' ELSE 'R' END AS go
        FROM (SELECT w.k, w.step, w.i, w.state, g.v, g.more, g.role, g.text, nxt.v AS after, CASE w.state WHEN 2 THEN 3 ELSE 2 END AS ahead,
                CASE g.role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS kind
            FROM walk w JOIN goes g ON g.k = w.k AND g.i = w.i LEFT JOIN goes nxt ON nxt.k = w.k AND nxt.i = w.i + 1))
    WHERE go IS NOT NULL
), made AS (
    SELECT k, string_agg(letter, '' ORDER BY step) AS audit, string_agg(line, chr(10) ORDER BY step) AS lines FROM walk GROUP BY k
), counted AS (
    SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(cut) AS truncated, count_if(illegal) AS illegal
    FROM rows GROUP BY k
)
SELECT s.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
    coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.v0, 0)::BIGINT AS cost, coalesce(m.audit, '') AS audit, sha256(coalesce(m.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM source) s LEFT JOIN counted c ON c.k = s.k LEFT JOIN made m ON m.k = s.k LEFT JOIN back b ON b.k = s.k AND b.i = 1"""


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def clean_up(spark) -> None:
    """Delete what the queries so far have stashed; their results must be written."""
    purge(spark)
