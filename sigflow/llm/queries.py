"""Registered queries of the operators (``opN_<name>``) and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigflow.llm import licenses
from sigflow.llm.bpe import bpe_digests
from sigflow.llm.common import crc32_mod
from sigflow.llm.exact_dedup import exact_dedup
from sigflow.llm.hyperplanes import near_vectors
from sigflow.llm.langid import identify
from sigflow.llm.lexical import build_index, search
from sigflow.llm.lm import lm_scores
from sigflow.llm.negatives import hard_negatives
from sigflow.llm.packing import pack_documents
from sigflow.llm.simhash import simhash_groups
from sigflow.llm.suffix_dedup import cut_repeats
from sigflow.llm.toolcalls import CHAT_SCHEMAS, chat_calls, link_tool_calls
from sigflow.llm.topk import sign_code, top_k
from sigflow.sources.tables import table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op2_byte_bpe(spark, sf_dir):
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"))


def op3_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """The same definition over gram texts instead of hashes."""
    named = {f"base:{v}:{k}": k for k, v in licenses.PHRASES.items()} | {f"text:{k}": v for k, v in licenses.TEMPLATES.items()}
    k, rows = licenses.K, []
    for label, text in named.items():
        w = text.split(" ")
        size = len(w) - k + 1
        slack = min(licenses.SLACK, size // 4) if label.startswith("text:") else 0
        rows += [f"('{label}', {i}, '{' '.join(w[i:i + k])}', {size}, {slack})" for i in range(size)]
    return f"""
        WITH places(label, place, gram, size, slack) AS (VALUES {', '.join(rows)}),
        t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        g AS (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS pos FROM t WHERE len(w) >= {k}),
        h AS (SELECT DISTINCT g.doc_id, label, size, slack, place, pos - 1 - place AS diagonal
              FROM g JOIN places ON array_to_string(w[pos:pos + {k - 1}], ' ') = gram),
        b AS (SELECT s.doc_id, s.label, s.diagonal AS start, h.size, h.slack, h.place, min(h.diagonal + h.place) AS spot
              FROM (SELECT DISTINCT doc_id, label, diagonal FROM h) AS s JOIN h ON h.doc_id = s.doc_id AND h.label = s.label
                   AND h.diagonal BETWEEN s.diagonal AND s.diagonal + h.slack GROUP BY ALL),
        o AS (SELECT *, coalesce(spot > max(spot) OVER (PARTITION BY doc_id, label, start ORDER BY place
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS counts FROM b),
        s AS (SELECT doc_id, label, start, size, slack, CAST(count(*) FILTER (counts) AS DOUBLE) / size AS share
              FROM o GROUP BY doc_id, label, start, size, slack),
        f AS (SELECT *, label LIKE 'base:%' AS base, split_part(label, ':', 2) AS name FROM s
              WHERE CASE WHEN label LIKE 'base:%' THEN share = 1 ELSE share >= {licenses.LEAST_SHARE} END),
        e AS (SELECT *, coalesce(start - lag(start) OVER (PARTITION BY doc_id, label ORDER BY start) > slack, true) AS new FROM f),
        a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
                     max(start) FILTER (base) AS last_word,
                     string_agg(DISTINCT name, ',' ORDER BY name) FILTER (base) AS base_labels,
                     string_agg(DISTINCT name, ',' ORDER BY name) AS labels, max(share) AS score,
                     count(*) FILTER (NOT base AND new) AS n_spans FROM e GROUP BY doc_id)
        SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
               CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
               coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(n_spans, 0) AS n_spans
        FROM t LEFT JOIN a USING (doc_id)"""


def op4_hamming_top_k(spark, sf_dir):
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return top_k(codes, codes.where(F.col("id") % 20 == 0), 10)


def op5_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 1024)


def op6_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"), 4, 4)


def op7_suffix_dedup(spark, sf_dir):
    return cut_repeats(table(spark, sf_dir, "documents"), 200).drop("kept_text")


def op8_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"), crc32_mod("doc_id", 4) == 2)


def op9_tool_calls(spark, sf_dir):
    calls, results = chat_calls(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, CHAT_SCHEMAS).withColumn("errors", F.array_join("errors", ";"))


def op10_lm_scores(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"), crc32_mod("doc_id", 10) == 0)


def op11_lexical_search(spark, sf_dir):
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 50)


def op12_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, id_col="vec_id", vec_col="embedding")


def op13_embedding_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_license_scan": op3_license_scan,
    "op4_hamming_top_k": op4_hamming_top_k,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_id": op8_language_id,
    "op9_tool_calls": op9_tool_calls,
    "op10_lm_scores": op10_lm_scores,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_embedding_dedup": op13_embedding_dedup,
}

ORACLES = {
    "op3_license_scan": _license_sql(),
    "op1_exact_dedup": """
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS s
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY s) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               s AS text_sha256
        FROM t
        WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * CAST(e AS DOUBLE)) FOR e IN embedding] AS x FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, v.vec_id AS other, a.label = v.label AS same,
                   CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score
            FROM v AS a, v WHERE a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
        p AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, other AS negative_id,
               positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
             AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW o AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
        QUALIFY row_number() OVER o <= 5""",
    "op11_lexical_search": """
        WITH words AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        sizes AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
        total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL),
        weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
                    FROM tf, total GROUP BY term, docs),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
        scored AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
        WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
        QUALIFY row_number() OVER o <= 50""",
    "op9_tool_calls": """
        WITH RECURSIVE calls AS (
            SELECT conv_id, 'call-' || turn AS call_id, turn, text FROM conversations WHERE role = 'user'),
        results AS (
            SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn, text FROM conversations WHERE role = 'assistant'),
        chain AS (
            SELECT conv_id, turn, CAST(0 AS BIGINT) AS depth FROM calls c WHERE NOT EXISTS (
                SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
            UNION ALL
            SELECT c.conv_id, c.turn, depth + 1 FROM chain p JOIN calls c ON c.conv_id = p.conv_id AND c.turn = p.turn + 2),
        linked AS (
            SELECT c.*, depth, r.text AS content,
                   CASE WHEN length(c.text) BETWEEN 1 AND 200 AND c.turn >= 0 THEN [] ELSE ['range prompt'] END AS faults,
                   CASE WHEN length(c.text) NOT BETWEEN 1 AND 200 THEN 'invalid_arguments'
                        WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'ok' END AS status
            FROM calls c JOIN chain USING (conv_id, turn) LEFT JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id)
        SELECT conv_id, call_id, turn, depth, status, array_to_string(faults, ';') AS errors,
               CAST(json_object('arguments', json_object('prompt', text, 'turn', turn), 'conversation', conv_id,
                    'errors', faults, 'id', call_id, 'name', 'reply', 'result', content, 'status', status) AS VARCHAR) AS json
        FROM linked
        UNION ALL
        SELECT conv_id, call_id, turn, NULL, 'orphan_result', '',
               CAST(json_object('conversation', conv_id, 'id', call_id, 'result', text, 'status', 'orphan_result') AS VARCHAR)
        FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)""",
    "op4_hamming_top_k": """
        WITH c AS (
            SELECT vec_id, string_agg(CASE WHEN coalesce(embedding[i], 0) > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS bits
            FROM embeddings, range(1, 65) AS r(i) GROUP BY vec_id),
        d AS (
            SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id,
                   CAST(hamming(q.bits, c.bits) AS INTEGER) AS distance
            FROM c AS q, c WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER o AS INTEGER) AS rank, neighbour_id, distance FROM d
        WINDOW o AS (PARTITION BY query_id ORDER BY distance, neighbour_id)
        QUALIFY row_number() OVER o <= 10""",
    "op7_suffix_dedup": """
        WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        n AS (SELECT doc_id, b, octet_length(b) AS n FROM t),
        w AS (SELECT doc_id, i, md5_number(array_slice(b, i, i + 199)) AS h
              FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM n WHERE n >= 200)),
        r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
        f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new
              FROM w WHERE h IN (SELECT h FROM r)),
        g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
        s AS (SELECT doc_id, run, min(i) AS a, max(i) + 199 AS z FROM g GROUP BY doc_id, run),
        k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS lo, a - 1 AS hi FROM s
              UNION ALL SELECT n.doc_id, coalesce(max(z), 0) + 1, any_value(n) FROM n LEFT JOIN s USING (doc_id) GROUP BY n.doc_id),
        kept AS (SELECT doc_id, string_agg(CASE WHEN hi >= lo THEN hex(array_slice(b, lo, hi)) ELSE '' END, '' ORDER BY lo) AS x
                 FROM k JOIN n USING (doc_id) GROUP BY doc_id),
        c AS (SELECT doc_id, sum(z - a + 1) AS removed, count(*) AS spans FROM s GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
               sha256(unhex(x)) AS kept_sha256
        FROM n JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
