"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .common import table
from . import decontamination, licenses, packing, quality_crf, quality_rules, simhash, token_counts, toxicity, warc, wfst


def op10_decontamination(spark, sf_dir):
    found = decontamination.spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on the driver; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])


def op5_sentencepiece(spark, sf_dir):
    return wfst.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])


def op6_simhash(spark, sf_dir):
    return simhash.digest(simhash.components_within(table(spark, sf_dir, "documents")))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return warc.digest(warc.write_and_read(table(spark, sf_dir, "pages"))).drop("n_segments", "problem")


def op8_quality_crf(spark, sf_dir):
    return quality_crf.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_licenses(spark, sf_dir):
    files = licenses.document_files(table(spark, sf_dir, "documents"))
    return licenses.licenses(files, keep=["doc_id"])


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_packing": op2_packing,
    "op8_quality_crf": op8_quality_crf,
    "op9_toxicity": op9_toxicity,
    "op3_warc": op3_warc,
    "op7_quality_rules": op7_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_simhash": op6_simhash,
    "op10_decontamination": op10_decontamination,
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_SPLIT_WORDS = r"'[^\x20\x09-\x0D]+'"

SQL = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""",
    "op7_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPLIT_WORDS}) AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
again AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, {_SPLIT_WORDS})),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 70 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_upper > word_chars) AS kept
FROM f""",
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, {_ITEM_WORDS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, {_ITEM_WORDS}) AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
      FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(i) WHERE len(w) > 0),
x AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
      FROM d, (SELECT DISTINCT k FROM p) AS ks, unnest(range(1, len(w) - k + 2)) AS u(i)),
h AS (SELECT x.doc_id, x.i, x.k, p.item_id FROM x JOIN p USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
