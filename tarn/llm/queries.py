"""The opN_ queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers

from ._common import table
from .content_sort import content_sort
from .decontaminate import decontaminate
from .lines import dedup_lines
from .lm import lm_scores
from .minhash import near_duplicates
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .token_counts import token_counts
from .toxicity import fit_toxicity, score_toxicity
from .url_rules import judge_urls


def op1_vector_best_fit(spark, sf_dir):
    """Every piece's place in sequences of at most 1024 tokens, and of the fewest documents that cost no sequence; tokens, documents and attention choose the bin."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_bbit_minhash(spark, sf_dir):
    """Near duplicates at a similarity of 85 in 100 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=(85, 100))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id) LEFT JOIN size USING (doc_id)"""


def op3_wu_manber(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


OP3_SQL = r"""
WITH split AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
item AS (
  SELECT DISTINCT id AS item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(13, len(w)) AS m FROM split WHERE kind = 'b' AND len(w) > 0))),
size AS (SELECT DISTINCT m FROM item),
win AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT id AS doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, size WHERE kind = 'd' AND len(w) >= m)),
occurs AS (SELECT DISTINCT doc_id, item.m, i, item_id FROM win JOIN item ON win.win = item.win AND win.m = item.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occurs) GROUP BY doc_id),
held AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM occurs) GROUP BY doc_id)
SELECT id AS doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(held.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM split LEFT JOIN hit ON id = hit.doc_id LEFT JOIN held ON id = held.doc_id WHERE kind = 'd'"""


def op4_subword_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op5_pu_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op6_elias_fano_lm(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


def op7_fp_url_rules(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


def op8_content_sort(spark, sf_dir):
    return content_sort(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t"""

def op9_reversible_lines(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
held AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, held.k IS NOT NULL AND doc_id <> first AS gone FROM keyed LEFT JOIN held ON keyed.k = held.k)
SELECT doc_id, count(*) AS n_lines, cast(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def op10_pretoken_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_vector_best_fit": op1_vector_best_fit,
    "op2_bbit_minhash": op2_bbit_minhash,
    "op3_wu_manber": op3_wu_manber,
    "op4_subword_quality": op4_subword_quality,
    "op5_pu_toxicity": op5_pu_toxicity,
    "op6_elias_fano_lm": op6_elias_fano_lm,
    "op7_fp_url_rules": op7_fp_url_rules,
    "op8_content_sort": op8_content_sort,
    "op9_reversible_lines": op9_reversible_lines,
    "op10_pretoken_counts": op10_pretoken_counts,
}
ORACLE_SQL = {"op2_bbit_minhash": OP2_SQL, "op3_wu_manber": OP3_SQL, "op8_content_sort": OP8_SQL, "op9_reversible_lines": OP9_SQL}
