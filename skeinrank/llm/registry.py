"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chroma import op1_chroma_fingerprints
from .embedding_dedup import op9_nn_descent
from .minhash_dedup import op5_minhash_hamming
from .mixing import op3_soft_mixing
from .packing import op4_best_fit_packing
from .quality import op10_quality_resampling
from .secrets import op7_grammar_secrets
from .substring_dedup import op2_substring_dedup
from .url_filter import op8_url_filter
from .warc import op6_warc_salvage


def queries() -> dict:
    ops = (op1_chroma_fingerprints, op2_substring_dedup, op3_soft_mixing, op4_best_fit_packing, op5_minhash_hamming, op6_warc_salvage, op7_grammar_secrets, op8_url_filter, op9_nn_descent, op10_quality_resampling)
    return {f.__name__: f for f in ops}


#: WARC records by plain SQL over pages; target_uri is what the archive's header holds.
_WARC = """
WITH sized AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), digests AS (
  SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM sized
), last AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS last_id FROM digests WHERE payload_bytes >= 1000 GROUP BY ALL
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.page_id < l.last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id < l.last_id THEN l.last_id END AS refers_to,
       d.url AS target_uri
FROM digests d LEFT JOIN last l USING (payload_digest, payload_bytes)
"""


#: The words of each text, and the places where 20 words start that also start earlier.
_SUBSTRING = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, words[i] AS word, i AS place, CASE WHEN i + 19 <= len(words) THEN md5(array_to_string(list_slice(words, i, i + 19), ' ')) END AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d)
), marked AS (
  SELECT doc_id, place, word, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, place) > 1 AS again FROM w
), covered AS (
  SELECT doc_id, place, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM marked
), spans AS (
  SELECT doc_id, string_agg((first - 1) || ':' || n, ',' ORDER BY first) AS removed FROM (
    SELECT doc_id, min(place) AS first, count(*) AS n FROM (
      SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island FROM covered WHERE gone
    ) GROUP BY doc_id, island
  ) GROUP BY doc_id
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '') AS text FROM covered GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256, coalesce(s.removed, '') AS removed
FROM d LEFT JOIN kept k USING (doc_id) LEFT JOIN spans s USING (doc_id)
"""

#: Shingle sets, their links by counts of what is in common, and all that links lead to.
_MINHASH = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(words, i, i + 4), ' ')) AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""

#: All pairs of vectors of one dimension by their cosine.
_EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT v.vec_id, count(l.a) AS n_links, any_value(m.component_id) AS component_id, any_value(m.component_id) = v.vec_id AS kept
FROM v JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) m USING (vec_id) LEFT JOIN links l ON l.a = v.vec_id GROUP BY v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": _SUBSTRING, "op5_minhash_hamming": _MINHASH, "op6_warc_salvage": _WARC, "op9_nn_descent": _EMBEDDINGS}
