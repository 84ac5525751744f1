"""The registered queries of the numbered operators, and their SQL where SQL can express them.

Each query reads whole tables of the folder it is given and applies its operator with production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redraft.llm import bpe, codebooks, decontamination, exact_dedup, imatch, infill, ngram_join, pii, pitman_yor, quality, repeats, token_counts, warc
from redraft.llm.textblocks import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, sf_dir, "documents"), length=50)


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses_of_pages(table(spark, sf_dir, "pages")))
    return made.selectExpr("row_id AS page_id", "warc_type", "derived_id AS record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_digest", "record")


OP5_SQL = """
WITH s AS (
  SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages WHERE page_id IS NOT NULL
), a AS (
  SELECT page_id, u, h, sha256('response' || chr(10) || CAST(page_id AS VARCHAR) || chr(10) || u) AS rh,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(h,
      '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<head[^>]*>.*?</head>', ' ', 'g'),
      '[ \\t\\r\\n\\f]+', ' ', 'g'),
      '(?i)<(br|/p|/div|/h[1-6]|/li|/tr|/title|/article|/section|/nav|/footer|/header)[^>]*>', chr(10), 'g'),
      '<[^>]*>', ' ', 'g') AS t
  FROM s
), b AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(
    replace(replace(replace(replace(replace(replace(replace(replace(replace(t,
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
    '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS p,
    '<urn:uuid:' || substr(rh,1,8) || '-' || substr(rh,9,4) || '-' || substr(rh,13,4) || '-' || substr(rh,17,4) || '-' || substr(rh,21,12) || '>' AS rid,
    'sha256:' || sha256(h) AS sd, chr(13) || chr(10) AS nl
  FROM a
), c AS (
  SELECT *, sha256('metadata' || chr(10) || rid) AS mh, sha256('conversion' || chr(10) || rid) AS ch FROM b
), d AS (
  SELECT *,
    '<urn:uuid:' || substr(mh,1,8) || '-' || substr(mh,9,4) || '-' || substr(mh,13,4) || '-' || substr(mh,17,4) || '-' || substr(mh,21,12) || '>' AS mid,
    '<urn:uuid:' || substr(ch,1,8) || '-' || substr(ch,9,4) || '-' || substr(ch,13,4) || '-' || substr(ch,17,4) || '-' || substr(ch,21,12) || '>' AS cid
  FROM c
), e AS (
  SELECT page_id, u, rid, sd, nl, 'metadata' AS kind, mid AS did, 'application/warc-fields' AS ct,
    'source-payload-digest: ' || sd || nl || 'source-payload-length: ' || CAST(strlen(h) AS VARCHAR) || nl || 'conversion: ' || cid || nl ||
    'conversion-digest: sha256:' || sha256(p) || nl || 'source-http-headers:' || nl ||
    'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || CAST(strlen(h) AS VARCHAR) || nl AS block FROM d
  UNION ALL
  SELECT page_id, u, rid, sd, nl, 'conversion', cid, 'text/plain; charset=utf-8', p FROM d
)
SELECT page_id, kind AS warc_type, did AS record_id, rid AS refers_to, u AS target_uri, ct AS content_type, CAST(strlen(block) AS BIGINT) AS content_length,
  'sha256:' || sha256(block) AS block_digest, sd AS source_digest,
  'WARC/1.1' || nl || 'WARC-Type: ' || kind || nl || 'WARC-Record-ID: ' || did || nl || 'WARC-Refers-To: ' || rid || nl || 'WARC-Target-URI: ' || u || nl ||
  'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'WARC-Block-Digest: sha256:' || sha256(block) || nl || 'Content-Type: ' || ct || nl ||
  'Content-Length: ' || CAST(strlen(block) AS VARCHAR) || nl || nl || block || nl || nl AS record
FROM e
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.personal_data(table(spark, sf_dir, "documents")))


def op8_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.summaries(token_counts.histogram(token_counts.lengths(table(spark, sf_dir, "documents"))))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id, coalesce(text, '')) AS no FROM documents WHERE doc_id IS NOT NULL
), e AS (
  SELECT a.no, a.doc_id, a.t, length(a.t) AS n_chars, b.no AS next_no,
    substring(a.t, 1, length(a.t) - length(a.t) // 4) || substring(b.t, 1, length(a.t) // 4) AS edited
  FROM d a JOIN d b ON b.no = a.no % (SELECT count(*) FROM d) + 1
), w AS (
  SELECT no, late, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM (SELECT no, false AS late, t AS x FROM e UNION ALL SELECT no, true, edited FROM e)
), each AS (
  SELECT no, late, unnest(list_distinct(string_split_regex(x, '[\x20\x09-\x0D]+'))) AS term FROM w
), lexicon AS (
  SELECT term, list_filter(range(32), lambda j: substr(sha256(term), CAST(2 * j + 1 AS BIGINT), 2) < CASE WHEN j < 4 THEN '20' WHEN j < 12 THEN '08' WHEN j < 22 THEN '02' ELSE '01' END) AS subsets
  FROM (SELECT term, count(*) AS n FROM each WHERE NOT late AND term <> '' GROUP BY term)
  WHERE n > 0.001 * (SELECT count(*) FROM d) AND n <= 0.02 * (SELECT count(*) FROM d)
), met AS (
  SELECT no, late, term, subsets FROM each JOIN lexicon USING (term)
), whole AS (
  SELECT no, late, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS h FROM met GROUP BY no, late
), own AS (
  SELECT no, late, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS h, j FROM (SELECT no, late, term, unnest(subsets) AS j FROM met) GROUP BY no, late, j
), parts AS (
  SELECT w.no, w.late, [coalesce(whole.h, substr(md5(w.x), 1, 8))] || list_transform(range(32), lambda j: coalesce(any_value(o.m)[j], '--------')) AS p
  FROM w LEFT JOIN whole USING (no, late) LEFT JOIN (SELECT no, late, map(list(j ORDER BY j), list(h ORDER BY j)) AS m FROM own GROUP BY no, late) o USING (no, late)
  GROUP BY w.no, w.late, w.x, whole.h
), f AS (
  SELECT e.*, a.p AS p, b.p AS q, c.p AS r FROM e
  JOIN parts a ON a.no = e.no AND NOT a.late JOIN parts b ON b.no = e.no AND b.late JOIN parts c ON c.no = e.next_no AND NOT c.late
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(p, '') AS fingerprint, array_to_string(q, '') AS edited_fingerprint,
  len(list_filter(range(1, 34), lambda i: p[i] = q[i] AND p[i] <> '--------')) / len(list_filter(range(1, 34), lambda i: p[i] <> '--------' OR q[i] <> '--------')) AS near_edited,
  len(list_filter(range(1, 34), lambda i: p[i] = r[i] AND p[i] <> '--------')) / len(list_filter(range(1, 34), lambda i: p[i] <> '--------' OR r[i] <> '--------')) AS near_next
FROM f
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE doc_id IS NOT NULL
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid, coalesce(array_to_string(units[b + 1:n], ''), '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op13_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.code_digests(table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """Assignments as joins of parts and entries; a round is a pair of tables."""
    near = "SELECT p.vec_id, p.part, p.v, min(struct_pack(d := list_sum(list_transform(list_zip(p.v, e.v), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT))), entry := e.entry)) AS best FROM parts p JOIN {} e USING (part) GROUP BY p.vec_id, p.part, p.v"
    mean = "SELECT e.part, e.entry, CASE WHEN any_value(m.v) IS NULL THEN e.v ELSE any_value(m.v) END AS v FROM {} e LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v FROM (SELECT part, best.entry AS entry, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x FROM {} CROSS JOIN (SELECT unnest(range(1, 5)) AS i) GROUP BY part, best.entry, i) GROUP BY part, entry) m ON m.part = e.part AND m.entry = e.entry GROUP BY e.part, e.entry, e.v"
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, part, ints[4 * part + 1:4 * part + 4] AS v FROM kept CROSS JOIN (SELECT unnest(range(16)) AS part)
), e0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
), a0 AS ({near.format("e0")}), e1 AS ({mean.format("e0", "a0")}), a1 AS ({near.format("e1")}), e2 AS ({mean.format("e1", "a1")}), a2 AS ({near.format("e2")}
), coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id
), book AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM e2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (vec_id) CROSS JOIN book
"""


OP13_SQL = _op13_sql()


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_warc_derivatives": op5_warc_derivatives,
    "op6_quality": op6_quality,
    "op7_personal_data": op7_personal_data,
    "op8_token_length_histogram": op8_token_length_histogram,
    "op9_language_model": op9_language_model,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_imatch": op11_imatch,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_codebooks": op13_codebooks,
}

ORACLE_SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op5_warc_derivatives": OP5_SQL,
    "op11_imatch": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_codebooks": OP13_SQL,
}
