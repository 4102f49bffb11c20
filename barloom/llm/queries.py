"""The operators as queries over whole tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.byte_bpe import BpeParameters, encode_documents
from barloom.llm.centroids import cluster_vectors
from barloom.llm.decontamination import contaminated
from barloom.llm.fill_in_middle import fill_in_middle, restored
from barloom.llm.line_dedup import dedup_lines
from barloom.llm.main_text import extract_main_text
from barloom.llm.near_duplicates import NearParameters, near_duplicates
from barloom.llm.quality import quality
from barloom.llm.repeats import remove_repeats
from barloom.llm.secret_scan import find_secrets
from barloom.llm.sentence_pieces import PieceParameters, encode_pieces
from barloom.llm.toxicity import score_documents
from barloom.llm.warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe_50k() -> BpeParameters:
    """The 50k byte-level vocabulary; its pattern takes a space with the word that follows it."""
    return BpeParameters(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, spaced=True)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearParameters(words=4, percent=80))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), byte_bpe_50k())


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), PieceParameters(public_tokenizers.path("piece_bpe_32k.model")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_main_text,
        op3_quality_rules,
        op4_line_dedup,
        op5_near_duplicates,
        op6_warc,
        op7_suffix_array,
        op8_decontamination,
        op9_toxicity,
        op10_byte_bpe,
        op11_sentence_pieces,
        op12_fill_in_middle,
        op13_centroids,
    )
}

WORDS = r"'[^ \t\n\x0B\f\r]+'"
SPACE = r"'[ \t\n\x0B\f\r]+'"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('h:' || source, 'none') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {WORDS}) AS words, string_split(text, chr(10)) AS raw FROM d),
windows AS (SELECT r, i, words[i:i + 4] AS win FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS t(k) GROUP BY r),
lines AS (SELECT r, host, text, unnest(raw) AS line FROM w),
worded AS (SELECT *, regexp_extract_all({ASCII_LOWER.format("line")}, {WORDS}) AS own FROM lines WHERE len(regexp_extract_all(line, {WORDS})) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY r),
norm AS (SELECT DISTINCT r, host, text, array_to_string(own, ' ') AS line, len(own) AS n FROM worded),
hosts AS (SELECT host, count(*) AS n FROM d GROUP BY host),
frequent AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM norm GROUP BY host, line) JOIN hosts USING (host)
  WHERE n > 100 AND n > 0.1 * hosts.n),
cut AS (SELECT r, sum(norm.n) AS n FROM norm JOIN frequent USING (host, line) GROUP BY r),
rated AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(cut.n, 0) AS BIGINT) AS n_cut_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN cut USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND NOT (n_cut_words > 0 AND (n_words - n_cut_words < 5 OR n_words - n_cut_words < n_words * 0.2)) AS kept
FROM rated
""".replace("n > 100 AND n > 0.1 * hosts.n", "counted.n > 100 AND counted.n > 0.1 * hosts.n").replace("GROUP BY host, line) JOIN", "GROUP BY host, line) AS counted JOIN")

NEAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, {WORDS}) AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM m
"""

CONTAINMENT_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(words[k:k + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS k FROM d)),
si AS (SELECT DISTINCT item_id, array_to_string(words[k:k + 4], ' ') AS shingle FROM (SELECT item_id, words, unnest(range(1, len(words) - 3)) AS k FROM i)),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM si GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN si USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item_shingles, n_shared FROM c JOIN n USING (item_id) WHERE n_shared * 100 >= n_item_shingles * 80
"""

FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
draws AS (
  SELECT doc_id, text, length(text) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d),
cuts AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM draws),
parts AS (
  SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1, n - b) AS suffix FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def _centroid_sql(rounds: int) -> str:
    """Assignment of all vectors, then ``rounds`` times new means and another assignment; a centroid is 64 rows (c, k, x)."""
    steps = [
        """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS k, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept QUALIFY c < 16),
c0 AS MATERIALIZED (SELECT c, k, x FROM first JOIN v USING (r))"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""
a{i} AS MATERIALIZED (
  SELECT r, c, d FROM (SELECT r, c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS d FROM v JOIN c{i} AS m USING (k) GROUP BY r, c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        )
        if i < rounds:
            steps.append(
                f"""
m{i} AS (SELECT c, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN v USING (r) GROUP BY c, k),
c{i + 1} AS MATERIALIZED (
  SELECT c, k, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{i} LEFT JOIN m{i} USING (c, k))"""
            )
    return (
        ",".join(steps)
        + f""",
digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY k)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN digests USING (c)
"""
    )


ORACLE_SQL = {
    "op3_quality_rules": QUALITY_SQL,
    "op5_near_duplicates": NEAR_SQL,
    "op6_warc": WARC_SQL,
    "op8_decontamination": CONTAINMENT_SQL,
    "op12_fill_in_middle": FIM_SQL,
    "op13_centroids": _centroid_sql(rounds=3),
}
