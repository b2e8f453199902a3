"""Registered queries of this subpackage: each applies one operator to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import language_id
from kerbline.llm.ann import neighbours
from kerbline.llm.common import table
from kerbline.llm.decontamination import leaks
from kerbline.llm.html_extraction import main_text
from kerbline.llm.line_dedup import dedup_lines
from kerbline.llm.near_dedup import near_duplicates
from kerbline.llm.packing import pack
from kerbline.llm.quality import fit, quality
from kerbline.llm.resampling import resampled
from kerbline.llm.secrets import secrets
from kerbline.llm.signature_trees import jaccard_components
from kerbline.llm.spelling import variants
from kerbline.llm.substring_dedup import without_repeats


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens, each in the sources' own proportions."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines that repeat an earlier one taken out."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector."""
    return neighbours(table(spark, sf_dir, "embeddings"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, and how many of them are shared or live-looking."""
    found = secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_live", "n_shared")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near copies."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by trees that labelled documents outside the held-out fold have taught."""
    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, table(spark, sf_dir, "labels")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that a document with a smaller doc_id has as well."""
    cleaned = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    return cleaned.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, up to a share of edits."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by cross-parsing against the languages of documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return language_id.languages(docs, language_id.fit(docs))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark's texts, and the drawn ones' ranks."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words and the form it is a variant of."""
    return variants(table(spark, sf_dir, "documents"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group by 3-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_neighbours": op3_neighbours,
    "op4_secrets": op4_secrets,
    "op5_html_extraction": op5_html_extraction,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_language": op10_language,
    "op11_resampling": op11_resampling,
    "op12_spelling": op12_spelling,
    "op13_jaccard_join": op13_jaccard_join,
}

_GROUPS = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {last}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {last}, 1) + 1)) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {threshold} * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON l.x = r.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, low AS component_id{more}
FROM (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x) LEFT JOIN sizes USING (doc_id)
"""

_REPEATS = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
),
first_in AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s),
repeats AS (SELECT doc_id, i FROM windows JOIN first_in USING (s) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM repeats),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id
"""

#: The CRC of a text's bytes; the table of 256 values follows from the polynomial.
_CRC = r"""
  crc_table AS (SELECT list(list_reduce([i::BIGINT] || range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM range(256) r(i)),
  hashed AS (
    SELECT s, xor(4294967295, list_reduce([4294967295] || list_transform(range(strlen(s)), lambda i: ('0x' || hex(encode(s))[2 * i + 1:2 * i + 2])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc
    FROM (SELECT DISTINCT s FROM hashable), crc_table
  )
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RESAMPLED = rf"""
WITH texts AS (SELECT 0 AS side, doc_id, {_LOWERED} AS text FROM documents UNION ALL SELECT 1, NULL, {_LOWERED} FROM benchmark),
  words AS (SELECT row_number() OVER () AS k, side, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
  features AS (SELECT k, side, array_to_string(w[i:i + r], ' ') AS s FROM (SELECT k, side, w, r, unnest(range(1, len(w) - r + 1)) AS i FROM words, range(3) t(r) WHERE len(w) > r)),
  hashable AS (SELECT s FROM features), {_CRC},
  placed AS (SELECT k, side, crc % 10000 AS bucket, count(*) AS n FROM features JOIN hashed USING (s) GROUP BY ALL),
  counts AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM placed GROUP BY bucket),
  gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain FROM counts),
  sums AS (SELECT k, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY k),
  scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM words LEFT JOIN sums USING (k) WHERE side = 0
  ),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM ranked
"""

_SPELLING = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
  hashable AS (SELECT doc_id || ':' || run AS s FROM runs), {_CRC},
  spelt AS (SELECT CASE WHEN crc % 97 = 0 THEN run[:crc % length(run)] || run[crc % length(run) + 2:] ELSE run END AS word FROM runs JOIN hashed ON s = doc_id || ':' || run),
  words AS (SELECT word, count(*) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
  cut AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
  pairs AS (
    SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
  ),
  near AS (SELECT word, n, count(*) AS n_near, min({{'n': -other_n, 'word': other}}) AS best FROM pairs GROUP BY word, n),
  forms AS (SELECT word, best.word AS form, -best.n AS form_n FROM near WHERE -best.n >= 2 * n),
  paths AS (SELECT word, word AS root, 0 AS steps FROM words UNION ALL SELECT p.word, form, steps + 1 FROM paths p JOIN forms f ON f.word = p.root),
  roots AS (SELECT word, max_by(root, steps) AS root FROM paths GROUP BY word)
SELECT w.word, form, root, w.n, coalesce(n_near, 0) AS n_near, form_n::BIGINT AS form_n
FROM words w JOIN roots USING (word) LEFT JOIN near USING (word) LEFT JOIN forms USING (word)
"""

#: The other methods have no counterpart in SQL: their tests hold them against brute force, round trips or held-out labels.
ORACLES: dict[str, str] = {
    "op6_near_duplicates": _GROUPS.format(last=4, threshold=75, more=", doc_id = low AS kept"),
    "op8_substring_dedup": _REPEATS,
    "op11_resampling": _RESAMPLED,
    "op12_spelling": _SPELLING,
    "op13_jaccard_join": _GROUPS.format(last=2, threshold=90, more=""),
}
