"""Queries over the document tables, one for each operator, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import documents, labels
from lodestar.llm.exact_dedup import exact_dedup
from lodestar.llm.mixing import mix_sources
from lodestar.llm.near_dedup import near_dedup
from lodestar.llm.packing import pack_documents
from lodestar.llm.pii import replace_pii
from lodestar.llm.quality import quality
from lodestar.llm.substring_dedup import substring_dedup
from lodestar.llm.telephony import text_as_audio
from lodestar.llm.token_count import token_counts
from lodestar.llm.toxicity import toxicity

OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, list_aggregate(words[i : i + 19], 'string_agg', ' ') AS win FROM w, unnest(range(1, greatest(len(words) - 18, 1))) AS r(i)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS place FROM win),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM ranked, unnest(range(20)) AS r(k) WHERE place > 1),
each AS (SELECT doc_id, j, words[j] AS word FROM w, unnest(range(1, len(words) + 1)) AS r(j)),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.j) AS kept FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20-word windows that start earlier elsewhere, removed from every document."""
    return substring_dedup(documents(spark, sf_dir), length=20, first=5)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with the personal data in it replaced by surrogates."""
    return replace_pii(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and byte-level BPE tokens of every text, and whether it has over 512 tokens."""
    return token_counts(documents(spark, sf_dir), tokenizer="byte_bpe_50k.json", limit=512)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 4096 tokens."""
    return pack_documents(documents(spark, sf_dir), tokenizer="word_bpe_49k.json", length=4096, end=1)


OP5 = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size FROM n WINDOW w AS (PARTITION BY plain ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM r
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal but for whitespace, and the row of each that stays."""
    return exact_dedup(documents(spark, sf_dir))


OP7 = r"""
WITH d AS (SELECT doc_id, source IS NULL AS nil, coalesce(source, '') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS place FROM documents),
s AS (SELECT nil, src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY nil, src) - 1 AS rank FROM d GROUP BY nil, src),
w AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (CAST(total AS DOUBLE) - coalesce(3.0::DOUBLE * CAST(sum(source_size) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
          / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, rank LIMIT 1),
t AS (SELECT nil, src, source_size, round(least(3.0::DOUBLE * source_size, weight * coalesce((SELECT level FROM f), 0)), 6) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, source_size, target, whole, sum(size) OVER (PARTITION BY d.nil, d.src ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN e ON d.nil = e.nil AND d.src = e.src)
SELECT doc_id, size, source_size, target, size * times AS taken, times
FROM (SELECT *, CAST(whole + CASE WHEN target - whole * source_size > 0 AND upto <= target - whole * source_size THEN 1 ELSE 0 END AS BIGINT) AS times FROM c)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; the model learns from labels outside the held-out fifth."""
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text; the model learns from labels outside the held-out quarter."""
    return quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document comes in a mix of sources weighing 1, 2, 3, 1, ..., at three epochs at most."""
    return mix_sources(documents(spark, sf_dir))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of each document: five-word shingles, weighted Jaccard similarity of 0.8 or more."""
    return near_dedup(documents(spark, sf_dir))


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as telephony audio, read back, expanded and resampled."""
    return text_as_audio(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_pii, op3_token_counts, op4_packing, op5_exact_dedup, op6_toxicity, op7_mixing, op8_quality, op9_near_dedup, op10_telephony)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op5_exact_dedup": OP5, "op7_mixing": OP7}
