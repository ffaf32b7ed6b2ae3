"""Inputs of the linkage operators from the driver's tables: entities from documents, links from orders, vectors from embeddings.

Each view exists as a DataFrame and as SQL text of the same meaning (``ENTITIES``, ``LINKS``, ``VECTORS``: common table expressions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = lambda c: c.cast("string")
    address = F.concat(text(i % 97 + 1), F.lit(" "), F.substring("text", 41, 80), F.lit(" "), text(F.lit(10000) + i % 53))
    return _table(spark, sf_dir, "documents").select(
        F.concat(F.lit("S"), text(i % 3 + 1), F.lit("-"), F.lpad(text(i), 7, "0")).alias("entity_id"),
        F.substring("text", 1, 40).alias("business_name"),
        F.when((i % 3 != 0) & (i % 31 == 0), F.lit(None)).otherwise(address).alias("business_address"),
        F.col("lang").alias("country"),
    )


def reference(e: DataFrame) -> DataFrame:
    return e.where(F.col("entity_id").startswith("S1-"))


def vendors(e: DataFrame) -> DataFrame:
    """The vendor pool: the bag union of both feeds."""
    return e.where(F.col("entity_id").startswith("S2-")).unionByName(e.where(F.col("entity_id").startswith("S3-")))


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id and a SHA-256 of the whole text (null for null)."""
    i = F.col("doc_id").cast("string")
    return _table(spark, sf_dir, "documents").select(F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.lpad(i, 7, "0")).alias("entity_id"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("whole"))


def entity_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a reference and a vendor record with equal whole texts."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "text")
    e = d.select("text", F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("id"))
    hashed = e.select("id", F.xxhash64("text").alias("h"), "text")
    a, b = hashed.where(F.col("id").startswith("S1-")), hashed.where(~F.col("id").startswith("S1-"))
    return a.toDF("s1_id", "h", "ta").join(b.toDF("vendor_id", "h", "tb"), "h").where("ta = tb").select("s1_id", "vendor_id")


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("s1_id"), F.col("c_nationkey").cast("string").alias("country"), F.col("c_custkey").alias("row_idx"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    score = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(0.5) + (o * 7919 % 1000) / F.lit(2000.0)).otherwise((o * 104729 % 1000) / F.lit(1250.0))
    prefix = F.when(o % 2 == 0, "S2-").otherwise("S3-")
    return _table(spark, sf_dir, "orders").select(F.concat(F.lit("S1-"), F.col("o_custkey").cast("string")).alias("s1_id"), F.concat(prefix, o.cast("string")).alias("vendor_id"), "o_orderpriority", score.alias("p"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).where(F.col("o_orderpriority") == "1-URGENT").select("s1_id", "vendor_id")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("s1_id", "vendor_id", "p")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("vendor_id")


def match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = truth(spark, sf_dir).groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list("vendor_id")), ",").alias("ids"))
    return spine(spark, sf_dir).join(ids, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"), "country")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings")


ENTITIES = """WITH e AS (SELECT concat('S', CAST(doc_id % 3 + 1 AS VARCHAR), '-', lpad(CAST(doc_id AS VARCHAR), 7, '0')) AS entity_id, substr(text, 1, 40) AS business_name,
  CASE WHEN doc_id % 3 <> 0 AND doc_id % 31 = 0 THEN NULL ELSE concat(CAST(doc_id % 97 + 1 AS VARCHAR), ' ', substr(text, 41, 80), ' ', CAST(10000 + doc_id % 53 AS VARCHAR)) END AS business_address,
  lang AS country, text AS whole FROM documents),
s1 AS (SELECT * FROM e WHERE entity_id LIKE 'S1-%'), v AS (SELECT * FROM e WHERE entity_id NOT LIKE 'S1-%'),
et AS (SELECT s1.entity_id AS s1_id, v.entity_id AS vendor_id FROM s1 JOIN v ON s1.whole = v.whole)"""

LINKS = """WITH spine AS (SELECT concat('S1-', CAST(c_custkey AS VARCHAR)) AS s1_id, CAST(c_nationkey AS VARCHAR) AS country, c_custkey AS row_idx FROM customer),
o AS (SELECT concat('S1-', CAST(o_custkey AS VARCHAR)) AS s1_id, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'S2-' ELSE 'S3-' END, CAST(o_orderkey AS VARCHAR)) AS vendor_id, o_orderpriority AS prio,
  CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(0.5 AS DOUBLE) + (o_orderkey * 7919 % 1000) / CAST(2000.0 AS DOUBLE) ELSE (o_orderkey * 104729 % 1000) / CAST(1250.0 AS DOUBLE) END AS p FROM orders),
truth AS (SELECT s1_id, vendor_id FROM o WHERE prio = '1-URGENT'), cand AS (SELECT s1_id, vendor_id, p FROM o WHERE prio IN ('1-URGENT', '2-HIGH')),
pred AS (SELECT * FROM cand WHERE p >= CAST(0.6 AS DOUBLE)),
gt AS (SELECT s.s1_id AS source1_entity_id, country, coalesce(t.l, []) AS match_list, len(coalesce(t.l, [])) AS match_count FROM spine s LEFT JOIN (SELECT s1_id, list_sort(list(vendor_id)) AS l FROM truth GROUP BY s1_id) t ON s.s1_id = t.s1_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, vendor_id) AS rank FROM cand)"""


def scored(truth_: str = "truth", pred: str = "pred") -> str:
    """A further common table expression, sc: s1_id, country, m, k, t, f0_5."""
    return f""", mkt AS (SELECT s.s1_id, s.country, coalesce(a.m, 0) AS m, coalesce(b.k, 0) AS k, coalesce(c.t, 0) AS t FROM spine s
  LEFT JOIN (SELECT s1_id, count(DISTINCT vendor_id) AS m FROM {truth_} GROUP BY s1_id) a ON s.s1_id = a.s1_id LEFT JOIN (SELECT s1_id, count(DISTINCT vendor_id) AS k FROM {pred} GROUP BY s1_id) b ON s.s1_id = b.s1_id
  LEFT JOIN (SELECT x.s1_id, count(*) AS t FROM (SELECT DISTINCT s1_id, vendor_id FROM {truth_}) x JOIN (SELECT DISTINCT s1_id, vendor_id FROM {pred}) y ON x.s1_id = y.s1_id AND x.vendor_id = y.vendor_id GROUP BY x.s1_id) c ON s.s1_id = c.s1_id),
sc AS (SELECT *, CASE WHEN m = 0 THEN CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN k = 0 OR t = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * t / (0.25::DOUBLE * m + k) END AS f0_5 FROM mkt)"""


VECTORS = """WITH v AS (SELECT vec_id, embedding, label FROM embeddings)"""
