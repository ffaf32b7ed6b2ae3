"""All linkage queries by name, each with the SQL that says the same: profiles, matches, metrics, decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import decision, evaluate, profile
from lodestar.plans import views as V
from lodestar.sources import entities as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Numbers in the types that SQL engines agree on: 64-bit integers, doubles of six places."""
    return df.select(*(F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.round(F.col(f"`{c}`").cast("double"), 6).alias(c) if t in ("double", "float") or t.startswith("decimal") else F.col(f"`{c}`") for c, t in df.dtypes))


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


E, L = V.ENTITIES, V.LINKS


@query(E + " SELECT entity_id, business_name, business_address, country FROM e")
def scan_entities(spark, d):
    return V.entities(spark, d)


@query(E + " SELECT entity_id, business_name, business_address, country FROM e ORDER BY entity_id LIMIT 100")
def head_n(spark, d):
    return S.head_n(V.entities(spark, d), 100, "entity_id")


@query(E + r" SELECT entity_id, regexp_replace(coalesce(business_name, ''), '^\s+|\s+$', '', 'g') AS business_name, regexp_replace(coalesce(business_address, ''), '^\s+|\s+$', '', 'g') AS business_address, country FROM e")
def load_entities(spark, d):
    return S.load_entities(V.entities(spark, d))


@query(L + " SELECT source1_entity_id, array_to_string(match_list, ',') AS ids, match_count FROM gt")
def gt_parse(spark, d):
    return S.parse_matches(V.match_table(spark, d)).select("source1_entity_id", F.array_join("match_list", ",").alias("ids"), "match_count")


@query(L + " SELECT source1_entity_id AS s1_id, unnest(match_list) AS vendor_id FROM gt")
def gt_explode(spark, d):
    return S.explode_matches(S.parse_matches(V.match_table(spark, d)))


@query(L + " SELECT source1_entity_id, match_list[1] AS first_id FROM gt")
def first_match(spark, d):
    return S.first_match(S.parse_matches(V.match_table(spark, d)))


@query(E + " SELECT entity_id, country FROM e")
def project(spark, d):
    return V.entities(spark, d).select("entity_id", "country")


@query(E + " SELECT entity_id, business_name FROM e WHERE country = 'fr'")
def filter_eq(spark, d):
    return V.entities(spark, d).where(F.col("country") == "fr").select("entity_id", "business_name")


@query(E + " SELECT entity_id, business_address IS NULL AS missing FROM e WHERE business_address IS NULL OR country = 'de'")
def filter_null(spark, d):
    e = V.entities(spark, d)
    return e.where(F.col("business_address").isNull() | (F.col("country") == "de")).select("entity_id", F.col("business_address").isNull().alias("missing"))


@query(E + " SELECT count(*) FILTER (business_name = '') AS business_name, count(*) FILTER (business_address = '') AS business_address, count(*) FILTER (country = '') AS country FROM e")
def empty_strings(spark, d):
    return profile.empty_strings(V.entities(spark, d), "business_name", "business_address", "country")


@query(L + " SELECT s1_id, country FROM spine WHERE s1_id IN (SELECT s1_id FROM truth)")
def semi_join(spark, d):
    return V.spine(spark, d).join(V.truth(spark, d).select("s1_id"), "s1_id", "left_semi").select("s1_id", "country")


@query(L + " SELECT g.source1_entity_id, s.country, g.match_count FROM gt g LEFT JOIN spine s ON g.source1_entity_id = s.s1_id")
def left_join_country(spark, d):
    gt = S.parse_matches(V.match_table(spark, d)).drop("country")
    return gt.join(V.spine(spark, d), F.col("source1_entity_id") == F.col("s1_id"), "left").select("source1_entity_id", "country", "match_count")


@query(L + ", a AS (SELECT DISTINCT s1_id AS id FROM spine), b AS (SELECT DISTINCT source1_entity_id AS id FROM gt WHERE match_count > 0) SELECT (SELECT count(*) FROM a) AS n_s1, (SELECT count(*) FROM b) AS n_gt, (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS s1_only, (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS gt_only, round((SELECT count(*) FROM a WHERE id IN (SELECT id FROM b)) / (SELECT count(*) FROM a)::DOUBLE, 6) AS coverage")
def gt_coverage(spark, d):
    return profile.gt_coverage(V.spine(spark, d), S.parse_matches(V.match_table(spark, d)).where("match_count > 0"))


@query(L + ", k AS (SELECT DISTINCT vendor_id FROM o WHERE prio <> '1-URGENT' OR vendor_id LIKE 'S2-%') SELECT substr(t.vendor_id, 1, 2) AS source, count(*) AS links, count(*) FILTER (k.vendor_id IS NULL) AS orphans FROM truth t LEFT JOIN k ON t.vendor_id = k.vendor_id GROUP BY 1")
def orphan_ids(spark, d):
    known = V._orders(spark, d).where((F.col("o_orderpriority") != "1-URGENT") | F.col("vendor_id").startswith("S2-"))
    return profile.orphans(V.truth(spark, d), known)


@query(E + ", l AS (SELECT s1_id, vendor_id, row_number() OVER (PARTITION BY s1_id ORDER BY vendor_id) - 1 AS pos, dense_rank() OVER (ORDER BY s1_id) AS r FROM et) SELECT s1_id AS source1_entity_id, pos, vendor_id, a.business_name AS s1_name, b.business_name AS vendor_name FROM l LEFT JOIN e a ON a.entity_id = s1_id LEFT JOIN e b ON b.entity_id = vendor_id WHERE r <= 10 AND pos < 3")
def compare_matched(spark, d):
    lists = V.entity_truth(spark, d).groupBy("s1_id").agg(F.array_sort(F.collect_list("vendor_id")).alias("match_list"))
    parsed = lists.select(F.col("s1_id").alias("source1_entity_id"), "match_list", F.size("match_list").alias("match_count"))
    return profile.compare_matched(parsed, V.entities(spark, d))


@query(E + " SELECT count(*) AS n, count(*) FILTER (entity_id LIKE 'S1-%') AS s1, count(*) FILTER (entity_id LIKE 'S2-%') AS s2, count(*) FILTER (entity_id LIKE 'S3-%') AS s3 FROM e")
def row_counts(spark, d):
    at = F.substring("entity_id", 1, 2)
    return V.entities(spark, d).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(at == s).alias(s.lower()) for s in ("S1", "S2", "S3")))


@query(E + " SELECT country AS value, count(*) AS n FROM e GROUP BY 1")
def value_counts(spark, d):
    return profile.value_counts(V.entities(spark, d), "country")


@query(E + " SELECT substr(entity_id, 1, 3) AS value, count(*) AS n FROM e GROUP BY 1")
def id_prefix_counts(spark, d):
    return profile.value_counts(V.entities(spark, d), F.substring("entity_id", 1, 3))


@query(E + ", c AS (SELECT count(*) AS n, count(*) FILTER (entity_id IS NULL) AS a, count(*) FILTER (business_name IS NULL) AS b, count(*) FILTER (business_address IS NULL) AS c, count(*) FILTER (country IS NULL) AS d FROM e), u AS (SELECT n, 'entity_id' AS col, a AS nulls FROM c UNION ALL SELECT n, 'business_name', b FROM c UNION ALL SELECT n, 'business_address', c FROM c UNION ALL SELECT n, 'country', d FROM c) SELECT col AS \"column\", nulls, CASE WHEN n > 0 THEN round(nulls * 100.0::DOUBLE / n, 1) ELSE 0.0 END AS pct FROM u")
def null_profile(spark, d):
    return profile.null_profile(V.entities(spark, d))


@query(E + ", r AS (SELECT entity_id FROM e UNION ALL SELECT entity_id FROM e WHERE country = 'fr') SELECT count(*) AS n_rows, count(DISTINCT entity_id) AS n_ids, count(*) - count(DISTINCT entity_id) AS duplicates FROM r")
def dup_ids(spark, d):
    e = V.entities(spark, d).select("entity_id", "country")
    return profile.duplicate_ids(e.unionByName(e.where("country = 'fr'")))


_LEN = "round(avg(length({0})), 6) AS mean, round(median(length({0}))::DOUBLE, 6) AS median, min(length({0})) AS least, max(length({0})) AS most"


@query(E + f" SELECT substr(entity_id, 1, 2) AS source, {_LEN.format('business_address')} FROM e WHERE business_address IS NOT NULL GROUP BY 1")
def length_stats(spark, d):
    return profile.length_stats(V.entities(spark, d), "business_address", profile.source())


@query(E + f" SELECT substr(entity_id, 1, 2) AS source, country, {_LEN.format('business_name')} FROM e WHERE business_name IS NOT NULL GROUP BY 1, 2")
def length_by_country(spark, d):
    return profile.length_stats(V.entities(spark, d), "business_name", profile.source(), "country")


@query(L + " SELECT match_count, count(*) AS n FROM gt GROUP BY 1")
def match_histogram(spark, d):
    return profile.match_histogram(S.parse_matches(V.match_table(spark, d)))


_PCT = "round(count(*) FILTER (match_count {0}) * 100.0::DOUBLE / count(*), 2) AS {1}_pct"


@query(L + f" SELECT country, count(*) AS n, count(*) FILTER (match_count = 0) AS none, count(*) FILTER (match_count = 1) AS one, count(*) FILTER (match_count > 1) AS many, {_PCT.format('= 0', 'none')}, {_PCT.format('= 1', 'one')}, {_PCT.format('> 1', 'many')}, round(avg(match_count), 6) AS mean_matches FROM gt GROUP BY ROLLUP (country)")
def singleton_split(spark, d):
    return profile.singleton_split(S.parse_matches(V.match_table(spark, d)))


@query(L + " SELECT substr(vendor_id, 1, 2) AS source, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM truth GROUP BY 1")
def match_source_share(spark, d):
    return profile.match_source_share(V.truth(spark, d))


@query(E + " SELECT substr(entity_id, 1, 2) AS source, country, count(*) AS n, count(*) FILTER (business_address IS NULL) AS nulls, round(count(*) FILTER (business_address IS NULL) * 100.0::DOUBLE / count(*), 2) AS pct FROM e GROUP BY 1, 2")
def null_addr_by_country(spark, d):
    return profile.null_by(V.entities(spark, d), "business_address")


_WORDS = ", w AS (SELECT country, unnest(regexp_split_to_array(lower(business_name), '\\s+')) AS token FROM e), t AS (SELECT * FROM w WHERE token <> '' AND regexp_full_match(token, '[\\x00-\\x7F]+'))"


@query(E + _WORDS + " SELECT token, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, token LIMIT 20")
def top_tokens(spark, d):
    return profile.top_tokens(V.entities(spark, d), 20)


@query(E + _WORDS + ", c AS (SELECT country, token, count(*) AS n FROM t WHERE length(token) > 2 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, token) AS rank FROM c) SELECT * FROM r WHERE rank <= 10")
def top_tokens_by_country(spark, d):
    return profile.top_tokens(V.entities(spark, d), 10, "country", longer=2)


@query(L + ", x AS (SELECT s1_id, vendor_id FROM truth UNION ALL SELECT 'S1-0', vendor_id FROM truth WHERE vendor_id LIKE 'S2-%0'), p AS (SELECT vendor_id, count(*) AS n, count(DISTINCT s1_id) AS o FROM x GROUP BY 1) SELECT count(*) AS ids, CAST(sum(n) AS BIGINT) AS links, count(*) FILTER (o > 1) AS shared FROM p")
def shared_vendor_ids(spark, d):
    t = V.truth(spark, d)
    return profile.shared_vendor_ids(t.unionByName(t.where(F.col("vendor_id").like("S2-%0")).withColumn("s1_id", F.lit("S1-0"))))


@query(E + " SELECT substr(entity_id, 1, 2) AS source, country, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY substr(entity_id, 1, 2))::DOUBLE, 6) AS share FROM e GROUP BY 1, 2")
def country_mix(spark, d):
    return profile.country_mix(V.entities(spark, d))


@query(E + " SELECT substr(entity_id, 1, 2) AS source, country, count(*) FILTER (CAST(substr(entity_id, 4) AS BIGINT) % 2 = 0) AS train, count(*) FILTER (CAST(substr(entity_id, 4) AS BIGINT) % 2 = 1) AS test FROM e GROUP BY 1, 2")
def split_compare(spark, d):
    e, odd = V.entities(spark, d), F.substring("entity_id", 4, 20).cast("long") % 2
    return profile.split_compare(e.where(odd == 0), e.where(odd == 1))


_POST = r"regexp_extract_all(' ' || regexp_replace(coalesce(business_address, ''), '([^0-9A-Za-z_\-])', '\1\1', 'g') || ' ', '[^\p{L}\p{N}_]((?:[0-9]{5}(?:-[0-9]{4})?|[0-9]{6}))(?:[^\p{L}\p{N}_]|$)', 1)"


@query(E + f" SELECT substr(entity_id, 1, 2) AS source, country, CAST(sum(len(list_filter({_POST}, lambda z: length(z) = 6))) AS BIGINT) AS n FROM e GROUP BY 1, 2")
def six_digit_tokens(spark, d):
    return profile.six_digit_tokens(V.entities(spark, d))


def _has(c: str, p: str, name: str) -> str:
    return f"count(*) FILTER (regexp_matches(coalesce({c}, ''), '{p}')) AS {name}"


@query(E + " SELECT substr(entity_id, 1, 2) AS source, country, " + ", ".join(_has("business_name", rf"(?i)\b{s}\b", s) for s in profile.SUFFIXES) + " FROM e GROUP BY 1, 2")
def suffix_counts(spark, d):
    return profile.suffix_counts(V.entities(spark, d))


@query(E + " SELECT substr(entity_id, 1, 2) AS source, " + ", ".join(f"count(*) FILTER (contains(business_name, '{v}')) AS {k}" for k, v in profile.SIGNS.items()) + ", " + _has("business_name", "[()]", "paren") + " FROM e GROUP BY 1")
def special_chars(spark, d):
    return profile.special_chars(V.entities(spark, d))


@query(E + ", h AS (" + " UNION ALL ".join(f"SELECT substr(entity_id, 1, 2) AS source, '{k}' AS word, {' + '.join(rf'''CAST(regexp_matches(coalesce(business_address, ''), '(?i)\b{p}\b') AS INT)''' for p in ps)} AS n FROM e" for k, ps in profile.ADDRESS_PATTERNS.items()) + ") SELECT source, word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1, 2")
def addr_abbrev(spark, d):
    return profile.address_abbreviations(V.entities(spark, d))


@query(E + " SELECT substr(entity_id, 1, 2) AS source, country, " + ", ".join((_has("business_address", r"\b[0-9]{6}\b", "six_digits"), _has("business_address", rf"(?i)\b(?:{'|'.join(profile.LANDMARKS)})\b", "landmark"), _has("business_name", "[ऀ-ॿ]", "devanagari_name"), _has("business_address", "[ऀ-ॿ]", "devanagari_address"), _has("business_address", r"(?i)\b(?:floor|flr)\b", "floor"))) + " FROM e GROUP BY 1, 2")
def region_patterns(spark, d):
    return profile.region_patterns(V.entities(spark, d))


@query(E + " SELECT substr(entity_id, 1, 2) AS source, " + ", ".join((_has("business_name", r"[^\x00-\x7F]", "name_non_ascii"), _has("business_address", r"[^\x00-\x7F]", "address_non_ascii"))) + ", count(*) FILTER (contains(business_name, '�') OR contains(coalesce(business_address, ''), '�')) AS replacement FROM e GROUP BY 1")
def encoding_profile(spark, d):
    return profile.encoding_profile(V.entities(spark, d))


@query(E + r" SELECT substr(entity_id, 1, 2) AS source, round(avg(length(business_address) - length(replace(business_address, ',', ''))), 6) AS commas, count(*) FILTER (regexp_matches(business_address, '(^|[^\p{L}\p{N}_])[A-Z]{2}([^\p{L}\p{N}_]|$)')) AS state_codes FROM e WHERE business_address IS NOT NULL GROUP BY 1")
def addr_components(spark, d):
    return profile.address_components(V.entities(spark, d))


# ---- metrics


def _pred(spark, d):
    return V.candidates(spark, d).where(F.col("p") >= 0.6)


def _scores(spark, d, *keep):
    return evaluate.score_entities(V.spine(spark, d), V.truth(spark, d), _pred(spark, d), *keep)


SC = L + V.scored()


@query(SC + " SELECT s1_id, m, k, t, round(f0_5, 6) AS f0_5 FROM sc")
def score_entities(spark, d):
    return _scores(spark, d)


@query(SC + " SELECT round(avg(f0_5), 6) AS macro_f0_5 FROM sc")
def macro_f05(spark, d):
    return evaluate.macro(_scores(spark, d))


@query(SC + " SELECT round(1.25::DOUBLE * sum(t) / (0.25::DOUBLE * sum(m) + sum(k)), 6) AS pooled_f0_5, CAST(sum(m) AS BIGINT) AS m, CAST(sum(k) AS BIGINT) AS k, CAST(sum(t) AS BIGINT) AS t FROM sc")
def pooled_f05(spark, d):
    return evaluate.pooled(_scores(spark, d))


@query(SC + " SELECT country, count(*) AS n, round(avg(f0_5), 6) AS macro_f0_5, count(*) FILTER (m = 0) AS singletons FROM sc GROUP BY ROLLUP (country)")
def macro_by_country(spark, d):
    return evaluate.macro_by(_scores(spark, d, "country"), "country")


@query(SC + " SELECT CAST(sum(m) AS BIGINT) AS m, CAST(sum(k) AS BIGINT) AS k, CAST(sum(t) AS BIGINT) AS t, round(sum(t) / sum(k)::DOUBLE, 6) AS precision, round(sum(t) / sum(m)::DOUBLE, 6) AS recall FROM sc")
def pair_pr(spark, d):
    return evaluate.pair_scores(_scores(spark, d))


@query(SC + " SELECT count(*) FILTER (m = 0) AS singletons, count(*) FILTER (k = 0) AS silent, round(count(*) FILTER (m = 0 AND k = 0) / count(*) FILTER (k = 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (m = 0 AND k = 0) / count(*) FILTER (m = 0)::DOUBLE, 6) AS recall FROM sc")
def singleton_slice(spark, d):
    return evaluate.singleton_slice(_scores(spark, d))


@query(SC + ", f AS (SELECT c.s1_id, count(*) AS found FROM cand c JOIN truth t ON c.s1_id = t.s1_id AND c.vendor_id = t.vendor_id WHERE c.p < 0.95 GROUP BY 1) SELECT sc.s1_id, CASE WHEN m = k AND k = t THEN 'CORRECT' WHEN m = 0 AND k > 0 THEN 'SINGLETON_ERROR' WHEN coalesce(found, 0) < m THEN 'WRONG_RETRIEVAL' WHEN m > 1 AND t < m AND k = t THEN 'MULTI_MATCH_ERROR' WHEN t < m AND k = t THEN 'FALSE_NEGATIVE' ELSE 'FALSE_POSITIVE' END AS label FROM sc LEFT JOIN f ON sc.s1_id = f.s1_id")
def error_taxonomy(spark, d):
    found = V.candidates(spark, d).where(F.col("p") < 0.95).join(V.truth(spark, d), ["s1_id", "vendor_id"]).groupBy("s1_id").agg(F.count(F.lit(1)).alias("found"))
    return evaluate.taxonomy(_scores(spark, d), found)


@query(SC + ", c AS (SELECT country, avg(f0_5) AS macro FROM sc GROUP BY 1) SELECT round(sum(macro * share) / sum(share), 6) AS reweighted FROM c JOIN (VALUES ('1', 0.3827::DOUBLE), ('2', 0.4675::DOUBLE), ('3', 0.1498::DOUBLE)) AS x(country, share) ON c.country = x.country")
def reweighted_f05(spark, d):
    per = _scores(spark, d, "country").groupBy("country").agg(F.avg("f0_5").alias("macro"))
    return evaluate.reweighted(per, spark.createDataFrame([("1", 0.3827), ("2", 0.4675), ("3", 0.1498)], "country string, share double"))


_TAUS = (0.3, 0.5, 0.6, 0.7, 0.8, 0.9)


@query(L + ", g AS (SELECT s1_id, max(p) AS score FROM cand GROUP BY 1), q AS (SELECT CASE WHEN CAST(substr(s1_id, 4) AS BIGINT) % 4 = 0 THEN 'test' WHEN s1_id IN (SELECT s1_id FROM truth) THEN 'other' ELSE 'single' END AS part, score FROM g), f AS (SELECT tau, avg(CAST(score <= tau AS INT)) FILTER (part = 'single') AS a, avg(CAST(score <= tau AS INT)) FILTER (part = 'other') AS b, avg(CAST(score <= tau AS INT)) FILTER (part = 'test') AS c FROM q, (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in _TAUS) + ") AS t(tau) GROUP BY tau) SELECT tau, round(greatest(0.0, least(1.0, (c - b) / (a - b))), 6) AS pi FROM f WHERE abs(a - b) >= 1e-6")
def mixture_pi(spark, d):
    best = V.candidates(spark, d).groupBy("s1_id").agg(F.max("p").alias("score"))
    known = V.truth(spark, d).select("s1_id").distinct().withColumn("has", F.lit(1))
    part = F.when(F.substring("s1_id", 4, 20).cast("long") % 4 == 0, "test").when(F.col("has") == 1, "other").otherwise("single")
    return evaluate.mixture(best.join(known, "s1_id", "left").select(part.alias("part"), "score"), spark.createDataFrame([(t,) for t in _TAUS], "tau double"))


# ---- decisions

_PRIOR = decision.PRIOR["reference"]
_CURVE = (
    L + ", cum AS (SELECT *, sum(p) OVER (PARTITION BY s1_id ORDER BY rank) AS s FROM ranked WHERE rank <= 10), pr(m, q) AS (VALUES " + ", ".join(f"({m}, {q}::DOUBLE)" for m, q in enumerate(_PRIOR) if m) + ")"
    ", curve AS (SELECT s1_id, 0 AS k, 0.055847::DOUBLE AS e FROM ranked WHERE rank = 1 UNION ALL SELECT c.s1_id, c.rank, round(sum(q * 1.25::DOUBLE * b.s / (0.25::DOUBLE * m + c.rank)), 12) FROM cum c, pr JOIN cum b ON true WHERE b.s1_id = c.s1_id AND b.rank = least(pr.m, c.rank) GROUP BY c.s1_id, c.rank)"
    ", chosen AS (SELECT s1_id, k, e FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY e DESC, k) AS r FROM curve) WHERE r = 1)"
)


@query(_CURVE + " SELECT s1_id, CAST(k AS BIGINT) AS k, round(e, 6) AS e FROM curve")
def expected_f05(spark, d):
    return decision.expected_curve(V.candidates(spark, d))


@query(_CURVE + " SELECT s1_id, CAST(k AS BIGINT) AS k, round(e, 6) AS e FROM chosen")
def choose_k(spark, d):
    return decision.choose_k(decision.expected_curve(V.candidates(spark, d)))


@query(_CURVE + " SELECT r.s1_id, vendor_id, round(p, 6) AS p, r.rank FROM ranked r JOIN chosen c ON r.s1_id = c.s1_id WHERE rank <= k")
def emit_topk(spark, d):
    c = V.candidates(spark, d)
    return decision.emit_top(c, decision.choose_k(decision.expected_curve(c)))


@query(_CURVE + ", em AS (SELECT r.s1_id, r.vendor_id FROM ranked r JOIN chosen c ON r.s1_id = c.s1_id WHERE rank <= k)" + V.scored("truth", "em") + " SELECT round(avg(f0_5), 6) AS macro_f0_5 FROM sc")
def policy_expected(spark, d):
    return evaluate.macro(evaluate.score_entities(V.spine(spark, d), V.truth(spark, d), emit_topk(spark, d)))


@query(L + ", c AS (SELECT *, sum(p) OVER (PARTITION BY s1_id ORDER BY rank) AS s FROM ranked WHERE rank <= 10), pr(m, q) AS (VALUES " + ", ".join(f"({m}, {q}::DOUBLE)" for m, q in enumerate(_PRIOR) if m) + ") SELECT DISTINCT s1_id, 0::BIGINT AS k, 0.055847::DOUBLE AS e FROM ranked UNION ALL SELECT s1_id, rank, round(sum(q * (1 - 0.055847::DOUBLE) * 1.25::DOUBLE * s / (0.25::DOUBLE * m + rank)), 6) FROM c, pr GROUP BY s1_id, rank")
def expected_f05_doc(spark, d):
    return decision.expected_curve_doc(V.candidates(spark, d))


@query(L + " SELECT s1_id, vendor_id, round(p, 6) AS p, rank FROM ranked WHERE rank <= 5")
def rank_candidates(spark, d):
    return decision.rank_candidates(V.candidates(spark, d), 5)


@query(L + " SELECT s1_id, vendor_id, round(p, 6) AS p, rank FROM ranked WHERE p >= 0.7")
def policy_threshold(spark, d):
    return decision.policy_threshold(V.candidates(spark, d), 0.7)


@query(L + ", n AS (SELECT *, coalesce(lead(p) OVER (PARTITION BY s1_id ORDER BY rank), 0.0::DOUBLE) AS nx FROM ranked), g AS (SELECT *, min(CASE WHEN p >= 0.5 AND p - nx >= 0.02::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY s1_id ORDER BY rank) AS ok FROM n) SELECT s1_id, vendor_id, round(p, 6) AS p, rank FROM g WHERE ok = 1")
def policy_margin(spark, d):
    return decision.policy_margin(V.candidates(spark, d), 0.5, 0.02)


@query(L + " SELECT s1_id, vendor_id, round(p, 6) AS p, round(max(p) OVER w, 6) AS best, round(sum(p) OVER w, 4) AS total, count(*) OVER w AS n_cand, rank, round(p - coalesce(lead(p) OVER (PARTITION BY s1_id ORDER BY rank), 0.0::DOUBLE), 6) AS margin FROM ranked WINDOW w AS (PARTITION BY s1_id)")
def entity_meta(spark, d):
    return decision.entity_meta(V.candidates(spark, d)).withColumn("total", F.round(F.col("mean") * F.col("n_cand"), 4)).drop("mean")


@query(L + ", b AS (SELECT *, max(p) OVER (PARTITION BY s1_id) AS best FROM cand) SELECT b.s1_id, vendor_id, round(p, 6) AS p FROM b JOIN spine s ON b.s1_id = s.s1_id JOIN (VALUES ('1', 0.52::DOUBLE), ('2', 0.48::DOUBLE), ('3', 0.55::DOUBLE)) AS t(country, tau) ON s.country = t.country WHERE best >= 0.6 AND p >= tau")
def singleton_gate(spark, d):
    taus = spark.createDataFrame([("1", 0.52), ("2", 0.48), ("3", 0.55)], "country string, tau double")
    return decision.singleton_gate(V.candidates(spark, d), V.spine(spark, d), taus, 0.6)


_DOUBLE = ", claims AS (SELECT s1_id, vendor_id, p FROM cand UNION ALL SELECT concat('S1-', CAST(CAST(substr(s1_id, 4) AS BIGINT) + 1 AS VARCHAR)), vendor_id, p FROM cand WHERE vendor_id LIKE '%1')"


def _claims(spark, d):
    c = V.candidates(spark, d)
    other = F.concat(F.lit("S1-"), (F.substring("s1_id", 4, 20).cast("long") + 1).cast("string"))
    return c.unionByName(c.where(F.col("vendor_id").endswith("1")).withColumn("s1_id", other))


@query(L + _DOUBLE + ", r AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY p DESC, s1_id) AS n FROM claims) SELECT s1_id, vendor_id, round(p, 6) AS p FROM r WHERE n = 1")
def one_to_one(spark, d):
    return decision.one_to_one(_claims(spark, d))


_GRAPH = "SELECT DISTINCT o_custkey AS a, o_custkey * 7 % 1500 + 1 AS b FROM orders"


@query(f"WITH RECURSIVE l AS ({_GRAPH}), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(node, root) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON r.node = u.a) SELECT node, min(root) AS root FROM r GROUP BY node")
def components(spark, d):
    return decision.components(V._table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") * 7 % 1500 + 1).alias("b")))


@query(L + ", em AS (SELECT s1_id, string_agg(vendor_id, ',' ORDER BY rank) AS ids FROM ranked WHERE p >= 0.7 GROUP BY 1) SELECT row_idx, s.s1_id AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM spine s LEFT JOIN em ON s.s1_id = em.s1_id")
def submission(spark, d):
    return S.submission(V.spine(spark, d), decision.policy_threshold(V.candidates(spark, d), 0.7))


@query("SELECT 0::BIGINT AS missing_rows, 0::BIGINT AS extra_rows, 0::BIGINT AS out_of_order, 0::BIGINT AS null_words, 0::BIGINT AS with_space, 0::BIGINT AS bad_prefix, 0::BIGINT AS unknown_ids, 0::BIGINT AS repeated_rows")
def submission_validate(spark, d):
    return S.validate_submission(submission(spark, d), V.spine(spark, d), V.pool(spark, d))


@query(L + " SELECT s1_id, vendor_id FROM truth INTERSECT SELECT s1_id, vendor_id FROM pred")
def set_intersect(spark, d):
    return V.truth(spark, d).intersect(_pred(spark, d).select("s1_id", "vendor_id"))


@query(L + " SELECT s1_id, vendor_id FROM truth EXCEPT SELECT s1_id, vendor_id FROM pred")
def set_except(spark, d):
    return V.truth(spark, d).subtract(_pred(spark, d).select("s1_id", "vendor_id"))


@query(E + " SELECT entity_id, country FROM v")
def union_vendor(spark, d):
    return V.vendors(V.entities(spark, d)).select("entity_id", "country")


@query(E + " SELECT count(*) AS n_rows, count(*) FILTER (entity_id IS NULL) AS null_entity_id, count(*) FILTER (business_name IS NULL) AS null_business_name, count(*) FILTER (business_address IS NULL) AS null_business_address, count(*) FILTER (country IS NULL) AS null_country, bit_xor(CAST('0x' || substr(md5(concat_ws('|', coalesce(entity_id, 'null'), coalesce(business_name, 'null'), coalesce(business_address, 'null'), coalesce(country, 'null'))), 1, 15) AS BIGINT)) AS checksum FROM e")
def manifest(spark, d):
    return S.manifest(V.entities(spark, d))


@query(L + ", x AS (SELECT s1_id, list(p ORDER BY rank) AS ps FROM ranked WHERE rank <= 3 GROUP BY 1 HAVING count(*) = 3) SELECT s1_id, round((1 - ps[1]) * (1 - ps[2]) * (1 - ps[3]), 6) AS p0, round(ps[1] * ps[2] * ps[3], 6) AS p3 FROM x")
def poisson_binomial(spark, d):
    top = decision.rank_candidates(V.candidates(spark, d), 3).groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p"))), lambda x: x.p).alias("ps")).where(F.size("ps") == 3)
    return top.withColumn("b", decision.poisson_binomial(F.col("ps"))).select("s1_id", F.col("b")[0].alias("p0"), F.col("b")[3].alias("p3"))
