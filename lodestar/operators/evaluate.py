"""Scores of predicted links: per entity, macro, pooled, sliced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05(m: Column, k: Column, t: Column) -> Column:
    """F0.5 from true, emitted and hit counts; an entity without matches scores 1 if nothing was emitted."""
    return F.when(m == 0, F.when(k == 0, 1.0).otherwise(0.0)).when((k == 0) | (t == 0), 0.0).otherwise(1.25 * t / (0.25 * m + k))


def counts(spine: DataFrame, truth: DataFrame, pred: DataFrame, *keep: str) -> DataFrame:
    """s1_id, m, k, t for each row of the spine. truth and pred: s1_id, vendor_id, as sets; predictions off the spine don't count.

    Links are tagged and summed once per pair, then once per entity: two aggregations and one join, all on the entity.
    """
    for side in (truth, pred):
        for c in ("s1_id", "vendor_id"):
            if dict(side.dtypes)[c] != "string":
                raise ValueError(f"{c} must be strings")
    tagged = truth.select("s1_id", "vendor_id", F.lit(1).alias("is_true"), F.lit(0).alias("is_pred")).unionByName(pred.select("s1_id", "vendor_id", F.lit(0).alias("is_true"), F.lit(1).alias("is_pred")))
    pairs = tagged.groupBy("s1_id", "vendor_id").agg(F.max("is_true").alias("a"), F.max("is_pred").alias("b"))
    sums = pairs.groupBy("s1_id").agg(F.sum("a").alias("m"), F.sum("b").alias("k"), F.sum(F.col("a") * F.col("b")).alias("t"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("m", "k", "t")}
    return spine.select("s1_id", *keep).join(sums, "s1_id", "left").withColumns(zero)


def score_entities(spine: DataFrame, truth: DataFrame, pred: DataFrame, *keep: str) -> DataFrame:
    return counts(spine, truth, pred, *keep).withColumn("f0_5", f05(F.col("m"), F.col("k"), F.col("t")))


def macro(scores: DataFrame) -> DataFrame:
    """The mean of f0_5; NaN over no entities."""
    return scores.agg(F.coalesce(F.avg("f0_5"), F.lit(float("nan"))).alias("macro_f0_5"))


def pooled(counted: DataFrame) -> DataFrame:
    """F0.5 of the summed counts; 0 over no entities."""
    sums = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("m", "k", "t")))
    return sums.select(F.when((F.col("k") == 0) | (F.col("t") == 0), 0.0).otherwise(1.25 * F.col("t") / (0.25 * F.col("m") + F.col("k"))).alias("pooled_f0_5"), "m", "k", "t")


def macro_by(scores: DataFrame, column: str) -> DataFrame:
    """Macro by one column and overall (null)."""
    return scores.rollup(column).agg(F.count(F.lit(1)).alias("n"), F.avg("f0_5").alias("macro_f0_5"), F.count_if(F.col("m") == 0).alias("singletons"))


def pair_scores(counted: DataFrame) -> DataFrame:
    """Precision and recall over pairs."""
    s = counted.agg(*(F.sum(c).alias(c) for c in ("m", "k", "t")))
    return s.select("m", "k", "t", F.when(F.col("k") > 0, F.col("t") / F.col("k")).otherwise(0.0).alias("precision"), F.when(F.col("m") > 0, F.col("t") / F.col("m")).otherwise(0.0).alias("recall"))


def singleton_slice(scores: DataFrame) -> DataFrame:
    """Precision and recall of saying nothing."""
    silent, single = F.col("k") == 0, F.col("m") == 0
    hit = F.count_if(silent & single)
    return scores.agg(F.count_if(single).alias("singletons"), F.count_if(silent).alias("silent"), F.coalesce(F.try_divide(hit, F.count_if(silent)), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(hit, F.count_if(single)), F.lit(0.0)).alias("recall"))


def taxonomy(counted: DataFrame, retrieved: DataFrame) -> DataFrame:
    """s1_id and label of each entity. retrieved: s1_id, found (true links among the candidates)."""
    m, k, t = (F.col(c) for c in ("m", "k", "t"))
    label = (
        F.when((m == k) & (k == t), "CORRECT").when((m == 0) & (k > 0), "SINGLETON_ERROR").when(F.coalesce(F.col("found"), F.lit(0)) < m, "WRONG_RETRIEVAL")
        .when((m > 1) & (t < m) & (k == t), "MULTI_MATCH_ERROR").when((t < m) & (k == t), "FALSE_NEGATIVE").otherwise("FALSE_POSITIVE")
    )
    return counted.join(retrieved, "s1_id", "left").select("s1_id", label.alias("label"))


def foreign(name: Column) -> Column:
    """Whether a name has characters of another script than Latin."""
    return F.coalesce(name, F.lit("")).rlike(r"[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]")


def error_causes(pairs: DataFrame, common: int = 3) -> DataFrame:
    """s1_id, vendor_id and each cause that the two records show for a wrongly judged pair. pairs: ids, a_ and b_ name_norm, addr_norm, business_name (or ``foreign`` of it), country, and name_count, addr_count (vendor records that share b's).

    With ``taxonomy`` these are all labels: that one tells what went wrong with an entity, this one what is in the way of a pair.
    """
    a, b = (lambda c: F.coalesce(F.col(f"a_{c}"), F.lit(""))), (lambda c: F.coalesce(F.col(f"b_{c}"), F.lit("")))
    other = tuple(F.col(f"{x}_foreign") if f"{x}_foreign" in pairs.columns else foreign(F.col(f"{x}_business_name")) for x in "ab")
    absent = (a("addr_norm") == "") | (b("addr_norm") == "")
    tests = {
        "ADDRESS_NOISE": ~absent & (a("addr_norm") != b("addr_norm")),
        "COMMON_ADDRESS": F.coalesce(F.col("addr_count") >= common, F.lit(False)),
        "COMMON_NAME": F.coalesce(F.col("name_count") >= common, F.lit(False)),
        "COUNTRY_SHIFT": ~F.col("a_country").eqNullSafe(F.col("b_country")),
        "MISSING_ADDRESS": absent,
        "MULTILINGUAL": other[0] | other[1],
        "NAME_NOISE": a("name_norm") != b("name_norm"),
        "TRANSLITERATION": other[0] != other[1],
    }
    found = F.filter(F.array(*(F.when(t, k) for k, t in tests.items())), lambda x: x.isNotNull())
    return pairs.select("s1_id", "vendor_id", F.explode(found).alias("cause"))


def reweighted(by_country: DataFrame, mix: DataFrame) -> DataFrame:
    """Macro scores of slices averaged by the shares of another population. by_country: country, macro; mix: country, share."""
    return by_country.join(F.broadcast(mix), "country").agg((F.sum(F.col("macro") * F.col("share")) / F.sum("share")).alias("reweighted"))  # mix: a configured row per country


def mixture(scores: DataFrame, taus: DataFrame) -> DataFrame:
    """scores: part ('single', 'other', 'test'), score. For each tau the share of single entities that explains the test scores; taus that don't tell them apart are left out.

    taus is a small configured table: distribution functions are conditional counts, one pass for all taus.
    """
    table = [r.tau for r in taus.collect()]
    at = F.explode(F.array(*(F.struct(F.lit(t).alias("tau"), (F.col("score") <= t).cast("int").alias("under")) for t in table)))
    rates = scores.select("part", at.alias("x")).groupBy("x.tau").pivot("part", ["single", "other", "test"]).agg(F.avg("x.under"))
    gap = F.col("single") - F.col("other")
    return rates.where(F.abs(gap) >= 1e-6).select("tau", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("test") - F.col("other")) / gap)).alias("pi"))
