"""From scored candidates to emitted links: expected F0.5, thresholds, gates, one-to-one assignment, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# P(an entity has m true matches), as the reference tabulates it and as measured.
PRIOR = {
    "reference": (0.055847, 0.053994, 0.170020, 0.240551, 0.219374, 0.145887, 0.074713, 0.028987, 0.008464, 0.000238, 0.000016),
    "measured": (0.055847, 0.053994, 0.170020, 0.240551, 0.219374, 0.145887, 0.074713, 0.028987, 0.008464, 0.001905, 0.000242),
}


def by_rank(key: str = "s1_id") -> Window:
    return Window.partitionBy(key).orderBy(F.col("p").desc(), "vendor_id")


def rank_candidates(cand: DataFrame, most: int | None = None) -> DataFrame:
    """Adds rank within the entity, best first, ties by id."""
    out = cand.withColumn("rank", F.row_number().over(by_rank()))
    return out if most is None else out.where(F.col("rank") <= most)


def poisson_binomial(probs: Column) -> Column:
    """P(t successes) for t = 0 ... n of independent trials, by the textbook recurrence over an array."""
    start = F.array(F.lit(1.0))
    add = lambda acc, p: F.zip_with(F.concat(F.transform(acc, lambda x: x * (1 - p)), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(acc, lambda x: x * p)), lambda a, b: a + b)
    return F.aggregate(probs, start, add)


def check_descending(probs: list[float], n: int | None = None) -> None:
    if n is not None and n != len(probs):
        raise ValueError("n_candidates and probabilities disagree")
    if any(a < b for a, b in zip(probs, probs[1:], strict=False)):
        raise ValueError("probabilities must be descending")


def expected_value(prior: tuple[float, ...], k: Column, sums: Column) -> Column:
    """Expected F0.5 of emitting the best k. sums: running sums of the probabilities, from the first.

    F0.5 is linear in the hits and 0 without any, so its mean needs the mean number of hits alone: the running sum at min(m, k).
    """
    out = None
    for m, p in enumerate(prior[1:], 1):
        term = F.lit(p) * 1.25 * F.element_at(sums, F.least(F.lit(m), k)) / (F.lit(0.25 * m) + k)
        out = term if out is None else out + term
    return out


def expected_curve(cand: DataFrame, prior: str = "reference", most: int = 10) -> DataFrame:
    """s1_id, k, e for k = 0 ... candidates (``most`` at most). cand: s1_id, vendor_id, p."""
    top = rank_candidates(cand, most).groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("rank", "p"))).alias("r"))
    probs = F.transform("r", lambda x: x.p)
    sums = F.transform(F.sequence(F.lit(1), F.size("r")), lambda k: F.aggregate(F.slice(probs, 1, k), F.lit(0.0), lambda a, x: a + x))
    each = top.withColumn("sums", sums).select("s1_id", "sums", F.explode(F.sequence(F.lit(0), F.size("r"))).alias("k"))
    value = F.when(F.col("k") == 0, F.lit(PRIOR[prior][0])).otherwise(expected_value(PRIOR[prior], F.greatest("k", F.lit(1)), F.col("sums")))
    return each.select("s1_id", "k", F.round(value, 12).alias("e"))


def expected_curve_doc(cand: DataFrame, pi: float = 0.055847, most: int = 10) -> DataFrame:
    """The documents' variant: hits aren't bounded by m, and the prior of m >= 1 is scaled by (1 - pi) once more."""
    w = by_rank().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rank_candidates(cand, most).withColumn("hits", F.sum("p").over(w))
    total = sum((F.lit(p * (1 - pi)) * 1.25 * F.col("hits") / (F.lit(0.25 * m) + F.col("rank")) for m, p in enumerate(PRIOR["reference"][1:], 1)), F.lit(0.0))
    zero = ranked.select("s1_id").distinct().select("s1_id", F.lit(0).alias("k"), F.lit(pi).alias("e"))
    return zero.unionByName(ranked.select("s1_id", F.col("rank").alias("k"), F.round(total, 12).alias("e")))


def choose_k(curve: DataFrame) -> DataFrame:
    """s1_id, k, e: the best k, the least of equals."""
    return curve.groupBy("s1_id").agg(F.max(F.struct("e", (-F.col("k")).alias("n"))).alias("b")).select("s1_id", (-F.col("b.n")).alias("k"), F.col("b.e").alias("e"))


def emit_top(cand: DataFrame, chosen: DataFrame) -> DataFrame:
    """The best k candidates of each entity."""
    return rank_candidates(cand).join(chosen.select("s1_id", "k"), "s1_id").where(F.col("rank") <= F.col("k")).select("s1_id", "vendor_id", "p", "rank")


def policy_threshold(cand: DataFrame, tau: float) -> DataFrame:
    return rank_candidates(cand.where(F.col("p") >= tau))


def policy_margin(cand: DataFrame, tau: float, delta: float) -> DataFrame:
    """Emits from the top while p >= tau and the lead over the next (0 after the last) is delta or more; stops at the first that isn't."""
    ranked = rank_candidates(cand).withColumn("next", F.coalesce(F.lead("p").over(by_rank()), F.lit(0.0)))
    good = ((F.col("p") >= tau) & (F.col("p") - F.col("next") >= delta)).cast("int")
    return ranked.withColumn("ok", F.min(good).over(by_rank().rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("ok = 1").drop("ok", "next")


def entity_meta(cand: DataFrame) -> DataFrame:
    """Adds the entity's best, mean and number of candidates, and the lead of its best."""
    w, top = Window.partitionBy("s1_id"), by_rank()
    out = cand.withColumns({"best": F.max("p").over(w), "mean": F.avg("p").over(w), "n_cand": F.count(F.lit(1)).over(w), "rank": F.row_number().over(top), "margin": F.col("p") - F.coalesce(F.lead("p").over(top), F.lit(0.0))})
    return out


def singleton_gate(cand: DataFrame, spine: DataFrame, thresholds: DataFrame, tau_single: float) -> DataFrame:
    """Links p >= the country's tau (a configured row per country), none for an entity whose best is under tau_single."""
    best = cand.withColumn("best", F.max("p").over(Window.partitionBy("s1_id")))
    return best.join(spine.select("s1_id", "country"), "s1_id").join(F.broadcast(thresholds), "country").where((F.col("best") >= tau_single) & (F.col("p") >= F.col("tau"))).select("s1_id", "vendor_id", "p")


def one_to_one(links: DataFrame) -> DataFrame:
    """Each vendor record goes to its best entity, ties by id: the greedy result, since entities may take many."""
    w = Window.partitionBy("vendor_id").orderBy(F.col("p").desc(), "s1_id")
    return links.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def components(links: DataFrame) -> DataFrame:
    """node, root of the graph of links (a, b): root is the least node that links lead to.

    Every round hangs nodes on the least of their neighbours, larger ones first and then each node's own least ones, until all of a
    component hang on one. A round leaves at most as many links as there were, so a node with very many is never joined with itself, and
    rounds grow with the logarithm of the nodes. Lineage is cut by checkpoints where a folder is set for them.
    """
    kept = bool(links.sparkSession.conf.get("spark.checkpoint.dir", None))
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now, before, seen = links.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), None, None
    while True:
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        hung = ends.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        own = hung.groupBy("a").agg(F.min("b").alias("least"))
        moved = hung.join(own, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(own.withColumnRenamed("least", "b"))
        now = moved.where("a <> b").distinct()
        now = now.checkpoint() if kept else now.persist()
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before is not None and not kept:
            before.unpersist()
        if state == seen:
            return nodes.join(now.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("root"))
        before, seen = now, state
