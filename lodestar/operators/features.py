"""Features of candidate pairs, by family. pairs: s1_id, vendor_id with columns a_* and b_* (see ``with_sides``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import similarity as sim
from lodestar.functions import text
from lodestar.operators.blocking import HOUSE, block_pairs, postcodes  # noqa: F401

#: Spellings of one legal form.
LEGAL_CLASSES = {"corporation": "corp", "incorporated": "inc", "private": "pvt", "limited": "ltd", "company": "co"}


def with_sides(pairs: DataFrame, s1: DataFrame, vendors: DataFrame, *columns: str) -> DataFrame:
    """pairs with the named columns of both records, as a_... and b_...; two equi-joins on ids."""
    left = s1.select(F.col("entity_id").alias("s1_id"), *(F.col(c).alias(f"a_{c}") for c in columns))
    right = vendors.select(F.col("entity_id").alias("vendor_id"), *(F.col(c).alias(f"b_{c}") for c in columns))
    return pairs.join(left, "s1_id").join(right, "vendor_id")


def _ab(c: str) -> tuple[Column, Column]:
    return F.col(f"a_{c}"), F.col(f"b_{c}")


def _numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[0-9]+"), F.lit(0)))


def exact(c: str = "name_norm") -> Column:
    a, b = _ab(c)
    return (a == b) & (F.length(a) > 0)


def token_jaccard(c: str = "name_norm") -> Column:
    return sim.jaccard(*(text.tokens_of(x) for x in _ab(c)))


def set_jaccard(c: str) -> Column:
    """Jaccard similarity of two sets (arrays without repeats)."""
    a, b = _ab(c)
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def trigram_jaccard(c: str = "name_norm") -> Column:
    return sim.jaccard(*(text.grams(x, 3) for x in _ab(c)))


def levenshtein(c: str = "name_norm") -> Column:
    return F.levenshtein(*_ab(c))


def lengths(characters: str = "characters", tokens: str = "tokens") -> dict[str, Column]:
    """characters, tokens: how many a record has."""
    (a, b), (na, nb) = _ab(characters), _ab(tokens)
    return {"length_gap": F.abs(a - b), "length_ratio": sim.ratio_of(a, b), "token_gap": F.abs(na - nb)}


def first_token(first: str = "first", sound: str = "sound") -> dict[str, Column]:
    """first, sound: the first word of a record in lower case, and its code."""
    equal = lambda a, b: F.coalesce(a == b, F.lit(False))
    return {"first_equal": equal(*_ab(first)), "sound_equal": equal(*_ab(sound))}


def legal_forms(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for p in LEGAL_CLASSES.items() for x in p))
    forms = F.filter(text.tokens_of(c), lambda t: t.isin(sorted(text.LEGAL_TOKENS - set("and the of und et".split()))))
    return F.array_distinct(F.transform(forms, lambda t: F.coalesce(F.try_element_at(table, t), t)))


def legal(c: str = "forms") -> dict[str, Column]:
    """Whether both names have a common legal form, or each its own. c: ``legal_forms`` of names cleaned, legal forms kept."""
    a, b = _ab(c)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return {"legal_agree": both & F.arrays_overlap(a, b), "legal_conflict": both & ~F.arrays_overlap(a, b)}


def numbers(c: str = "business_address") -> dict[str, Column]:
    a, b = (F.coalesce(x, F.lit("")) for x in _ab(c))
    house = tuple(F.regexp_extract(F.lower(x), HOUSE, 1) for x in (a, b))
    return {"number_overlap": F.arrays_overlap(_numbers(a), _numbers(b)), "house_equal": (house[0] == house[1]) & (house[0] != ""), "postcode_equal": F.arrays_overlap(*(F.transform(postcodes(x), lambda z: F.substring(z, 1, 5)) for x in (a, b)))}


def landmark_words(c: Column) -> Column:
    """The words among the three after near, opposite, behind."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"(?:near|opposite|behind) ((?:\S+ ?){1,3})"), F.lit(1)), lambda s: F.split(F.trim(s), " "))))


def name_in_address() -> Column:
    a, b = F.col("a_name_norm"), F.col("b_addr_norm")
    return (F.length(a) > 0) & F.contains(b, a)


def missing() -> dict[str, Column]:
    """words: the distinct words of a record's address."""
    a, b = _ab("has_address")
    return {"both_addresses": a & b, "address_jaccard": F.when(a & b, set_jaccard("words"))}


def cross() -> dict[str, Column]:
    """source: what an id begins with."""
    return {"same_country": F.col("a_country") == F.col("b_country"), "sources": F.concat_ws("-", *_ab("source"))}


def affixes(c: str = "name_norm") -> dict[str, Column]:
    """How many characters both begin and end with."""
    both = _affixes(*_ab(c))
    return {k: both[k] for k in ("prefix", "suffix")}


def sound_alikes(c: str = "name_norm") -> Column:
    """Whether tokens that only one of the names has are spellings of one word by the table of sound-alikes."""
    a, b = (text.tokens_of(x) for x in _ab(c))
    known = F.create_map(*(F.lit(x) for pair in text.SOUND_ALIKE_TOKENS.items() for x in pair))
    word = lambda t: F.transform(t, lambda x: F.coalesce(known[x], x))
    return F.arrays_overlap(word(F.array_except(a, b)), word(F.array_except(b, a)))


def retrieval(cand: DataFrame) -> DataFrame:
    """Evidence of retrieval: how many strategies agree, and how many entities a vendor record is a candidate of. cand: of ``blocking.union_lists`` with claims."""
    by = (F.array_contains("strategies", s).alias(f"by_{s}") for s in ("name_prefix", "postcode", "soundex"))
    return cand.select("s1_id", "vendor_id", F.size("strategies").alias("n_strategies"), *by, "claimed_by")


def regional(c: str = "business_address") -> dict[str, Column]:
    """Shapes of regional addresses, as features of one side (b)."""
    b = F.coalesce(F.col(f"b_{c}"), F.lit(""))
    tests = {"zip4": r"[0-9]{5}-[0-9]{4}", "pin": r"(?<![0-9])[0-9]{6}(?![0-9])", "state": r"(?<![A-Za-z])[A-Z]{2}(?![A-Za-z])", "unit": r"(?i)(?:floor|flat|unit|suite|apt)", "bis_ter": r"(?i)[0-9] ?(?:bis|ter)(?![a-z])", "cedex": "(?i)cedex"}
    return {k: b.rlike(p) for k, p in tests.items()}


def _weights(w: DataFrame) -> DataFrame:
    """entity_id, _w: a record's terms and their weights as a map."""
    return w.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("_w"))


def _with_weights(records: DataFrame, w: DataFrame) -> DataFrame:
    out = records.join(_weights(w), "entity_id", "left")
    return out.withColumns({"weights": F.col("_w"), "terms": F.coalesce(F.map_keys("_w"), F.array().cast("array<string>"))}).drop("_w")


def tfidf_weights(records: DataFrame, corpus: DataFrame, c: str = "name_norm") -> DataFrame:
    """records with terms and weights of their text c. corpus: a row with c for each record of both sides. Weights are tf x ln(1 + N / df) over their norm.

    Equal texts are one row with their number from the first shuffle on.
    """
    names = corpus.groupBy(c).agg(F.count(F.lit(1)).alias("_m")).withColumn("_t", text.tokens_of(F.col(c))).where(F.size("_t") > 0)
    counts = F.transform(F.array_distinct("_t"), lambda t: F.struct(t.alias("term"), F.size(F.filter("_t", lambda x: x == t)).alias("tf")))
    each = names.select(c, "_m", F.explode(counts).alias("_x")).select(c, "_m", "_x.term", "_x.tf")
    total = names.agg(F.sum("_m").alias("n"))
    df = each.groupBy("term").agg(F.sum("_m").alias("df")).join(F.broadcast(total)).select("term", F.log(1 + F.col("n") / F.col("df")).alias("idf"))  # total: one row
    w = each.join(df, "term").groupBy(c).agg(F.array_sort(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("w")))).alias("_w"))
    norm = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda s, x: s + x.w * x.w))
    w = w.withColumn("_norm", norm).select(c, F.map_from_entries(F.transform("_w", lambda x: F.struct(x.term, x.w / F.col("_norm")))).alias("weights"))
    return records.join(w, c, "left").withColumn("terms", F.coalesce(F.map_keys("weights"), F.array().cast("array<string>")))


def tfidf_cosine() -> Column:
    """Over pairs whose sides have terms and weights (``tfidf_weights``)."""
    (ta, tb), (wa, wb) = _ab("terms"), _ab("weights")
    return F.aggregate(F.array_sort(F.array_intersect(ta, tb)), F.lit(0.0), lambda s, t: s + wa[t] * wb[t])


def idf_weights(records: DataFrame, keys: DataFrame, frequencies: DataFrame, n: int) -> DataFrame:
    """records with terms and weights ln(n / df); frequencies come from the training fold alone, words outside it count nothing. keys: entity_id, key."""
    w = keys.select("entity_id", "key").distinct().join(frequencies, "key").select("entity_id", F.col("key").alias("term"), F.log(F.lit(float(n)) / F.col("df")).alias("w"))
    return _with_weights(records, w)


def idf_overlap() -> Column:
    """Summed weights of common words, over pairs whose sides have terms and weights (``idf_weights``)."""
    (ta, tb), (wa, _) = _ab("terms"), _ab("weights")
    return F.aggregate(F.array_sort(F.array_intersect(ta, tb)), F.lit(0.0), lambda s, t: s + wa[t])


jaro_winkler = sim.batch_udf(sim.jaro_winkler_all, T.DoubleType())
damerau = sim.batch_udf(sim.damerau_all, T.IntegerType())
ratios = sim.batch_udf(sim.ratios_all, T.StructType([T.StructField(c, T.DoubleType()) for c in ("indel", "token_sort", "token_set", "partial", "weighted", "lcs")] + [T.StructField("metaphone_equal", T.BooleanType())]))
_affixes = sim.batch_udf(sim.affixes_all, T.StructType([T.StructField(c, T.IntegerType()) for c in ("prefix", "suffix")]))
indel = sim.arrow_udf(sim.indel, T.DoubleType())
token_sort = sim.arrow_udf(sim.token_sort, T.DoubleType())
token_set = sim.arrow_udf(sim.token_set, T.DoubleType())
partial = sim.arrow_udf(sim.partial_ratio, T.DoubleType())
weighted = sim.arrow_udf(sim.weighted_ratio, T.DoubleType())
lcs_ratio = sim.arrow_udf(lambda a, b: sim.lcs(a, b) / max(1, len(a), len(b)), T.DoubleType())
metaphone_equal = sim.arrow_udf(lambda a, b: bool(a and b) and sim.metaphone(a) == sim.metaphone(b), T.BooleanType())


def fellegi_sunter(patterns: DataFrame, fields: tuple[str, ...], rounds: int = 20) -> dict[str, tuple[float, float]]:
    """m and u of each boolean field by EM over pattern counts. patterns: one row per distinct pattern (2^fields at most) and n."""
    rows = patterns.groupBy(*fields).agg(F.sum("n").alias("n")).collect()
    m, u, p = {f: 0.9 for f in fields}, {f: 0.1 for f in fields}, 0.1
    for _ in range(rounds):
        total = {f: [0.0, 0.0] for f in fields}
        sums = [0.0, 0.0]
        for r in rows:
            like = [p, 1 - p]
            for f in fields:
                for k, q in enumerate((m[f], u[f])):
                    like[k] *= q if r[f] else 1 - q
            g = like[0] / max(1e-300, sum(like))
            for k, w in enumerate((g * r.n, (1 - g) * r.n)):
                sums[k] += w
                for f in fields:
                    total[f][k] += w * bool(r[f])
        clip = lambda x: min(1 - 1e-6, max(1e-6, x))
        m, u = ({f: clip(total[f][k] / max(1e-300, sums[k])) for f in fields} for k in (0, 1))
        p = clip(sums[0] / max(1e-300, sum(sums)))
    return {f: (m[f], u[f]) for f in fields}
