"""Metrics, decisions, sources, blocking and the pipeline on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import blocking, decision, evaluate, features, profile, training
from lodestar.plans import pipeline
from lodestar.plans import views as V
from lodestar.sources import entities as S
from lodestar.streaming import incremental


def links(spark, d):
    return spark.createDataFrame([(k, v) for k, vs in d.items() for v in vs], "s1_id string, vendor_id string")


def scores(spark, truth, pred):
    spine = spark.createDataFrame([(k,) for k in truth], "s1_id string")
    return evaluate.score_entities(spine, links(spark, truth), links(spark, pred))


@pytest.mark.parametrize(
    ("truth", "pred", "want"),
    [
        ({"A": []}, {"A": []}, 1.0), ({"A": []}, {"A": ["X"]}, 0.0), ({"A": []}, {}, 1.0), ({"A": ["X", "Y"]}, {"A": ["X"]}, 1.25 / 1.5), ({"A": ["X", "Y"]}, {"A": ["X", "Y", "Z"]}, 2.5 / 3.5),
        ({"A": ["X"]}, {"A": []}, 0.0), ({"A": ["X"]}, {"A": ["Y"]}, 0.0), ({"A": ["X"]}, {"A": ["X", "X"], "B": ["Q"]}, 1.0),
    ],
)
def test_macro(spark, truth, pred, want):
    assert evaluate.macro(scores(spark, truth, pred)).first()[0] == pytest.approx(want)


def test_macro_and_pooled(spark):
    s = scores(spark, {"big": [f"b{i}" for i in range(10)], "small": ["s0"]}, {"big": [f"b{i}" for i in range(10)], "small": ["W"]})
    assert evaluate.macro(s).first()[0] == pytest.approx(0.5)
    assert evaluate.pooled(s).first()[0] == pytest.approx(12.5 / 13.75)
    empty = scores(spark, {}, {})
    assert math.isnan(evaluate.macro(empty).first()[0]) and evaluate.pooled(empty).first()[0] == 0.0
    with pytest.raises(ValueError, match="strings"):
        evaluate.score_entities(spark.createDataFrame([("A",)], "s1_id string"), links(spark, {"A": ["X"]}), spark.createDataFrame([("A", 1)], "s1_id string, vendor_id int"))


def cands(spark, *ps):
    return spark.createDataFrame([("A", f"v{i:02d}", p) for i, p in enumerate(ps)], "s1_id string, vendor_id string, p double")


@pytest.mark.parametrize(
    ("ps", "curve", "k"),
    [([0.9, 0.5, 0.2], [0.055847, 0.575832, 0.560303, 0.459227], 1), ([0.99, 0.97, 0.95, 0.9, 0.1], [0.055847, 0.633415, 0.776325, 0.786187, 0.729409, 0.612097], 3), ([0.55, 0.54], None, 2), ([0.99, 0.01], None, 1), ([0.01, 0.01, 0.01], None, 0)],
)
def test_expected(spark, ps, curve, k):
    got = decision.expected_curve(cands(spark, *ps))
    if curve:
        assert [r.e for r in got.orderBy("k").collect()] == pytest.approx(curve, abs=1e-6)
    assert decision.choose_k(got).first().k == k


def test_closed_form_is_the_trial_sum(spark):
    ps = [0.9, 0.6, 0.4, 0.3]
    b = spark.createDataFrame([(ps,)], "p array<double>").select(decision.poisson_binomial(F.col("p"))).first()[0]
    assert sum(b) == pytest.approx(1) and len(b) == 5 and sum(i * x for i, x in enumerate(b)) == pytest.approx(sum(ps))
    with pytest.raises(ValueError):
        decision.check_descending([0.1, 0.2])
    with pytest.raises(ValueError):
        decision.check_descending([0.2, 0.1], 3)


def test_policies(spark):
    c = cands(spark, 0.9, 0.85, 0.5, 0.1)
    assert decision.policy_threshold(c, 0.5).count() == 3
    assert [r.vendor_id for r in decision.policy_margin(c, 0.4, 0.1).collect()] == []
    assert [r.vendor_id for r in decision.policy_margin(c, 0.4, 0.04).orderBy("rank").collect()] == ["v00", "v01", "v02"]
    two = c.unionByName(c.withColumn("s1_id", F.lit("B")).withColumn("p", F.col("p") + 0.01))
    assert {r.s1_id for r in decision.one_to_one(two).collect()} == {"B"}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101), (103, 102), (101, 103)], "a long, b long")
    got = {r.node: r.root for r in decision.components(e).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 100 for i in range(100, 104)}}


def test_match_lists_and_tsv(spark, tmp_path):
    (tmp_path / "gt.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    got = S.parse_matches(S.scan_entities(spark, str(tmp_path / "gt.tsv"), S.MATCH_SCHEMA)).orderBy("source1_entity_id").collect()
    assert [(r.match_list, r.match_count) for r in got] == [(["S2-1", "S3-2"], 2), ([], 0)]


def test_submission_round_trip(spark, tmp_path):
    spine = spark.createDataFrame([("S1-2", 0), ("S1-1", 1)], "s1_id string, row_idx long")
    em = spark.createDataFrame([("S1-1", "S3-9", 2), ("S1-1", "S2-7", 1)], "s1_id string, vendor_id string, rank int")
    found = S.submission(spine, em)
    S.write_submission(found, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == "source1_entity_id\tmatched_entity_ids\nS1-2\t\nS1-1\tS2-7,S3-9\n"
    pool = spark.createDataFrame([("S2-7",), ("S3-9",)], "vendor_id string")
    assert set(S.validate_submission(found, spine, pool).first()) == {0}
    bad = found.withColumn("matched_entity_ids", F.when(F.col("row_idx") == 0, "None").otherwise("S4-1, S2-7")).withColumn("row_idx", 1 - F.col("row_idx"))
    r = S.validate_submission(bad, spine, pool).first()
    assert (r.null_words, r.with_space, r.out_of_order) == (1, 1, 2) and r.bad_prefix >= 2 and r.unknown_ids >= 2
    S.write_candidates(spark.createDataFrame([("S1-1", "S2-7", ["a", "b"])], "s1_id string, vendor_id string, s array<string>"), str(tmp_path / "c"))
    S.append_registry(spark, str(tmp_path / "r"), run_id="1", metric="macro")
    S.append_registry(spark, str(tmp_path / "r"), run_id="2")
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2
    with pytest.raises(ValueError):
        S.append_registry(spark, str(tmp_path / "r"), other="x")


def test_small_sources(spark, tmp_path):
    assert S.merge_config({"a": {"b": 1, "c": None}}, {"a": {"c": 2}}, {"a": {"b": None}}) == {"a": {"b": 1, "c": 2}}
    (tmp_path / "x" / "train").mkdir(parents=True)
    assert S.locate(spark, [str(tmp_path / "no"), str(tmp_path / "x")]).endswith("x")
    with pytest.raises(FileNotFoundError):
        S.locate(spark, [str(tmp_path / "no")])
    df = spark.createDataFrame([("S1-1", " n ", None, "fr")], S.ENTITY_SCHEMA)
    assert tuple(S.load_entities(df).first())[1:3] == ("n", "")
    assert S.size_estimate(df) > 0
    with pytest.raises(ValueError, match="empty"):
        S.check_entities(S.load_entities(df), addresses=True)


def test_postcodes(spark):
    df = spark.createDataFrame([("S1-1", "n", "12345-6789 560001 008006 1234567", "fr")], S.ENTITY_SCHEMA)
    assert sorted(r.key for r in blocking.postcode(df).collect()) == ["008006", "12345-6789", "560001"]
    assert sorted(r.key for r in blocking.postcode(df, truncate=True).collect()) == ["00800", "12345", "56000"]


def test_no_cross_products(spark):
    e = V.entities(spark, "/root/testdata/sf0.001")
    pairs = blocking.pairs(blocking.name_prefix(V.reference(e)), blocking.name_prefix(V.vendors(e)))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    few = blocking.drop_crowded(blocking.name_prefix(e), 2)
    assert few.groupBy("country", "key").count().agg(F.max("count")).first()[0] <= 2


def test_partitioning_does_not_matter(spark):
    c = V.candidates(spark, "/root/testdata/sf0.001")
    a, b = (sorted(map(tuple, decision.emit_top(x, decision.choose_k(decision.expected_curve(x))).collect())) for x in (c, c.repartition(7)))
    assert a == b


def test_models(spark):
    rows = training.label_pairs(V.candidates(spark, "/root/testdata/sf0.001"), V.truth(spark, "/root/testdata/sf0.001")).withColumn("fold", training.fold())
    assert rows.groupBy("s1_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    data = rows.withColumnRenamed("p", "x")
    scored = training.fit(data, ["x"], kind="gbt", maxIter=3)(data)
    assert training.calibrate(scored)(scored).where("calibrated < 0 or calibrated > 1").isEmpty()
    rows = training.ablation(lambda fs: float(len(fs)), {"a": ["x", "y"], "b": ["z"]})
    assert [(r["left_out"], r["delta"]) for r in rows] == [(None, 0.0), ("a", -2.0), ("b", -1.0)]
    w = features.fellegi_sunter(spark.createDataFrame([(True, True, 30), (True, False, 5), (False, True, 5), (False, False, 60)], "a boolean, b boolean, n long"), ("a", "b"))
    assert all(m > u for m, u in w.values())


def test_pipeline_and_stream(spark, tmp_path):
    e = V.entities(spark, "/root/testdata/sf0.001")
    out = pipeline.run(spark, e, str(tmp_path / "p"))
    assert out.count() == V.reference(e).count()
    ids = out.select(F.explode(S.match_list(F.col("matched_entity_ids"))).alias("i"))
    assert ids.count() == ids.distinct().count()
    V.vendors(e).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(V.vendors(e).schema).parquet(str(tmp_path / "in"))
    q = incremental.link(stream, blocking.name_prefix(V.reference(e)), blocking.name_prefix, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    want = blocking.pairs(blocking.name_prefix(V.reference(e)), blocking.name_prefix(V.vendors(e)))
    assert spark.read.parquet(str(tmp_path / "out")).select("s1_id", "vendor_id").exceptAll(want).isEmpty()


def test_nearest_in_blocks_of_queries(spark):
    rng = np.random.default_rng(3)
    points = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [])]
    q, v = spark.createDataFrame(points, "s1_id long, q array<double>"), spark.createDataFrame(points, "vendor_id long, v array<double>").repartition(3)
    got = blocking.ann_topk(q, v, 5, most=17)

    def cosine(x, y):
        x, y = (np.array(z if z else [0.0] * 4) for z in (x, y))
        size = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
        return round(float(x @ y / size), 6) if size else 0.0

    want = {(a, b, k + 1) for a, x in points for k, (_, b) in enumerate(sorted((-cosine(x, y), b) for b, y in points)[:5])}
    assert {(r.s1_id, r.vendor_id, r["rank"]) for r in got.collect()} == want
    assert blocking.ann_topk(q.limit(0), v, 5).count() == 0 and blocking.ann_topk(q, v.limit(0), 5).count() == 0


def test_every_hundredth_vector_is_searched(spark):
    from lodestar.plans import catalog, catalog_text  # noqa: F401

    d = "/root/testdata/sf0.001"
    ids = {r.vec_id for r in V.vectors(spark, d).where("vec_id % 100 = 0").collect()}
    got = catalog.QUERIES["ann_topk"](spark, d).collect()
    assert {r.s1_id for r in got} == ids and len(got) == 10 * len(ids) and ids <= {r.vendor_id for r in got if r.vendor_id == r.s1_id}


def test_causes_of_errors(spark):
    from lodestar.operators import evaluate

    rows = [("S1-1", "S2-1", "acme", "acme", "1 st", "2 st", "Acme", "Акме", "US", "IN", 5, 1), ("S1-1", "S2-2", "acme", "acm", None, "2 st", "Acme", "Acm", "US", "US", None, 3), ("S1-2", "S2-3", "b", "b", "x", "x", "B é", "B", None, None, 1, 1)]
    cols = "s1_id string, vendor_id string, a_name_norm string, b_name_norm string, a_addr_norm string, b_addr_norm string, a_business_name string, b_business_name string, a_country string, b_country string, name_count long, addr_count long"
    got = {(r.vendor_id, r.cause) for r in evaluate.error_causes(spark.createDataFrame(rows, cols)).collect()}
    assert got == {("S2-1", c) for c in ("ADDRESS_NOISE", "COMMON_NAME", "COUNTRY_SHIFT", "MULTILINGUAL", "TRANSLITERATION")} | {("S2-2", c) for c in ("COMMON_ADDRESS", "MISSING_ADDRESS", "NAME_NOISE")}


def test_affixes_and_sound_alikes(spark):
    rows = [("acme consultants", "acme consultancy", 14, 0, True), ("", "x", 0, 0, False), ("solutions a", "solution a", 8, 2, True), ("same", "same", 4, 4, False), ("été", "étés", 3, 0, False)]
    df = spark.createDataFrame(rows, "a_name_norm string, b_name_norm string, p int, s int, alike boolean")
    got = df.select("p", "s", "alike", *(v.alias(k) for k, v in features.affixes().items()), features.sound_alikes().alias("found")).collect()
    assert all((r.p, r.s, r.alike) == (r.prefix, r.suffix, r.found) for r in got), got


def test_bucket_sums(spark):
    counted = spark.createDataFrame([("a", 2), ("b", 3)], "k string, n long")
    assert profile.check_buckets(counted, 5) is counted
    with pytest.raises(ValueError, match="5 of 6"):
        profile.check_buckets(counted, 6)


def test_links_of_a_hub(spark):
    pairs = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(70)] + [(9, 9), (8000, 8000)]
    got = {r.node: r.root for r in decision.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(3000)} | {5000 + i: 5000 for i in range(71)} | {8000: 8000}


def test_components_of_all_orders(spark):
    from lodestar.plans import catalog

    d = "/root/testdata/sf0.001"
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in V._table(spark, d, "orders").select("o_custkey").collect():
        a, b = sorted((find(r.o_custkey), find(r.o_custkey * 7 % 1500 + 1)))
        root[b] = a
    assert {r.node: r.root for r in catalog.QUERIES["components"](spark, d).collect()} == {x: find(x) for x in root}


def plain_jaro_winkler(a, b):
    if a == b:
        return 1.0
    reach, used, left = max(len(a), len(b)) // 2 - 1, set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if b[j] == x and j not in used), None)
        if j is not None:
            used.add(j)
            left.append(x)
    m = len(left)
    if not m:
        return 0.0
    t = sum(x != b[j] for x, j in zip(left, sorted(used), strict=True)) // 2
    s = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return s + 0.1 * p * (1 - s)


def test_jaro_winkler_of_all_names(spark):
    from lodestar.plans import catalog, catalog_text

    names = ["", "société générale", "societe générale", "москва трейд", "москва тред", "東京 商事", "plain name", "plane name"]
    df = spark.createDataFrame([(a, b) for a in names for b in names if a or b], "a string, b string")
    for r in df.withColumn("jw", features.jaro_winkler("a", "b")).collect():
        assert r.jw == pytest.approx(plain_jaro_winkler(r.a, r.b), abs=1e-6), (r.a, r.b)
    d = "/root/testdata/sf0.001"
    assert catalog.QUERIES["feat_jaro_winkler"](spark, d).where("jw is not null").count() == catalog_text._fp(spark, d).count()
