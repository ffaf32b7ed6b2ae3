"""What reviewers found, against the SQL of each query or by hand."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.functions import similarity as sim
from lodestar.functions import text
from lodestar.operators import features
from lodestar.plans import catalog, catalog_text  # noqa: F401


@pytest.fixture(scope="module")
def against(spark, tmp_path_factory):
    """The rows of a query, and those of its SQL, over documents (doc_id, text, lang)."""

    def run(name, documents):
        d = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(documents, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{d}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
        want = con.execute(catalog.SQL[name])
        names, rows = [c[0] for c in want.description], want.fetchall()
        got = catalog.QUERIES[name](spark, d).select(*names).collect()
        return sorted(map(repr, map(tuple, got))), sorted(map(repr, rows))

    return run


SHARP = [(0, "Einfluß und mehr von allem " * 6, "de"), (1, "Einflus und mehr von allem " * 6, "de"), (2, "Einfluh und mehr von allem " * 6, "de"), (3, "ßa ſaſb", "de"), (4, "ßa ſaſb", "de")]


def test_soundex_of_single_characters(spark):
    """Latin, Greek and Cyrillic characters in front and inside a word, as upper() of the SQL has them."""
    words = [w for c in map(chr, (*range(33, 0x180), *range(0x370, 0x530))) if c.isprintable() for w in (c + "t", "b" + c + "b")]
    got = {r.x: r.c for r in spark.createDataFrame([(w,) for w in words], "x string").select("x", text.soundex(F.col("x")).alias("c")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS w", [words])
    want = dict(con.execute(f"SELECT w, {catalog_text._sound('w')} FROM t").fetchall())
    assert {w: (got[w], want[w]) for w in words if got[w] != want[w]} == {}


@pytest.mark.parametrize("name", ["soundex_ref", "block_soundex", "block_union", "candidate_cap", "recall_guard", "blocking_recall", "feat_retrieval"])
def test_sharp_s_has_no_code(against, name):
    got, want = against(name, SHARP)
    assert got == want and got


def test_sharp_s_in_first_tokens(against):
    got, want = against("feat_first_token", SHARP)
    assert got == want and any("True, False" in r or "False, True" in r for r in got)


LINES = [f"{a}inc {b}" for a in ("é", "a", "", "-") for b in ("llcé", "ltd", "été", "pvté x", "corp_")]
LINES = [(x + " " * 40)[:40] + y for x in LINES for y in ("abc été road x", "abc road é", "ab éroad", "été 123456é", "éfloor nearé ÉAB", "abc\x0bst. road", "old st.é rd.a")]


@pytest.mark.parametrize("name", ["suffix_counts", "addr_abbrev", "region_patterns", "addr_components", "block_house_road"])
def test_words_end_where_they_do_in_the_sql(against, name):
    got, want = against(name, [(i, t, "fr") for k, t in enumerate(LINES) for i in (97 * 3 * k, 97 * (3 * k + 1))])
    assert got == want and got


CODES = [(i, f"{t:<40}{a} x", "de") for i, (t, a) in enumerate((t, a) for t in ("one", "two") for a in ("", "738033 ab", "ab 12345-6789", "738033 12345", "ab -738033", "", "ab 10054"))]


@pytest.mark.parametrize("name", ["block_postcode", "block_union", "feat_retrieval"])
def test_only_the_postcode_at_the_end_is_a_key(against, name):
    got, want = against(name, CODES)
    assert got == want
    assert name != "block_postcode" or not got


@pytest.mark.parametrize("name", ["block_union", "candidate_cap", "blocking_recall"])
def test_names_without_words_in_the_union(against, name):
    got, want = against(name, [(i, t, "de") for i, t in enumerate(["", "", "  ", " \n", "", None, "a b", "A c", None])])
    assert got == want and got


PAIR_FEATURES = "exact levenshtein damerau jaro_winkler token_jaccard trigram_jaccard tfidf_cosine lengths first_token legal affixes name_in_addr missing cross idf_overlap landmark".split()


@pytest.mark.parametrize("name", PAIR_FEATURES)
def test_pairs_are_not_shuffled(spark, name):
    """What grows with the square of a block is neither made distinct nor joined again."""
    plan = catalog.QUERIES[f"feat_{name}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.splitlines()[: next(i for i, x in enumerate(plan.splitlines()) if "Join" in x) + 1]
    assert not any("Aggregate" in x for x in above) and "_k" in above[-1], above


def test_cells_of_crowded_blocks(spark):
    rows = [(f"S{i % 3 + 1}-{i}", "fr" if i % 2 else "de", "k" if i % 5 else None if i % 10 else "z", i) for i in range(200)]
    df = spark.createDataFrame(rows, "entity_id string, country string, key string, x long")
    a, b = df.where("entity_id like 'S1-%'"), df.where("entity_id not like 'S1-%'")
    want = sorted((p[0], q[0], p[3], q[3]) for p in rows for q in rows if p[0][1] == "1" and q[0][1] != "1" and p[1:3] == q[1:3] and p[2])
    for cell in (3, 2048):
        assert sorted(map(tuple, features.block_pairs(a, b, "key", "x", cell=cell).select("s1_id", "vendor_id", "a_x", "b_x").collect())) == want


@pytest.mark.parametrize("name", ["feat_exact", "feat_tfidf_cosine", "feat_idf_overlap", "feat_lengths", "feat_legal", "feat_missing", "feat_landmark", "feat_trigram_jaccard", "feat_affixes", "feat_damerau"])
def test_features_of_odd_names(against, name):
    texts = ["", "ab", "ab", "abc co near the old mill", "abc inc near old", "ABC INC near old", "abc", "abç x", "ab  ", "abc abc abd", "abc abd limited", "abc acb"]
    got, want = against(name, [(i, t + (" " * 40 + "behind the x y z" if i % 4 == 0 else ""), "fr") for i, t in enumerate(texts * 2)])
    assert got == want and got


@pytest.mark.parametrize("name", ["block_addr_tok5", "block_addr_tok10", "block_common_tokens", "char_ngram3_block", "char_ngram4_block", "char_ngram_block", "cap_sweep", "bm25_topk", "block_union"])
def test_candidates_are_not_made_distinct_by_a_shuffle(spark, against, name):
    """A pair is kept at its first common key; what groups, if anything, stands above pairs that are already distinct."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "Join" in x and "_i#" in x and "_j#" in x)
    if name.startswith(("block", "char")):
        assert not any("Aggregate" in x or "Join" in x for x in plan[:at])
    got, want = against(name, [(i, f"{t:<20}{'road old mill ' * (i // 7 % 3)}ab:cd ef {t} mill north", c) for i, (t, c) in enumerate((t, c) for t in ("abcd efgh jklm", "abcd efgh jkln", "ABCD  efgh xyz", "", "abc") for c in ("fr", "de", "fr", "1:f", None, "fr", "de"))])
    assert got == want and got


def test_edits_of_many_pairs():
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
    a, b = [[word("abcé") for _ in range(1500)] + x for x in (["", "a", "ca", "x" * 90], ["", "", "abc", "y" * 3])]
    assert list(sim.damerau_all(a, b)) == [sim.damerau(x, y) for x, y in zip(a, b, strict=True)]
    assert len(sim.damerau_all([], [])) == 0


@pytest.mark.parametrize("name", ["cap_sweep", "candidate_cap"])
def test_caps_rank_what_the_best_of_blocks_are(spark, against, name):
    """More candidates than the cap, found by one, two and three strategies; no pairs of whole blocks are made."""
    texts = [f"{p}{q:<20}{'.' * 20}street {z}" for p in ("abc", "abd", "") for q in ("", " x", "b", "zz top") for z in ("", "10001", "one 20002-1234")]
    got, want = against(name, [(i, texts[i * 7 % len(texts)], "fr" if i % 11 else "de" if i % 2 else None) for i in range(600)])
    assert got == want and got
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "Join" in x and "_i#" in x and "_j#" in x)
    assert any("WindowGroupLimit" in x or "<= 10" in x for x in plan[at:])


def test_ngrams_of_equal_names_meet_once(spark, against):
    """Many copies of one name, names that differ in case, short ones and null; only texts and the grams before a key are joined."""
    names = ["abcdefgh ijkl mnop", "ABCDEFGH ijkl mnoq", "abcdefgh ijkl", "abcd", "abcde", "", None, "éabcdefgh ijkl mnop"]
    for name in ("char_ngram3_block", "char_ngram_block"):
        got, want = against(name, [(i, names[i * 5 % 8] if i > 300 else names[0], "fr" if i % 13 else None if i % 2 else "de") for i in range(420)])
        assert got == want and len(got) > 10000
    plan = catalog.QUERIES["char_ngram_block"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(x for x in plan if "Generate" in x)
    assert "explode" in at and not any("grams" in x for x in plan[:2])


def test_equal_keys_are_carried_before_the_key_alone(spark):
    plan = catalog.QUERIES["block_addr_tok10"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "Join" in x and "_i#" in x and "_j#" in x)
    assert any("arrays_overlap(a_before" in x for x in plan[: at + 1]) and "_all" not in plan[at + 1]


def test_causes_need_no_join_of_pairs(spark, against):
    texts = ["abc co" + " " * 40 + "old road", "abc co" + " " * 40 + "new road", "abc x", "abc x", "", None, "abd"]
    got, want = against("error_causes", [(i, texts[i * 3 % 7], "fr" if i % 11 else "de") for i in range(200)])
    assert got == want and got
    plan = catalog.QUERIES["error_causes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [x for x in plan if "Join" in x]
    assert "_i#" in joins[0] and "_j#" in joins[0]


def test_ratios_of_many_pairs(spark):
    rng = random.Random(7)
    word = lambda: " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 7))).strip()
    a, b = [[word() for _ in range(600)] + x for x in (["", "a", "ca", "x" * 90, "ab", "knight"], ["", "", "abc", "y" * 3, "ab", "night"])]
    plain = lambda a, b: max(sim.indel(a, x) for x in (*(b[k : k + len(a)] for k in range(len(b) - len(a) + 1)), *(b[:k] for k in range(1, len(a))), *(b[-k:] for k in range(1, len(a)))))
    for x, y, r in zip(a, b, sim.ratios_all(a, b).itertuples(index=False), strict=True):
        assert tuple(r) == (sim.indel(x, y), sim.token_sort(x, y), sim.token_set(x, y), sim.partial_ratio(x, y), sim.weighted_ratio(x, y), sim.lcs(x, y) / max(1, len(x), len(y)), bool(x and y) and sim.metaphone(x) == sim.metaphone(y))
        if x and y and len(x) != len(y):
            assert r.partial == plain(*sorted((x, y), key=len))
    got = catalog.QUERIES["feat_ratios"](spark, "/root/testdata/sf0.001").collect()
    names = {r.entity_id: r.name_norm for r in catalog.QUERIES["normalize_name"](spark, "/root/testdata/sf0.001").collect()}
    assert len({(r.s1_id, r.vendor_id) for r in got}) == len(got) == catalog.QUERIES["feat_exact"](spark, "/root/testdata/sf0.001").count()
    assert all(abs(r.indel - sim.indel(names[r.s1_id], names[r.vendor_id])) < 1e-6 for r in got)


@pytest.mark.parametrize("name", ["feat_tfidf_cosine", "feat_levenshtein", "feat_cross", "feat_missing", "feat_lengths", "feat_legal"])
def test_features_once_for_each_pair_of_lists(spark, against, name):
    """Records that agree in all a feature looks at are joined as lists of 64, and pairs are made of their ids after the feature."""
    texts = [f"abc{' ' * (i % 2)} acme ltd x y" + " " * 30 + "near the old mill" for i in range(300)]
    got, want = against(name, [(5141 * (i + 1), t, "fr") for i, t in enumerate(texts)])  # one house number and postcode for all
    assert got == want and len(got) == 100 * 200
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = plan[: next(i for i, x in enumerate(plan) if "Join" in x)]
    assert sum("Generate explode(s1_id" in x or "Generate explode(vendor_id" in x for x in above) == 2, above


def test_all_common_words_are_keys(against):
    """More words than the twenty most frequent of a field: records that share a rare one alone are candidates too."""
    names = [f"word{k:02d}\xa0x rare{k:02d}" for k in range(40)]
    got, want = against("block_common_tokens", [(i, f"{names[i // 3]:<40}'street{i // 9}' one", "fr") for i in range(120)])
    assert got == want and {"('S1-0000117', 'S2-0000118')", "('S1-0000117', 'S3-0000119')"} <= set(got)


def test_postcodes_anywhere_are_keys(against):
    """In the middle, beside one another, twice, longer, joined to words and accents."""
    middles = ["738033 ab", "ab 738033 12345", "12345-6789, 738033", "é738033 560001", "12345-67890", "x_12345 738033é", "1234567 ٣12345 ²738033", "(560001)", ""]
    got, want = against("block_postcode", [(i, f"{'one':<40}{middles[i % 9 if i < 9 else i // 3 % 9]} x", "de") for i in range(53)])
    assert got == want and {"('S1-0000003', 'S2-0000022')", "('S1-0000000', 'S2-0000001')"} <= set(got)


ODD_KEYS = [(i, f"{p}{q:<20}{'.' * 20}street {z}", "fr" if i % 11 else "de" if i % 2 else None) for i in range(400) for p, q, z in [(("abc", "abd", "")[i // 5 % 3], ("", " x", "b", "zz top")[i // 3 % 4], ("", "10001", "one 20002-1234")[i // 12 % 3])]]


def _meets_lists(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = plan[: next(i for i, x in enumerate(plan) if "Join" in x and "_i#" in x and "_j#" in x)]
    return sum("Generate explode(s1_id" in x or "Generate explode(vendor_id" in x for x in above) == 2


def test_union_of_lists(spark, against):
    """Records of the same keys are joined as lists, and pairs are made of their ids after the strategies are known."""
    got, want = against("block_union", ODD_KEYS)
    assert got == want and len(got) > 5000 and _meets_lists(spark, "block_union")


def test_recall_needs_no_union(spark, against):
    got, want = against("blocking_recall", ODD_KEYS)
    assert got == want and len(got) > 2
    plan = catalog.QUERIES["blocking_recall"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(b_n" in plan


def test_guard_needs_no_union(spark, against):
    got, want = against("recall_guard", ODD_KEYS)
    assert got == want and any(int(r.rstrip(")").split(", ")[-1]) > 20 for r in got)
    plan = catalog.QUERIES["recall_guard"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "b_places" in plan


def test_claims_are_counted_for_lists(spark, against):
    got, want = against("feat_retrieval", ODD_KEYS)
    assert got == want and len(got) > 5000 and _meets_lists(spark, "feat_retrieval")


def _once(spark, against, name):
    texts = [f"abc{' ' * (i % 2)} acme{' x' * (i % 3)} ltd" for i in range(300)]
    got, want = against(name, [(5141 * (i + 1), t, "fr") for i, t in enumerate(texts)])
    assert got == want and len(got) == 100 * 200 and _meets_lists(spark, name)


def test_damerau_once_for_each_pair_of_names(spark, against):
    _once(spark, against, "feat_damerau")


def test_jaro_winkler_once_for_each_pair_of_names(spark, against):
    _once(spark, against, "feat_jaro_winkler")


def test_numbers_of_many_pairs_at_once():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc é") for _ in range(rng.randint(0, 14)))
    a, b = [[word() for _ in range(1500)] + x for x in (["", "a", "x" * 64, "x" * 65, "ab" * 32, "a\0"], ["", "", "x" * 63, "x" * 64, "ba" * 32, "a"])]
    assert list(sim.jaro_winkler_all(a, b)) == [sim.jaro_winkler(x, y) for x, y in zip(a, b, strict=True)]
    assert list(sim.partial_all(a, b)) == [sim.partial_ratio(x, y) for x, y in zip(a, b, strict=True)]
    assert list(sim.lcs_all(a, b)) == [sim.lcs(x, y) for x, y in zip(a, b, strict=True)]
    assert list(sim.affixes_all(a, b).prefix) == [next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))) for x, y in zip(a, b, strict=True)]


def test_trigram_jaccard_once_for_each_pair_of_names(spark, against):
    _once(spark, against, "feat_trigram_jaccard")


def test_affixes_once_for_each_pair_of_names(spark, against):
    _once(spark, against, "feat_affixes")


def test_ratios_of_lists(spark):
    assert _meets_lists(spark, "feat_ratios")
