"""The pipeline's stages against plain versions, each on its own input, and the guard around the subpackage."""

import subprocess
import sys
from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import near_dedup, packing, toxicity

DATA = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    inputs = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, inputs[-1], DATA)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        inputs.append(spark.read.parquet(str(tmp_path / str(k))))
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in inputs]
    scored = {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert sorted(ids[1]) == sorted(i for i in ids[0] if scored[i] < 0.5)
    groups = defaultdict(list)
    for r in inputs[1].select("doc_id", "text").collect():
        groups["".join(c for c in r.text or "" if c not in SPACE)].append((-len(r.text or ""), r.doc_id))
    assert sorted(ids[2]) == sorted(min(g)[1] for g in groups.values())
    classes = {r.doc_id: r.class_id for r in near_dedup.near_dedup(inputs[2]).collect()}
    assert sorted(ids[3]) == sorted(set(classes.values()))
    assert set(ids[4]) <= set(ids[3])
    pieces = packing.pieces(inputs[4])
    assert inputs[5].select(*pieces.columns).exceptAll(pieces).isEmpty() and inputs[5].count() == pieces.count()


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


def odd_tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(k) for k, c in enumerate(("id", "_id", "h", "key", "node", "size", "times", "rank", "score", "row", "whole"))}
    docs.withColumns(clash).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like those of the stages."""
    long = " ".join(f"w{i % 1999}" for i in range(40_000))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, long, "en", "a", None), (2, long, "en", "a", None), (3, long.replace(" ", "\n"), None, "a", 3), (4, "few words", "en", None, 9), (5, "few words", "en", "b", 9),
            (None, "no id", "en", "b", 5), (None, "no id either", "en", "b", 5), (6, "q" * 50_000, "fr", "b", 1)]
    folder = odd_tables(spark, tmp_path / "odd", rows)
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        columns = columns or docs.columns
        assert k == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k == 2:  # one of the empty texts, one long text, one of the few words, both without an id, the letters
            assert sorted(len(r.text or "") for r in docs.collect()) == [0, 5, 9, 12, 50_000, len(long)]
            assert docs.where("id <> 0 or h <> 2 or whole <> 10").isEmpty()
    assert docs.where("length > 4096 or offset + length > 4096").isEmpty() and docs.count() > 0


def test_run_on_empty_tables(spark, tmp_path):
    folder = odd_tables(spark, tmp_path / "none", [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_entry_imports_without_the_subpackage():
    root = Path(__file__).resolve().parents[2]
    code = "import sys; sys.modules['lodestar.llm'] = None; import __spark_entry__ as e; assert 'macro_f05' in e.queries() and not any(k.startswith('op1') for k in e.queries()); print(len(e.oracle_sql()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) > 80
