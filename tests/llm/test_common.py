"""Shared helpers: the shared folder, blocks, window hashes, components."""

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import common
from lodestar.llm.components import components


def fake(master, found):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: found, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master))


def test_shared_folder_comes_from_the_session():
    assert common.shared_dir(fake("spark://host:1", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(fake("spark://host:1", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(fake("local-cluster[2,1,1024]", None))


def test_local_session_without_the_setting(tmp_path):
    """In a process of its own, whose Spark has no configuration files."""
    code = """
from pyspark.sql import SparkSession
from lodestar.llm import common
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
assert common.materialize(s.range(7), "few").count() == 7 and common.shared_dir(s) == common.shared_dir(s)
print("written to", common.shared_dir(s))
"""
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_CONF_DIR", "PYSPARK_SUBMIT_ARGS")} | {"SPARK_CONF_DIR": str(tmp_path)}
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, timeout=300)
    assert "written to" in done.stdout, done.stderr[-2000:]


def test_blocks_keep_all_rows():
    batch = pa.record_batch({"t": ["x" * n for n in (1, 5000, 3, 0, 70_000, 2)]})
    cut = list(common.blocks([batch, batch.slice(0, 0)], 10_000))
    assert sum(b.num_rows for b in cut) == 6 and len(cut) > 2
    assert [x for b in cut for x in common.as_bytes(b.column("t"))] == [b"x" * n for n in (1, 5000, 3, 0, 70_000, 2)]


def test_window_hashes_depend_on_words_and_order():
    flat, at = common.word_hashes([b"a b c a b c".split(), b"b a c".split()], common.Hashes(most=2))
    assert at.tolist() == [0, 6, 9]
    h = common.window_hashes(flat, 3)
    assert h[0] == h[3] != h[6] and len(common.window_hashes(flat[:2], 3)) == 0
    assert (common.window_hashes(flat, 3, 77) != h).all()
    assert len(np.unique(common.mix(np.arange(1000, dtype=np.uint64)))) == 1000


def test_components(spark):
    rng = np.random.default_rng(7)
    pairs = [(i, i + 1) for i in range(100, 160)] + [tuple(map(int, rng.integers(0, 90, 2))) for _ in range(60)] + [(200, i) for i in range(201, 260)]
    root = {v: v for p in pairs for v in p}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root if find(v) != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sweep_deletes_what_was_written(spark):
    back = common.materialize(spark.range(5), "few")
    assert back.count() == 5
    kept, common._made[:-1] = common._made[:-1], []
    common.sweep(spark)
    common._made[:] = kept
    with pytest.raises(Exception, match="(?i)not exist|not found|FILE"):
        back.count()
