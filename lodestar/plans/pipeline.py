"""The linkage pipeline: normalize, block, cut, score, decide, each stage written to Parquet with a manifest and read again."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import blocking, decision, features
from lodestar.plans import views as V
from lodestar.sources import entities as S


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a stage and its manifest (rows, nulls, checksum, seconds) and reads the stage back."""
    spark, began = df.sparkSession, time.time()
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    back = spark.read.parquet(f"{folder}/{name}")
    facts = S.manifest(back).first().asDict() | {"stage": name, "seconds": round(time.time() - began, 3)}
    spark.createDataFrame([(json.dumps(facts),)], "value string").write.mode("overwrite").text(f"{folder}/{name}.manifest")
    return back


def retrieve(a: DataFrame, b: DataFrame, cap: int = 100) -> DataFrame:
    """Candidates of four strategies, at most ``cap`` for each entity; no score is read here."""
    keys: dict[str, Callable[[DataFrame], DataFrame]] = {"name": lambda x: blocking.exact(x, "name_norm"), "prefix": blocking.name_prefix, "postcode": blocking.postcode, "soundex": blocking.name_soundex}
    found = blocking.union({k: (f(a), f(b)) for k, f in keys.items()})
    return blocking.cap(found.withColumn("score", F.lit(0)), cap).drop("score")


def score(pairs: DataFrame, normed: DataFrame) -> DataFrame:
    """p from name and address agreement: the mean of trigram and token similarity, both sides' addresses where they exist."""
    sides = features.with_sides(pairs.select("s1_id", "vendor_id"), normed, normed, "name_norm", "addr_norm", "has_address")
    name = (features.trigram_jaccard() + features.token_jaccard()) / 2
    address = F.when(F.col("a_has_address") & F.col("b_has_address"), features.token_jaccard("addr_norm"))
    return sides.select("s1_id", "vendor_id", F.coalesce((name + address) / 2, name).alias("p"))


def run(spark: SparkSession, entities: DataFrame, folder: str, cap: int = 100) -> DataFrame:
    """entities: both sides, sources told apart by the id's prefix. Returns the submission; every stage stays in ``folder``."""
    normed = stored(text.add_normalized_columns(S.load_entities(entities)), folder, "normalized")
    pairs = stored(retrieve(V.reference(normed), V.vendors(normed), cap), folder, "candidates")
    scored = stored(score(pairs, normed), folder, "scored")
    chosen = decision.choose_k(decision.expected_curve(scored))
    emitted = stored(decision.one_to_one(decision.emit_top(scored, chosen)), folder, "emitted")
    spine = V.reference(normed).select(F.col("entity_id").alias("s1_id"), F.substring("entity_id", 4, 20).cast("long").alias("row_idx"))
    return stored(S.submission(spine, emitted), folder, "submission")
