"""Reading and writing the tables of record linkage: entity files, match lists, submissions, candidates, manifests."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
MATCH_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
#: Column order of the experiment registry.
REGISTRY_COLUMNS = "run_id date stage hypothesis dataset config metric value baseline delta runtime memory decision notes".split()


def strip(c: Column) -> Column:
    """c without white space of any kind at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def scan_entities(spark: SparkSession, path: str, schema: T.StructType = ENTITY_SCHEMA) -> DataFrame:
    """A tab-separated file with a header and no quoting; malformed rows fail the job."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", mode="FAILFAST")


def head_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order, so that reruns agree."""
    return df.orderBy(*order).limit(n)


def locate(spark: SparkSession, candidates: Iterable[str], marker: str = "train") -> str:
    """The first candidate folder that holds ``marker``, in any file system Spark can read."""
    tried = list(candidates)
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in tried:
        p = path(f"{folder}/{marker}")
        if p.getFileSystem(conf).exists(p):
            return folder
    raise FileNotFoundError(f"no {marker} in any of {tried}")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path and bytes of each file, without its content."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))


def size_estimate(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of df; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def load_entities(df: DataFrame) -> DataFrame:
    """Entities with names and addresses stripped and null addresses as ''."""
    return df.select("entity_id", strip(F.coalesce("business_name", F.lit(""))).alias("business_name"), strip(F.coalesce("business_address", F.lit(""))).alias("business_address"), "country")


def check_entities(df: DataFrame, addresses: bool = False) -> DataFrame:
    """df, once one job has shown that ids and names (and addresses, for the reference list) aren't empty."""
    require(df, *(f.name for f in ENTITY_SCHEMA))
    wanted = ["entity_id", "business_name"] + ["business_address"] * addresses
    bad = df.agg(*(F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(c) for c in wanted)).first()
    if any(bad):
        raise ValueError(f"empty values: {bad.asDict()}")
    return df


def require(df: DataFrame, *columns: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"frame is missing required columns: {missing}")


def match_list(c: Column) -> Column:
    """Comma-joined ids as an array; null and '' are no ids."""
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.split(c, ","))


def parse_matches(df: DataFrame) -> DataFrame:
    """Adds match_list and match_count to a match table."""
    parsed = df.withColumn("match_list", match_list(F.col("matched_entity_ids")))
    return parsed.withColumn("match_count", F.size("match_list"))


def explode_matches(parsed: DataFrame) -> DataFrame:
    """A row for each link: s1_id, vendor_id."""
    return parsed.select(F.col("source1_entity_id").alias("s1_id"), F.explode("match_list").alias("vendor_id"))


def first_match(parsed: DataFrame) -> DataFrame:
    return parsed.select("source1_entity_id", F.get("match_list", F.lit(0)).alias("first_id"))


def submission(spine: DataFrame, emitted: DataFrame) -> DataFrame:
    """spine: s1_id, row_idx. emitted: s1_id, vendor_id, rank. One row for each id of the spine, '' where nothing is emitted."""
    ids = emitted.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vendor_id"))), lambda x: x.vendor_id), ",").alias("ids"))
    return spine.join(ids, "s1_id", "left").select("row_idx", F.col("s1_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))


def write_submission(found: DataFrame, path: str) -> None:
    """A folder with one tab-separated file in the order of row_idx; empty fields stay empty.

    Rows are sorted and written by ranges, and the files then appended to each other as bytes, so that no task holds more than a range.
    """
    spark, parts = found.sparkSession, f"{path.rstrip('/')}.parts"
    ranges = found.repartitionByRange("row_idx").sortWithinPartitions("row_idx").select("source1_entity_id", "matched_entity_ids")
    ranges.write.mode("overwrite").csv(parts, sep="\t", header=False, quote="", emptyValue="")
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    files = source.getFileSystem(conf)
    files.delete(target, True)
    files.mkdirs(target)
    out = files.create(hadoop.fs.Path(target, "part-00000.csv"))
    try:
        out.write(bytearray(b"source1_entity_id\tmatched_entity_ids\n"))
        for name in sorted(s.getPath().getName() for s in files.listStatus(source) if s.getPath().getName().startswith("part-")):
            part = files.open(hadoop.fs.Path(source, name))
            hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
    finally:
        out.close()
    files.delete(source, True)


def validate_submission(found: DataFrame, spine: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row: how often each rule is broken. found: row_idx and the two columns; spine: s1_id, row_idx; vendors: vendor_id."""
    ids = "matched_entity_ids"
    both = spine.select(F.col("s1_id").alias("want"), F.col("row_idx").alias("want_idx")).join(found, F.col("want") == F.col("source1_entity_id"), "full")
    rows = both.agg(
        F.count_if(F.col("source1_entity_id").isNull()).alias("missing_rows"),
        F.count_if(F.col("want").isNull()).alias("extra_rows"),
        F.count_if(F.col("want_idx") != F.col("row_idx")).alias("out_of_order"),
        F.count_if(F.col(ids).isNull() | F.lower(F.col(ids)).isin("none", "null", "nan")).alias("null_words"),
        F.count_if(F.col(ids).rlike(r"\s")).alias("with_space"),
    )
    each = found.select(F.explode(match_list(F.col(ids))).alias("vendor_id"))
    links = each.join(vendors.select("vendor_id", F.lit(1).alias("known")).distinct(), "vendor_id", "left").agg(
        F.count_if(~F.col("vendor_id").rlike("^S[23]-")).alias("bad_prefix"), F.count_if(F.col("known").isNull()).alias("unknown_ids")
    )
    twice = found.groupBy("source1_entity_id").count().agg(F.count_if(F.col("count") > 1).alias("repeated_rows"))
    return functools.reduce(lambda a, b: a.join(b, F.lit(1) == F.lit(1)), (rows.hint("broadcast"), links.hint("broadcast"), twice.hint("broadcast")))  # one row each


def write_candidates(pairs: DataFrame, path: str) -> None:
    """The audit file of candidate pairs: tab-separated, lists joined by commas."""
    flat = [F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in pairs.dtypes]
    pairs.select(*flat).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def manifest(df: DataFrame) -> DataFrame:
    """One row: rows, nulls in each column, and a checksum that doesn't depend on the order of rows."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns))
    own = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *nulls, F.bit_xor(own).alias("checksum"))


def append_registry(spark: SparkSession, path: str, **run: str) -> None:
    """Adds one run to the registry; a column that wasn't measured stays blank."""
    unknown = sorted(set(run) - set(REGISTRY_COLUMNS))
    if unknown:
        raise ValueError(f"not registry columns: {unknown}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in REGISTRY_COLUMNS])
    spark.createDataFrame([tuple(run.get(c) for c in REGISTRY_COLUMNS)], schema).write.mode("append").csv(path, header=True, emptyValue="")


def merge_config(*layers: dict) -> dict:
    """Later layers win, key by key at every depth; None means not measured and overrides nothing."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            if isinstance(v, dict):
                out[k] = merge_config(out.get(k) or {}, v)
            elif v is not None or k not in out:
                out[k] = v
    return out
