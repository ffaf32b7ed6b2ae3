"""What the document operators share: scratch tables, Arrow blocks, word hashes, window hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null doc_id inside joins; null sorts before every other id.
NULL_ID = -(2**63)
#: A Java regular expression for one word, as every contract here has it.
WORD = r"[^\x20\x09-\x0D]+"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local master may go without that setting; its application then gets one folder of its own, which the context remembers.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not context.getCheckpointDir():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Deletes the scratch tables made so far. Only for a caller that has written every result that reads them."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        p = jvm.org.apache.hadoop.fs.Path(_made.pop())
        p.getFileSystem(conf).delete(p, True)


def with_id(docs: DataFrame, *more: str) -> DataFrame:
    """Columns id (doc_id, null as NULL_ID), text, and more."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("text").cast("string").alias("text"), *more)


def kept_rows(docs: DataFrame, stays: DataFrame) -> DataFrame:
    """One row of docs for each (id, h) of stays: id is doc_id, null as NULL_ID, and h ``xxhash64`` of the text. Columns of docs may have any names."""
    whole = docs.select(F.struct(*docs.columns).alias("whole"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    found = whole.join(stays, ["id", "h"], "left_semi")
    # repeated rows lie in one partition already
    one = found.withColumn("n", F.row_number().over(Window.partitionBy("id", "h").orderBy(F.lit(1)))).where("n = 1")
    return one.select(*(F.col("whole").getField(c).alias(c) for c in docs.columns))


def doc_id_of(column: str = "id"):
    return F.when(F.col(column) == NULL_ID, F.lit(None).cast("long")).otherwise(F.col(column)).alias("doc_id")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, b"" for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes at most, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


class Hashes(dict):
    """64-bit hashes of words, remembered while there are fewer than ``most``; words over ``longest`` bytes never are, so bytes are bounded too."""

    longest = 64

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def hashed(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)

    def __missing__(self, word: bytes) -> int:
        h = self.hashed(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


def word_hashes(words: list[list[bytes]], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in one array, and where each document begins (one entry more than documents)."""
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=at[1:])
    flat = np.fromiter((h for w in words for h in map(known.__getitem__, w)), np.uint64, int(at[-1]))
    return flat, at


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def window_hashes(flat: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``length`` words, at its first word; runs may cross documents."""
    n = len(flat) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = mix(flat + np.uint64(seed)) if seed else flat
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out *= _STEP
        out += base[k : k + n]
    return mix(out)
