"""What the training-data operators share: tables, scratch space, column picking, checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word of a score or of a size: a run of anything but white space.
TOKEN = r"[^\x20\x09-\x0D]+"
#: What separates the words of a near-duplicate or contamination test.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in texts that aren't lower-cased, and what stands between them.
ANY_WORD, BETWEEN_ANY_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever other columns there are (also such that differ in case only)."""
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_{at[name]}").alias(name) for name in names))


def plain(df: DataFrame, *names: str) -> DataFrame:
    """df with columns called _0, _1, ..., but for the named ones, which keep their names."""
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    kept = {at[name]: name for name in names}
    return df.toDF(*(kept.get(i, f"_{i}") for i in range(len(df.columns))))


def packed(df: DataFrame, *names: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """doc, a struct of all columns (or those in keep) as _0, _1, ..., beside the named columns: whatever other columns are called."""
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    own = range(len(df.columns)) if keep is None else [at[name] for name in keep]
    doc = F.struct(*(F.col(f"_{i}").alias(f"_{k}") for k, i in enumerate(own)))
    return plain.select(doc.alias("doc"), *(F.col(f"_{at[name]}").alias(name) for name in names))


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of doc alone, under their names."""
    return df.select("doc.*").toDF(*names)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own on one machine (tests),
    an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="rowweave-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/rowweave/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: lost executors don't cost a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased words (runs of 0-9, a-z and anything beyond ASCII); none for null."""
    return F.array_remove(F.split(F.coalesce(lowered(text), F.lit("")), BETWEEN_WORDS), "")


def bucket_of(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def store(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read back; columns that aren't needed aren't read again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what store() wrote for df, which nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def token_list(text: Column) -> Column:
    """Lower-cased runs of anything but white space; none for null."""
    return F.regexp_extract_all(F.coalesce(lowered(text), F.lit("")), F.lit(TOKEN), F.lit(0))
