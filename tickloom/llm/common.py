"""What the training-data operators share: shared storage, words, row keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as all contracts define it: a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where a session has none, one machine alone makes a temporary one and removes it at exit; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="tickloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def give_memory_back() -> None:
    """Let a worker return freed arrays of 64 KiB and more to the system at once; the C library would else keep up to 32 MB of each, in every worker, for later."""
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 16)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass  # another C library: only memory differs


def let_go(spark: SparkSession) -> None:
    """Have shuffle files of plans that nothing refers to any more deleted now: Spark does so when the driver's memory is collected, which a driver with little to do puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store the path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(scan: DataFrame) -> DataFrame:
    """A scan for operators whose work is in Python: with fewer splits than the cluster has cores, which a small or unsplit table has, its rows are dealt to all of them."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


class Scratch:
    """Tables that an operator writes on its way into the shared folder, dropped together once they are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Like materialise."""
        self.paths.append(f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self, *names: str) -> None:
        """Delete the tables of these names; all, if none is given."""
        gone = [p for p in self.paths if not names or p.rsplit("/", 1)[1].rsplit("-", 1)[0] in names]
        for path in gone:
            drop_path(self.spark, path)
        self.paths = [p for p in self.paths if p not in gone]


def word_count(text: Column) -> Column:
    """Number of words of a text, null: 0. JVM only."""
    padded = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_PATTERN, "w")
    return F.length(F.regexp_replace(padded, r"[\x20\x09-\x0D]+", "")).cast("long")


def hash_cell(column: Column, salt: str, cells: int) -> Column:
    """A cell of 0..cells-1 from the md5 of salt and value (null: its own value): SQL engines agree on it."""
    text = F.concat(F.lit(salt), F.coalesce(column.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(cells)


def row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _text, _row, text) of docs, whatever its columns are called: 64-bit hashes of the text and of all columns; rows that share both are repeats of one row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("_text"), _row_hash(docs).alias("_row"), F.col(text_col).alias("text"))


def _row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(docs: DataFrame, classes: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of docs for each root of classes (doc_id, _text, _row, root): the least doc_id (null: last), then text hash, then row hash.

    The id alone chooses nothing: rows without an id, and different texts that share one, stand for their own classes.
    The chosen rows' keys are written, so that what classes come from may go. All columns of docs come out as they are.
    """
    stay = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_text", "_row")).alias("x")).select("x._text", "x._row")
    stay = materialise(stay, "stay")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")
    keyed = docs.select(whole, F.xxhash64(text_col).alias("_text"), _row_hash(docs).alias("_row"))
    return keyed.join(stay, ["_text", "_row"], "left_semi").dropDuplicates(["_text", "_row"]).select("_whole.*")


def ordered_buckets(df: DataFrame, key: str, buckets: int, descending: bool = False) -> DataFrame:
    """df with a column `bucket`: rows in ascending key (null: last; descending: null first and highest key first) are cut at quantiles of the key; buckets ascend with the order.

    Rows with equal keys share a bucket. The driver holds one key for each bucket, and a row finds its own by halving.
    """
    value = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1 if not descending else -(1 << 63)))
    if buckets < 2:
        return df.withColumn("bucket", F.lit(0))
    found = df.select(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0]
    if not found:
        return df.withColumn("bucket", F.lit(0))
    bounds = np.unique(np.array(found, dtype=np.int64))

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, k.to_numpy(), side="left")
        return pd.Series((-at if descending else at).astype(np.int32))

    return df.withColumn("bucket", bucket_of(value))


def running_total(df: DataFrame, key: str, value: str, into: str, ties: list[str], rows_a_bucket: int = 100_000) -> DataFrame:
    """df with `into`: the sum of `value` over all rows before, in ascending key (null last), then by `ties`; the rows come out in that order, partition by partition.

    Sums of buckets first, then inside each bucket: no window spans the table.
    """
    dealt = ordered_buckets(df, key, -(-df.count() // rows_a_bucket))
    sums = dealt.groupBy("bucket").agg(F.sum(value).alias("_sum"))
    before = sums.select("bucket", (F.sum("_sum").over(Window.orderBy("bucket")) - F.col("_sum")).alias("_before"))  # one row a bucket
    inside = Window.partitionBy("bucket").orderBy(F.asc_nulls_last(key), *ties).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.join(F.broadcast(before), "bucket").repartitionByRange("bucket")
    return summed.withColumn(into, F.col("_before") + F.sum(value).over(inside) - F.col(value)).drop("bucket", "_before")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
