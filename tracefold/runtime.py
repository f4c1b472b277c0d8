"""Session helpers: materialised tables in the shared folder, and joins that stand hot keys.

Executors may be lost at any time, so lineage is cut by tables written to the
folder that the cluster names in ``spark.checkpoint.dir``, never by blocks kept
on one executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hot keys looked at: a key outside the top HOT_KEYS holds less than 1/HOT_KEYS of the rows.
HOT_KEYS = 1000
#: A key with fewer rows than this is never salted.
HOT_ROWS = 100_000
#: Parts that a hot key is split into.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores, if its scan has fewer: for heavy work on each row of a small file. A large scan is left as it is."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; in local mode a temporary one if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='tracefold-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracefold/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tracefold_path = path
    return back


def release(*dfs: DataFrame) -> None:
    """Delete the files behind materialised tables that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_tracefold_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def hot_keys(df: DataFrame, keys: Sequence[str], at_least: int = HOT_ROWS, most: int = HOT_KEYS) -> DataFrame:
    """The keys with at least ``at_least`` rows, the ``most`` largest of them: never over ``most`` rows.

    Counted exactly, with map-side partial counts. Leaving out the rest is no cap on
    the data: those keys hold less than 1/``most`` of the rows each and are joined plainly.
    """
    return _largest(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, at_least, most)


def _largest(counts: DataFrame, keys: Sequence[str], at_least: int, most: int) -> DataFrame:
    return counts.where(F.col("_n") >= at_least).orderBy(F.col("_n").desc(), *keys).limit(most).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", at_least: int = HOT_ROWS, salts: int = SALTS, counts: DataFrame | None = None) -> DataFrame:
    """``left`` join ``right`` on ``keys``, ``left`` possibly skewed, ``right`` of few rows a key.

    Rows of ``left`` with a hot key are spread over ``salts`` parts by a hash of the row;
    the rows of ``right`` with such a key are repeated once a part. ``how``: inner, left,
    left_semi or left_anti. ``counts``: the keys of ``left`` with their rows (_n), if they are at hand, so that they
    are not counted again. Equal rows of a materialised table have different salts.
    """
    keys = list(keys)
    if getattr(left, "_tracefold_path", None) and left.count() < at_least:
        return left.join(right, keys, how)  # counted from the footers: no key can be hot
    hot = _largest(counts, keys, at_least, HOT_KEYS) if counts is not None else hot_keys(left, keys, at_least)
    hot = hot.withColumn("_hot", F.lit(True))
    # a task that runs again must deal its rows as before: places are fixed in a written table only, elsewhere the row itself decides
    place = F.xxhash64(F.monotonically_increasing_id()) if getattr(left, "_tracefold_path", None) else F.xxhash64(*left.columns)
    spread = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(place, F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    copies = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
