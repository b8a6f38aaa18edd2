"""Session-level helpers shared by all operators: shared folder, lineage cuts, skew-proof joins."""

from __future__ import annotations

import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import loomspar

# Executors need no copy of this package: functions sent to Python workers carry their code with them.
cloudpickle.register_pickle_by_value(loomspar)

#: A key holding more than this share of the rows of a fact table is spread over sub-keys of about that share each.
#: At most 1 / HOT_SHARE keys can exceed it, which bounds the list that is broadcast, and the sub-keys to twice as many.
HOT_SHARE = 0.001


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    It is read from the session. Only where it is unset (tests on one machine) a local folder is set.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(folder)
        return folder
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomspar-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df once in the shared folder and cut its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_lookup(facts: DataFrame, dictionary: DataFrame, key: str, weight: str, spread: str) -> DataFrame:
    """Inner join of facts with a dictionary on ``key``, safe for keys that hold a large share of the facts.

    ``dictionary`` has unique keys and a column ``weight``: the number of fact rows of the key. Keys above
    HOT_SHARE of all rows (at most 1 / HOT_SHARE of them, so they may be broadcast) are split into sub-keys of that
    share by the hash of the fact column ``spread``; every other key is joined as it is. Null keys find nothing.
    """
    total = dictionary.agg(F.sum(weight))
    share = total.scalar() * HOT_SHARE
    hot = dictionary.filter(F.col(weight) > share).select(F.col(key), F.ceil(F.col(weight) / share).cast("int").alias("_salts"))
    salted = (
        dictionary.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts", weight)
    )
    return (
        facts.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int"))
        .drop("_salts")
        .join(salted, [key, "_salt"])
        .drop("_salt")
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
