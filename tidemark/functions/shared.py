"""The folder that driver and executors share, and tables cut from their lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where the driver is the whole cluster."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not context.getCheckpointDir():
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def filed(df: DataFrame) -> DataFrame:
    """As cut, but written as Parquet: compressed by column, and read by column later on. Names have to be unique, types known."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/filed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each told once a row however often it is used later.

    They pass a generator of one row, beyond which the optimizer carries no expression: without it a column that others use
    is written out in each of them, and in filters, until the compiled method is too long to be compiled any further.
    """
    return df.withColumn("told_apart", F.explode(F.array(F.struct(*(e.alias(name) for name, e in columns.items()))))).select(*df.columns, "told_apart.*")


_KEPT: dict = {}


def once(spark: SparkSession, sf_dir: str, make, *key):
    """make(spark, sf_dir, *key), made once a session for a folder and kept: for inputs that many tables share.

    What make returns should be cut from its lineage. A folder whose files change needs forget().
    """
    name = (spark.sparkContext.applicationId, sf_dir, make.__module__, make.__qualname__, *key)
    if name not in _KEPT:
        _KEPT[name] = make(spark, sf_dir, *key)
    return _KEPT[name]


def forget() -> None:
    """Let go of everything that once() keeps."""
    _KEPT.clear()
