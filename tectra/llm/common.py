"""Shared plumbing of the corpus operators: scratch tables in the cluster's shared folder, worker
paths, expression helpers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of ASCII white space, and a word, as the contracts write them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only where all run in one
    process (local masters) an unset one is replaced, by a folder of the machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return root.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it, and bounds the rows of an
    Arrow batch, so that long texts don't add up.  The setting stays in the session: plans run later."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (top, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/tectra/{uuid.uuid4().hex}-{label}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: a cut of the lineage that survives the
    loss of executors and costs one computation (checkpoint() would compute df twice)."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop's file system, wherever the shared folder lives."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def drop_scratch(df: DataFrame) -> None:
    """Removes the files of a materialized frame that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(spark, path)


def _clean() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: higher-order functions do no common-subexpression
    elimination, so an expression used twice within a lambda would otherwise run twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name
