"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from verbaloom.session import ensure_checkpoint_dir

#: Words everywhere in this subpackage are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors see; it goes when the session's JVM ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts lineage in a way that survives lost executors, and gives the optimizer the
    table's true size.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_slices(kind: DataType, of: Callable[..., Sequence[Any]], size: int = 64) -> Callable[..., Column]:
    """``of``, which maps lists of values to a list of results of ``kind``, as a function of columns.

    An Arrow batch holds ten thousand rows; only ``size`` of them are Python objects at a time.
    """
    @F.arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        parts = [pa.array([], to_arrow_type(kind))]
        for at in range(0, len(columns[0]), size):
            parts.append(pa.array(of(*[c.slice(at, size).to_pylist() for c in columns]), to_arrow_type(kind)))
        return pa.concat_arrays(parts)
    return run


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def unit_interval(*parts: Column | str) -> Column:
    """A number in [0, 1) that only depends on ``parts``; SQL engines agree on it."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
