"""What the operators share: checkpoints, tables, input size, bucket hashes and the return of freed memory."""

from __future__ import annotations

import ctypes
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import checkpoint, shared_folder, ship

__all__ = ["bucket", "checkpoint", "give_back", "shared_folder", "ship", "table", "text_bytes", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read again.

    A checkpoint keeps the size that was estimated for its plan, which joins multiply: in a loop that
    joins its own results the estimate soon has millions of digits, and planning takes longer than
    running. A table has the size of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: what the numbers of blocks and shards follow."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def bucket(*columns: str):
    """A bucket hash as a non-negative long; nulls hash too."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 62) - 1))


def give_back() -> None:
    """Return to the system the memory that Python has freed, which the C library otherwise keeps for later; where it cannot, nothing happens."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
