"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.components import checkpoint_folder, connected, durable

__all__ = ["WORD", "connected", "durable", "row_key", "stored", "text_bytes"]

#: Words are runs without the ASCII white space characters; `bytes.split()` gives the same runs.
WORD = r"[^\x20\x09-\x0D]+"


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet below the checkpoint folder and read again.

    For wide rows; `durable` keeps narrow ones. The folder is that of the run and goes with it.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame) -> Column:
    """A 128-bit hash of a row's columns, by name: equal rows have equal keys, nulls count where they stand."""
    names = sorted(df.columns)
    cells = [F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) if "map<" in df.schema[c].dataType.simpleString() else F.col(f"`{c}`") for c in names]
    nulls = F.array(*[F.col(f"`{c}`").isNull() for c in names])
    return F.struct(F.xxhash64(*cells, nulls).alias("a"), F.xxhash64(F.lit("again"), nulls, *reversed(cells)).alias("b"))
