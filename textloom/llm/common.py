"""What the operators of this folder share: table access, shared files, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from textloom.operators.tables import materialize, shared_dir

__all__ = ["documents", "map_batches", "map_whole", "materialize", "named", "parts_of", "read_table", "shared_dir", "unused", "utf8", "with_fields"]

#: Lower-cases A-Z and keeps [0-9a-z] and every byte from 0x80 on; the rest becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_batches(
    df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], dict | None], schema: str
) -> DataFrame:
    """Apply fn to Arrow batches of the named columns; fn gives {column: values} for the schema's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts_of(batch)):
            if (out := fn(part)) is not None:
                yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in target], schema=target)

    return df.select(*[F.col(c) for c in columns]).mapInArrow(run, schema)


def map_whole(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """Apply run to batches of all columns, by position, whatever their names; its batches are columns of the schema in order."""
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    target = StructType([StructField(f"_{i}", f.dataType, True) for i, f in enumerate(schema)])

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=target.names)

    return plain.mapInArrow(shaped, target).toDF(*schema.names)


def parts_of(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batch in pieces, so that the Python objects made of one piece stay few."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def utf8(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null texts as empty ones."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type)
    return [x or b"" for x in column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()]


def documents(df: DataFrame) -> DataFrame:
    """The two columns that most operators read; other columns, whatever their names, stay out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def named(names: list[str]) -> list:
    """Columns by their whole names, dots included."""
    return [F.col(f"`{n}`") for n in names]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores after it that df has no such column; case does not tell columns apart."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def with_fields(df: DataFrame, **fields: str) -> StructType:
    """df's schema with more fields after its own."""
    out = StructType(list(df.schema.fields))
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out
