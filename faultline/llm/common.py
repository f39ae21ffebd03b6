"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultline.session import ship_package

#: One task handles at most this much text at once (bytes), however many rows Spark puts in a batch.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part hold about ``SLICE_BYTES`` (a longer text stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, text_col: str, carry: list[str], fields: list[T.StructField],
              start: Callable[[], Callable[[list], list]], also: list[str] = ()) -> DataFrame:
    """Compute ``fields`` from whole texts, keeping the ``carry`` columns of every row.

    ``start`` is called once per task and returns a function that takes the
    texts of a slice as UTF-8 bytes (None for null) — and, for each column in
    ``also``, its Python values — and returns one list or Arrow array per
    field. Rows keep their partition: no shuffle, and no row identity needed.
    """
    ship_package(df.sparkSession)
    hidden = unused("__text", [*carry, *also])
    extra = [c for c in also if c not in carry]
    src = df.select(*[F.col(f"`{c}`") for c in [*carry, *extra]], F.col(f"`{text_col}`").cast("binary").alias(hidden))
    schema = T.StructType([src.schema[c] for c in carry] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        compute = start()
        for whole in batches:
            for batch in text_slices(whole, hidden):
                made = compute(batch.column(hidden).to_pylist(), *[batch.column(c).to_pylist() for c in also])
                cols = [batch.column(c) for c in carry]
                cols += [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(len(carry) + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return src.mapInArrow(run, schema)
