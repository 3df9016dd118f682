"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.llm.words import as_bytes
from tracelake.operators.graphs import spread_join
from tracelake.sources.tables import scratch, table, written

__all__ = ["map_texts", "quoted", "scratch", "spread_join", "table", "text_or_empty", "without", "written"]

def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def quoted(column: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def without(df: DataFrame, *results: str) -> DataFrame:
    """df without the columns that are named like results, in any case."""
    gone = {x.lower() for x in results}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in gone])


def map_texts(docs: DataFrame, results: StructType, start: Callable[[], Callable[[list[bytes]], list[pa.Array]]]) -> DataFrame:
    """The columns of docs and those of results, which a function gives for the texts of a batch.

    start is called once in a task and returns that function. The columns travel in one
    struct, so that no name can clash or be misread.
    """
    text = [c.lower() for c in docs.columns].index("text")
    row = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"))

    def run(batches):
        found = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *found(as_bytes(batch.column(0).field(text)))], ["row", *results.names])

    done = row.mapInArrow(run, StructType([*row.schema.fields, *results.fields]))
    return done.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *results.names)
