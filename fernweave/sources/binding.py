"""Binding of existing tables to the models of a schema.  Bound tables are read only: changes give new frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compile import State
from ..schema import ID, Schema


@dataclass(frozen=True)
class Binding:
    """A model's rows as columns of a frame; ``columns`` maps field names to expressions, the id included."""

    rows: DataFrame
    columns: dict[str, Column | str] = field(default_factory=dict)


def instant(name: str) -> Column:
    """A time without zone, which is taken to be UTC, as an instant in whatever zone the session has."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(name)).cast("timestamp")


def bind(spark: SparkSession, schema: Schema, models: dict[str, Binding], edges: dict[str, DataFrame] | None = None) -> State:
    """A state over bound tables.  Columns are cast to what the schema says; fields without a column are null.

    ``edges``: frames of (src, dst), repeated pairs included, which count once.  Nothing is read before a query needs it.
    """
    tables = {}
    for name, block in schema.models.items():
        bound = models.get(name)
        kinds = schema.struct_type(block)
        if bound is None:
            tables[name] = spark.createDataFrame([], kinds)
            continue
        given = {k: F.col(c) if isinstance(c, str) else c for k, c in bound.columns.items()}
        tables[name] = bound.rows.select(*(given.get(k.name, F.lit(None)).cast(k.dataType).alias(k.name) for k in kinds))
    found = {k: df.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).distinct() for k, df in (edges or {}).items()}
    empty = {k: spark.createDataFrame([], "src long, dst long") for k in schema.edge_sets() if k not in found}
    return State(schema, tables, found | empty)
