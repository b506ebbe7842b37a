"""Events from and to text: JSON, XML, CSV, lines, positional arrays; rendering."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_json(df: DataFrame, column: str, schema: str | T.StructType, reject_unknown: bool = False, defaults: dict[str, Any] | None = None) -> DataFrame:
    """JSON text as columns. Text that is no JSON object of the schema gives nulls; unknown fields may be rejected."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    names = T.StructType.fromDDL(ddl).names
    out = df.withColumn("_json", F.from_json(column, ddl))
    if reject_unknown:
        out = out.where(F.size(F.array_except(F.json_object_keys(column), F.array(*map(F.lit, names)))) == 0)
    made = [F.coalesce(F.col("_json")[n], F.lit(defaults[n])).alias(n) if defaults and n in defaults else F.col("_json")[n].alias(n) for n in names]
    return out.select(*df.columns, *made)


def parse_json_dynamic(df: DataFrame, column: str, name: str = "event") -> DataFrame:
    """JSON text as VARIANT, for fields that no schema declares; null where it is not JSON."""
    return df.withColumn(name, F.try_parse_json(column))


def dynamic(event: Column, path: str, kind: str) -> Column:
    """A dynamic property by path; null where it is absent or of another type."""
    return F.try_variant_get(event, path, kind)


def parse_xml(df: DataFrame, column: str, schema: str) -> DataFrame:
    """XML text as columns; attributes are fields named @name."""
    out = df.withColumn("_xml", F.from_xml(column, schema, {"attributePrefix": "@"}))
    return out.select(*df.columns, "_xml.*")


def parse_csv(df: DataFrame, column: str, schema: str, separator: str = ",") -> DataFrame:
    return df.withColumn("_csv", F.from_csv(column, schema, {"sep": separator})).select(*df.columns, "_csv.*")


def parse_properties(df: DataFrame, column: str, fields: Sequence[str], separator: str = ",") -> DataFrame:
    """Text of name=value pairs as columns."""
    pairs = F.str_to_map(F.col(column), F.lit(separator), F.lit("="))
    return df.select(*df.columns, *(pairs[f].alias(f) for f in fields))


def from_rows(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: str) -> DataFrame:
    """Positional arrays as events; `_seq` is the order given."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, _seq long")


def render_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def render_json_titled(title: str, *columns: str) -> Column:
    return F.to_json(F.struct(F.struct(*columns).alias(title)))


def render_xml(title: str, *columns: str) -> Column:
    return F.to_xml(F.struct(*columns), {"rowTag": title})


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, null: str = "", ts: str | None = None) -> DataFrame:
    """A CSV file with a declared schema; with `ts` (milliseconds) as a stream in its order."""
    df = spark.read.csv(path, schema=schema, header=header, nullValue=null)
    return df if ts is None else df.withColumn("_ts", F.col(ts).cast("long") * 1000).withColumn("_seq", F.monotonically_increasing_id())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text with their order within the input."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("_seq"))


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, header=header, mode="overwrite")


def beacon(spark: SparkSession, n: int, interval_us: int = 0, start: int = 0, /, **columns: Column) -> DataFrame:
    """A generator: n events at an interval, with columns made from `id`."""
    df = spark.range(n).withColumn("_seq", F.col("id")).withColumn("_ts", F.col("id") * interval_us + start)
    return df.select("_ts", "_seq", *(c.alias(name) for name, c in columns.items()))
