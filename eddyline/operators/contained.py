"""Contained events: arrays, maps, JSON and split text as rows, with their parents in scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, values: Column, name: str, position: str | None = None, outer: bool = False) -> DataFrame:
    """A row for each element, the parent's columns kept."""
    if position:
        return df.select("*", (F.posexplode_outer if outer else F.posexplode)(values).alias(position, name))
    return df.select("*", (F.explode_outer if outer else F.explode)(values).alias(name))


def unnest_events(df: DataFrame, values: Column) -> DataFrame:
    """The elements of an array of structs as events of their own, without the parent."""
    return df.select(F.inline(values))


def with_parent(df: DataFrame, name: str = "parent") -> DataFrame:
    """The whole row as a struct column, for reference from below; apply before each unnest for ancestors."""
    return df.select(F.struct("*").alias(name), "*")


def words(df: DataFrame, text: str, name: str = "word", pattern: str = r"\s+") -> DataFrame:
    """A row for each word of a text, with its position from 0; empty texts have none."""
    return unnest(df, F.filter(F.split(F.col(text), pattern), lambda w: w != ""), name, "position")


def json_array(df: DataFrame, json: str, schema: str, name: str) -> DataFrame:
    """The elements of a JSON array column."""
    return unnest(df, F.from_json(F.col(json), f"array<{schema}>"), name)
