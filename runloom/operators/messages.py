"""Messages in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(arguments: Column) -> Column:
    """JSON text in one form (keys in order); other text as it is, so that only equal broken texts are equal."""
    return F.coalesce(F.to_json(F.try_parse_json(arguments)), arguments)


def normalize(role: Column, content: Column) -> Column:
    """struct(role, content, error): null content is empty; a missing role is an error."""
    return F.struct(F.trim(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"), F.when(F.coalesce(F.trim(role), F.lit("")) == "", "role has to be a non-empty string").alias("error"))


def turn_count(roles: DataFrame) -> DataFrame:
    """(conv_id, turns): messages of user and assistant, and one."""
    return roles.groupBy("conv_id").agg((F.count_if(F.col("role").isin("user", "assistant")) + 1).alias("turns"))


def overlay(base: Column, over: Column) -> Column:
    """A map with the entries of another over its own."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)
