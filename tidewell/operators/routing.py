"""Partition groups: which topic partitions share a batch, and their assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.model import KEYS


def modulo_group(n: int) -> Column:
    return F.concat(F.lit("partition_"), (F.col("partition") % n).cast("string"))


def single_group() -> Column:
    return F.lit("root")


def route(records: DataFrame, group: Column) -> DataFrame:
    return records.withColumn("group_name", group)


def assign(current: DataFrame, added: DataFrame, group: Column) -> DataFrame:
    """The groups' partitions after an assignment: old and new together."""
    return current.select(*KEYS).unionByName(added.select(*KEYS)).distinct().withColumn("group_name", group)


def revoke(current: DataFrame, revoked: DataFrame, group: Column) -> DataFrame:
    """What is left; a group without partitions is gone."""
    return current.select(*KEYS).distinct().join(revoked.select(*KEYS).distinct(), KEYS, "left_anti").withColumn("group_name", group)
