"""Formatters (a record to any number of rows) and storage partitioners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.model import KEYS

#: A formatter turns records into rows; rows keep topic, partition and offset.
Formatter = Callable[[DataFrame], DataFrame]


def identity(records: DataFrame) -> DataFrame:
    return records


def filtering(condition: Column | str) -> Formatter:
    return lambda records: records.filter(condition)


def flat_map(array: Column, name: str) -> Formatter:
    """One row per element; records with an empty or null array give none."""
    return lambda records: records.withColumn(name, F.explode(array))


def with_file_id(formatter: Formatter, file_id: int) -> Formatter:
    """An offset-aware formatter: rows carry the id of the file they go to."""
    return lambda records: formatter(records).withColumn("_file_id", F.lit(file_id).cast("bigint"))


def payload_fields(value: Column) -> Column:
    """The ';'-separated fields of a text payload; null (a tombstone) stays null."""
    return F.split(F.decode(value, "utf-8"), ";")


def json_payload(schema: str, value: str = "value") -> Formatter:
    """Typed rows from JSON payloads; payloads that don't parse, and tombstones, give none."""

    def run(records: DataFrame) -> DataFrame:
        parsed = records.withColumn("__p", F.from_json(F.decode(value, "utf-8"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
        keep = [c for c in records.columns if c != value]
        return parsed.filter("__p is not null").select(*keep, "__p.*")

    return run


def chain(*formatters: Formatter) -> Formatter:
    """One formatter after the other."""

    def run(records: DataFrame) -> DataFrame:
        for f in formatters:
            records = f(records)
        return records

    return run


def written_and_batched(records: DataFrame, formatter: Formatter) -> DataFrame:
    """(topic, partition, batched, written): records polled and rows they became."""
    batched = records.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("batched"))
    written = formatter(records).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("written"))
    return batched.join(written, KEYS, "left").select(*KEYS, "batched", F.coalesce("written", F.lit(0)).cast("bigint").alias("written"))


def utc_date(ts: Column) -> Column:
    return F.to_date(ts)


def date_path(ts: Column, pattern: str = "'dt='yyyyMMdd") -> Column:
    return F.date_format(ts, pattern)


def truncate(column: Column, width: int) -> Column:
    """The truncate transform on text: its first characters."""
    return F.substring(column, 1, width)


def truncate_int(column: Column, width: int) -> Column:
    """The truncate transform on integers: down to a multiple of width."""
    return column - F.pmod(column, F.lit(width))


def bucket(column: Column, n: int) -> Column:
    """A bucket transform by murmur3 of the value (not bit-equal to other systems')."""
    return F.pmod(F.hash(column), F.lit(n))
