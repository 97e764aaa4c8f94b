"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import leakage, packing, residue
from tidewell.session import load


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(load(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.pack(load(spark, d, "documents")))


def p6_waste(spark: SparkSession, d: str) -> DataFrame:
    return packing.waste(packing.pack(load(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p7_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_paraphrases(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(load(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_packed, p6_fill, p6_waste, p7_found, p7_paraphrases, p8_found)}
SQL: dict[str, str] = {}
