"""Exactly-once log ingestion and large-scale data preparation on Spark."""
